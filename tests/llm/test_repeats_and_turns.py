"""Operators 11 to 13 against brute force, with odd rows, and the branches for hot keys."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from test_operators import ROWS, table

from docfold.llm import common, exact_dedup, near_dedup, periodic_runs, queries, substring_dedup, turn_repair

TURNS = "conv_id long, turn long, role string, text string, codes string, part string, edits string, digest string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spoilt(rows):
    out = {}
    for c, t, r, x in rows:
        own = out.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        own += [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1], hashlib.sha256(e[2].encode()).digest()))
    return out


def brute_repair(own):
    """Every state's best (cost, audit, lines), row by row from the front."""
    turns = [t for t, _, _ in own if t is not None]
    seen, faults, best = set(), [], {"": (0, "", ())}
    for _, r, x in own:
        y = split(x)
        faults.append("blank" if not y else "duplicate" if (r, x) in seen else "truncated" if y[-1][-1] not in ".!?" else "")
        seen.add((r, x))

    def put(states, state, value):
        states[state] = min(value, states.get(state, value))

    def insert():
        for state in ("", "s", "a", "u"):
            if state in best:
                cost, audit, lines = best[state]
                put(best, NEXT[state], (cost + 2, audit + "I", (*lines, ROLES[NEXT[state]] + ":")))

    for (_, r, x), fault in zip(own, faults, strict=True):
        insert()
        after = {}
        for state, (cost, audit, lines) in best.items():
            put(after, state, (cost + 3, audit + "D", lines))
            if fault in ("", "truncated"):
                late = fault == "truncated"
                put(after, NEXT[state], (cost + 2 + late, audit + "R", (*lines, f"{ROLES[NEXT[state]]}:{x}")))
                if r[:1] == NEXT[state] or (state, r[:1]) == ("", "s"):
                    put(after, r[:1], (cost + late, audit + "K", (*lines, f"{r}:{x}")))
        best = after
    insert()
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    initials = [r[:1] for _, r, _ in own]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(lines)))


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(5)
    roles = ["user", "assistant", "system"] * 5 + ["tool", "", None, "assist", "s", "User"]
    texts = ["a.", "b!", "c", "d?  \n", "", " \t\v", None, "é.", "long " * 50, " ", "x "]
    rows = []
    for c in [None, *range(120)]:
        for k in range(rng.randrange(30) if c != 7 else 400):
            rows.append((c, rng.choice([None, k, k, k, rng.randrange(40)]), rng.choice(roles), rng.choice([*texts, f"{k}."])))
    rows += [(900, 5, "user", "same.")] * 200 + [(901, None, "user", "a." * 50_000)]
    # Conversations of which every row is dropped.
    rows += [(c, 0, "user", "a.") for c in range(2000, 2100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    return rows


@pytest.mark.parametrize(("most", "hot"), [(1, 1 << 40), (3, 1024), (4096, 1024)])
def test_turns_are_repaired(spark, monkeypatch, turns, most, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    df = spark.createDataFrame([(*r, "c", "p", "e", "d") for r in turns], TURNS).repartition(3)
    rows = turn_repair.damaged(turn_repair.named(df, "conv_id", "turn", "role", "text"))
    got = turn_repair.repair(rows, most).collect()
    want = {c: brute_repair(own) for c, own in spoilt(turns).items()}
    assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want


def test_audits_prefer_the_least_letters_and_keep_legal_turns():
    good = bytes([0, 3, 6])  # s, u, a without faults
    assert turn_repair.walks(good, turn_repair.AT_END)[0] == ("KKK", turn_repair.AFTER_A)
    # u u a: deleting costs 3, changing a role 2 and then one insertion, inserting an answer 2.
    assert turn_repair.walks(bytes([3, 3, 6]), turn_repair.AT_END)[0] == ("KIKK", turn_repair.AFTER_A)


def test_no_turns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert turn_repair.repair_damaged(empty).collect() == []


def test_turns_equal_the_sql(spark, tmp_path, turns):
    df = spark.createDataFrame([(*r, "c", "p", "e", "d") for r in turns if r[0] != 7], TURNS)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.op11_turn_repair(spark, str(tmp_path))
    want = con.sql(queries.ORACLE_SQL["op11_turn_repair"])
    assert got.columns == list(want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(24, 3 * q) and all(any(w[k] != w[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def nested(rng, depth):
    if not depth:
        few = rng.choice([1, 2, 2, 5, 50])
        return [rng.randrange(few) for _ in range(rng.randrange(1, 12))]
    return [x for _ in range(rng.randrange(1, 4)) for x in nested(rng, depth - 1) * rng.choice([1, 1, 2, 3, 4, 7])]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng, some = random.Random(seed), 0
    for t in range(250):
        a = rng.randrange(1, 60)
        b = rng.choice([a, a + 1, a - 1])
        w = [
            lambda: [rng.randrange(2) for _ in range(rng.randrange(120))],
            lambda: nested(rng, rng.randrange(1, 4))[:400],
            lambda: (([0] * a + [1]) * rng.randrange(2, 5) + ([0] * b + [1]) * rng.randrange(4))[:400],
        ][t % 3]()
        if w and rng.random() < 0.3:
            w[rng.randrange(len(w))] = 99
        want = brute_runs(w)
        some += len(want)
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(w, np.int64))] == want
    assert some > 100


def test_runs_of_long_texts():
    words = [f"w{i % 777}" for i in range(60_000)]
    assert periodic_runs.runs_of(periodic_runs.numbered(words)) == [(0, 60_000, 777)]
    assert periodic_runs.runs_of(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    two = np.array(([0] * 9000 + [1]) * 5)
    assert {tuple(r) for r in periodic_runs.runs_of(two)} == {(k * 9001, 9000, 1) for k in range(5)} | {(0, 45_005, 9001)}
    # Blocks beyond one automaton's stretch.
    far = np.concatenate([np.arange(50_000), np.tile(np.arange(9000) + 60_000, 4)])
    assert periodic_runs.runs_of(far) == [(50_000, 36_000, 9000)]


def run_row(i, text):
    words = split(text)
    h = zlib.crc32(b"" if i is None else str(i).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
    runs = brute_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (len(runs), *head, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept))


def test_run_digests(spark):
    rng = random.Random(2)
    rows = [r for r in ROWS if len(r[1] or "") < 10_000] + [ROWS[0]]
    rows += [(100 + k, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(200))), "en") for k in range(80)]
    got = periodic_runs.run_digests(table(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *run_row(i, t)) for i, t, _ in rows), key=str)
    assert sum(r["n_runs"] for r in got) > 3
    assert periodic_runs.run_digests(table(spark, [])).collect() == []
    found = periodic_runs.find_runs(table(spark, [(1, "a b " * 20, "en"), (2, None, None)])).collect()
    assert [(r["n_words"], [tuple(x) for x in r["runs"]]) for r in sorted(found)] == [(40, [(0, 40, 2)]), (0, [])]


def brute_removal(rows, length):
    first, split_rows = {}, [(i, split(t)) for i, t, _ in rows]
    last = 1 << 62  # ids that are null come after all others
    for i, ws in split_rows:
        for s in range(len(ws) - length + 1):
            key = tuple(ws[s : s + length])
            first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for i, ws in split_rows:
        gone = {k for s in range(len(ws) - length + 1) if first[tuple(ws[s : s + length])] < (last if i is None else i) for k in range(s, s + length)}
        out.append((i, len(ws), len(gone), sha(" ".join(w for k, w in enumerate(ws) if k not in gone))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [[word() for _ in range(n)] for n in (20, 49, 50, 51, 80, 200, 130)]
    rows = list(ROWS)
    for k in range(60):
        ws = []
        for _ in range(rng.randrange(4)):
            ws += [word() for _ in range(rng.randrange(60))]
            part = rng.choice(shared)
            a = rng.randrange(len(part))
            ws += rng.choice([part, part, part[a:], part[:a], part + part])
        rows.append((rng.choice([k + 20, k + 20, 19, None]), " ".join(ws), "en"))
    rows += [(200 + k, rows[-1 - k][1].replace(" ", "\t"), "en") for k in range(10)]  # copies
    rows += [(300, "same word " * 300, "en"), (301, "same word " * 200, "en"), (302, "Word " * 60, "en"), rows[15], rows[16]]
    return rows


@pytest.mark.parametrize(("length", "hot", "few"), [(50, 1024, 500_000), (50, 1 << 40, 0), (100, 1024, 0), (5, 1024, 500_000)])
def test_removed_passages(spark, monkeypatch, passages, length, hot, few):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    df = table(spark, passages).repartition(3)
    got = substring_dedup.removal_digests(df, length).collect()
    want = brute_removal(passages, length)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(0 < r[2] < r[1] for r in want) > 5
    if few:
        texts = substring_dedup.remove_repeats(df, length).collect()
        assert sorted((str(r[0]), r[1], sha(r[2])) for r in texts) == sorted((str(i), n, s) for i, _, n, s in want)


def test_no_passages(spark):
    assert substring_dedup.removal_digests(table(spark, [])).collect() == []
    assert substring_dedup.levels(50) == [25, 50] and substring_dedup.levels(100) == [25, 50, 100] and substring_dedup.levels(5) == [5]


def test_hot_branches_of_exact_and_near_dedup(spark, monkeypatch):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(6)]
    rows = [(k, base[k % 2] if k < 40 else base[k % 6] + f" x{k}", "en") for k in range(80)]
    df = table(spark, rows)
    exact, near = (sorted(map(tuple, f(df).collect())) for f in (exact_dedup.groups, near_dedup.groups))
    for module, name, value in ((exact_dedup, "HOT", 1 << 40), (near_dedup, "HOT", 1 << 40), (near_dedup, "PART", 1), (common, "BROADCAST_ROWS", 0)):
        monkeypatch.setattr(module, name, value)
    assert sorted(map(tuple, exact_dedup.groups(df).collect())) == exact
    assert sorted(map(tuple, near_dedup.groups(df).collect())) == near
    assert {r["doc_id"] for r in near_dedup.deduplicate(df).collect()} == {i for i, _, _, kept in near if kept}
    assert {r["doc_id"] for r in exact_dedup.deduplicate(df).collect()} == {r[0] for r in exact if r[3]}
