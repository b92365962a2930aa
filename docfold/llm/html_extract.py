"""Operator 6: main text of web pages by two passes of block rules.

Markup is read into blocks of text, each with its link density, its stop-word density and what
its surrounding elements say. The first pass decides by these: blocks of menus, headers,
footers, sidebars, adverts, forms and comments, and blocks made of links, are bad; long blocks
with many stop words, and blocks of an article that are not short, are good; short ones stay
open. In the second pass an open block takes the label of its nearest decided neighbour.

Structure and density go before names: where a form, or an element that only its class or id
speaks against, is built like an article (a heading and several paragraphs, or an article element
inside) and has PARDON times the stop words of all that was kept without it, its blocks are judged by
density as if it were a plain element. Notices, adverts and what asks for consent or addresses
are not pardoned so, whatever their size. Where a page would be empty, its fullest element that
is built like an article counts, whatever its name, notices last; readers' comments never do.
Where a page has hardly any known stop word (they are of English, Spanish, French and German),
long blocks with few links are good.

Defined results: a null or empty page, and one without any good block, has an empty text;
unclosed or misnested elements end where their surroundings end; repeated rows each get a
result; an empty table gives no rows. Columns other than those named are not read.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Below SHORT characters a block is open; from LONG on its stop words alone decide.
SHORT, LONG = 60, 200
#: Shares of characters in links, and of words that are stop words.
LINKS, STOPS_LOW, STOPS_HIGH = 0.4, 0.12, 0.25
#: Stop words of a bad element that is built like an article, as a multiple of those kept outside, from
#: which its name does not count; and paragraphs of at least SHORT characters that make such a build.
PARDON, PARAGRAPHS = 5, 2
#: Share of stop words below which a page's language counts as unknown.
KNOWN = 0.03

# Elements of HTML, and words that sites use in names of their elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|template|noscript|textarea|title|iframe|svg|math|select|object|canvas"
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section "
    "summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_ELEMENTS = frozenset("aside button dialog fieldset footer form head menu nav".split())
GOOD_ELEMENTS = frozenset("article main".split())
BAD_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
BAD_NAMES = frozenset(
    "ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright discussion disclaimer disqus footer form gdpr guestbook hidden login masthead menu menus modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion ratings "
    "recommended related replies reply respond reviews search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe tags testimonials toc toolbar topbar trending warning widget widgets".split()
)
BAD_BEGINNINGS = tuple("adsby advert breadcrumb comment cookie newsletter pagination promo recommend sidebar sponsor subscri".split())
ABOUT_OTHERS = frozenset("free has no with without".split())
#: Names of what readers write, which never is the article.
READERS = frozenset("comment comments discussion disqus guestbook ratings replies reply respond reviews testimonials".split())
#: Names of lists of other pages, and of notices, adverts and requests: these are it only where nothing else is.
LISTS = frozenset("breadcrumb breadcrumbs recommended related trending".split())
NOTICES = frozenset(
    "ad ads adv advert advertisement adverts alert banner consent cookie cookies disclaimer gdpr login modal newsletter notice notices "
    "notification overlay popup promo promoted promotion signup sponsor sponsored subscribe warning".split()
)
NOTICE_BEGINNINGS = tuple("adsby advert cookie newsletter promo sponsor subscri".split())
GOOD_NAMES = frozenset("article body content entry main post story text".split())
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can could do for from had has have he her his if in into is "
    "it its more no not of on one or other our she so some than that the their them there these they this to up was we "
    "were what when which who will with would you your "
    "al como con de del el ella en era es esta este fue ha hay la las lo los mas más muy no nos o para pero por que se "
    "ser sin sobre son su sus también un una y ya "
    "au aux avec ce ces cette dans des du elle elles est et eux il ils je le les leur leurs mais ne nous on ont ou où "
    "par pas plus pour qu que qui sa sans ses son sont sur tout très une vous "
    "aber als am auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat "
    "ich ihr im ist kann man mit nach nicht noch nur oder sehr sich sie sind so um und vom von vor war wie wir wird zu "
    "zum zur über".split()
)

# Quotes count only where a value begins; elsewhere, as in title=it's, they are letters like others.
ATTRIBUTES = r"(?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b{ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({ATTRIBUTES})>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """A run of text between block borders."""

    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    hint: int = 0  # 1 inside an article, 0 elsewhere
    bad: int = -1  # the innermost bad element around it, or -1
    heading: bool = False

    @cached_property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())

    @cached_property
    def words(self) -> int:
        return len(WORD.findall(self.text))

    @cached_property
    def stops(self) -> int:
        return sum(w in STOP_WORDS for w in WORD.findall(self.text.lower()))

    @property
    def prose(self) -> bool:
        return self.linked <= LINKS * len(self.text)


NAMED, LISTED, NOTICE, READER = "named", "listed", "notice", "reader"


@dataclass
class Bad:
    """An element that holds no article by its name."""

    above: int  # the next bad element around it, or -1
    kind: str  # NAMED may be pardoned; LISTED and NOTICE on an empty page alone; READER never
    article: bool = False  # an article element is inside
    stops: int = 0
    size: int = 0
    paragraphs: int = 0
    long: int = 0
    headings: int = 0
    pardoned: bool = False

    @property
    def built(self) -> bool:
        return self.article or (self.headings > 0 and self.paragraphs >= PARAGRAPHS)


def hint_of(name: str, attributes: str, above: int) -> tuple[int, str]:
    """What an element says of its contents, given what its surroundings say: 1 for an article,
    0 for neither; and the kind of bad element that it is, or nothing."""
    if name in BAD_ELEMENTS or (name == "header" and above <= 0):
        return above, NAMED if name in ("form", "fieldset") else LISTED
    named = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
    role = named.get("role", "").lower()
    style = named.get("style", "").replace(" ", "").lower()
    bare = ATTRIBUTE.sub("", attributes).lower().split() if attributes else []
    if role in BAD_ROLES or "display:none" in style or "hidden" in bare or named.get("aria-hidden") == "true":
        return above, READER if "display:none" in style or "hidden" in bare or named.get("aria-hidden") == "true" else LISTED
    bad = ""
    good = name in GOOD_ELEMENTS or role in ("main", "article")
    if name not in ("html", "body"):
        parts = {p.lower() for p in NAME_PARTS.findall(f"{named.get('class', '')} {named.get('id', '')}")}
        named_bad = parts & BAD_NAMES or any(p.startswith(BAD_BEGINNINGS) for p in parts)
        # Names like has-sidebar or no-comments tell of something else than the element itself.
        if (named_bad and not parts & ABOUT_OTHERS) or ("header" in parts and above <= 0 and name != "article"):
            notice = parts & NOTICES or any(p.startswith(NOTICE_BEGINNINGS) for p in parts)
            reader = parts & READERS or any(p.startswith("comment") for p in parts)
            bad = READER if reader else NOTICE if notice else LISTED if parts & LISTS else NAMED
        good = good or bool(parts & GOOD_NAMES)
    return 1 if good else above, bad


def blocks_of(page: str) -> tuple[list[Block], list[Bad]]:
    """The blocks of a page, in order, without empty ones, and its bad elements, outer ones first."""
    out: list[Block] = []
    bads: list[Bad] = []
    stack: list[tuple[str, int, int]] = []  # open elements, what they say, and the bad element they are in
    links: int | None = None  # how many elements were open when a link began
    now = Block()
    at = 0

    def close() -> None:
        nonlocal now
        if now.pieces and now.text:
            out.append(now)
        _, hint, bad = stack[-1] if stack else ("", 0, -1)
        now = Block(hint=hint, bad=bad, heading=any(n in HEADINGS for n, _, _ in stack[-2:]))

    def add(raw: str) -> None:
        if not raw:
            return
        text = html_module.unescape(raw)
        if text.strip() and (stack[-1][1:] if stack else (0, -1)) != (now.hint, now.bad):
            close()
        now.pieces.append(text)
        if links is not None:
            now.linked += len(" ".join(text.split()))

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue  # a comment, a declaration, or an element without text of its own
        name = m[3].lower()
        if m[2]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name == "a":
                links = None
            if depth is not None:
                del stack[depth:]
                if links is not None and links > len(stack):
                    links = None
            if name in BLOCK:
                close()
            continue
        if name == "br" or name in ("td", "th", "img"):
            now.pieces.append(" ")
        if name in BLOCK:
            # A paragraph or item that was not closed ends where the next one begins.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or (stack[i][0] == name and name in ("li", "dt", "dd", "option", "tr")):
                    del stack[i:]
                    if links is not None and links > len(stack):
                        links = None
                    break
                if stack[i][0] in BLOCK:
                    break
        if name == "a":
            links = len(stack)
        if name not in VOID and not m[4].endswith("/"):
            _, hint, bad = stack[-1] if stack else ("", 0, -1)
            hint, judged = hint_of(name, m[4], hint)
            if judged:
                bads.append(Bad(bad, judged))
                bad = len(bads) - 1
            elif bad >= 0 and name in GOOD_ELEMENTS:
                bads[bad].article = True
            stack.append((name, hint, bad))
        if name in BLOCK:
            close()
    add(page[at:])
    close()
    return out, bads


def first_pass(block: Block, hint: int, known: bool) -> bool | None:
    """Good, bad, or None for a block that its neighbours decide."""
    size = len(block.text)
    if hint < 0:
        return False
    if not block.prose:
        return False if hint <= 0 or block.linked > 0.9 * size else None
    if block.heading or size < SHORT:
        return None
    if hint > 0:
        return True
    if not known:
        return True if size >= LONG else None
    stops = block.stops / max(1, block.words)
    if stops < STOPS_LOW:
        return False
    return True if stops >= STOPS_HIGH or size >= LONG else None


def second_pass(blocks: list[Block], hints: list[int], labels: list[bool | None]) -> list[bool]:
    """Open blocks take the label of the nearest decided block.

    Only blocks of articles decide for blocks of an article; where none does, or where the two
    nearest are as near and differ, such a block is good. Elsewhere a heading then goes with what
    follows it, and other blocks are bad.
    """
    everywhere = decided_beside(labels)
    articles = decided_beside([label if hint > 0 else None for hint, label in zip(hints, labels, strict=True)])
    out = []
    for i, label in enumerate(labels):
        if label is None:
            j, k = (articles if hints[i] > 0 else everywhere)[i]
            before, after = (None if x is None else labels[x] for x in (j, k))
            if j is None or (k is not None and k - i < i - j):
                label = after
            elif k is None or i - j < k - i or before == after:
                label = before
            elif blocks[i].heading and hints[i] <= 0:
                label = after
        out.append(hints[i] > 0 if label is None else label)
    return out


def decided_beside(labels: list[bool | None]) -> list[tuple[int | None, int | None]]:
    """For each place the nearest ones before and after it that have a label."""
    before: list[int | None] = []
    last = None
    for i, label in enumerate(labels):
        before.append(last)
        last = i if label is not None else last
    after: list[int | None] = []
    last = None
    for i in range(len(labels) - 1, -1, -1):
        after.append(last)
        last = i if labels[i] is not None else last
    return list(zip(before, reversed(after), strict=True))


def weigh(blocks: list[Block], bads: list[Bad]) -> None:
    """Sum up in each bad element what its own blocks are, and those of named elements inside."""
    for b in blocks:
        if b.bad >= 0 and b.prose:
            bad = bads[b.bad]
            bad.stops += b.stops
            bad.size += len(b.text)
            bad.headings += b.heading
            bad.paragraphs += not b.heading and len(b.text) >= SHORT
            bad.long += len(b.text) >= LONG
    for bad in reversed(bads):
        if bad.kind == NAMED and bad.above >= 0:
            above = bads[bad.above]
            above.stops += bad.stops
            above.size += bad.size
            above.headings += bad.headings
            above.paragraphs += bad.paragraphs
            above.long += bad.long
            above.article |= bad.article


def pardon(blocks: list[Block], bads: list[Bad], kept: list[bool]) -> bool:
    """Pardon the named elements that are built like an article and hold far more stop words than what
    is kept without them, outer ones first; whether there are any."""
    without = sum(b.stops for b, good in zip(blocks, kept, strict=True) if good)
    beside: list[int] = []  # stop words kept if all elements around one are pardoned, but not itself
    for bad in bads:
        above = bads[bad.above] if bad.above >= 0 else None
        beside.append(beside[bad.above] + above.stops - bad.stops if above else without)
        bad.pardoned = bad.kind == NAMED and bad.built and bad.stops > PARDON * beside[-1] and (above is None or above.pardoned)
    return any(bad.pardoned for bad in bads)


def last_resort(bads: list[Bad]) -> bool:
    """On a page without good blocks, pardon its fullest element that is built like an article, or
    that has a long paragraph or, unless it is a notice, several; whether there is any.

    Named elements inside it are pardoned where they hold nearly all of it.
    """

    def fits(bad: Bad) -> bool:
        some = bad.kind != NOTICE and bad.paragraphs >= PARAGRAPHS
        return bad.kind != READER and (bad.built or some or bad.long > 0)

    fit = [bad for bad in bads if fits(bad)]
    if not fit:
        return False
    chosen = max(fit, key=lambda bad: (bad.kind != NOTICE, bad.built, bad.size))
    for bad in bads:
        above = bads[bad.above] if bad.above >= 0 else None
        nearly = above is not None and above.pardoned and bad.kind == NAMED and bad.size > PARDON * (above.size - bad.size)
        bad.pardoned = bad is chosen or nearly
    return True


def judged(blocks: list[Block], bads: list[Bad], known: bool) -> list[bool]:
    hints = [-1 if b.bad >= 0 and not bads[b.bad].pardoned else b.hint for b in blocks]
    return second_pass(blocks, hints, [first_pass(b, hint, known) for b, hint in zip(blocks, hints, strict=True)])


def extract(page: str | None) -> str:
    """The main text of one page, its blocks joined by an empty line."""
    if not page:
        return ""
    blocks, bads = blocks_of(page)
    known = sum(b.stops for b in blocks) >= KNOWN * sum(b.words for b in blocks)
    kept = judged(blocks, bads, known)
    weigh(blocks, bads)
    if pardon(blocks, bads, kept):
        kept = judged(blocks, bads, known)
    if not any(kept) and last_resort(bads):
        kept = judged(blocks, bads, known)
    return "\n\n".join(b.text for b, good in zip(blocks, kept, strict=True) if good)


def main_text(pages: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keys`` of each page with text and n_chars, its length in code points."""
    common.small_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([extract(p) for p in batch.to_pylist()], pa.string())

    made = pages.select(*[pages[k] for k in keys], work(pages[html_col]).alias("text"))
    return made.withColumn("n_chars", F.char_length("text").cast("long"))
