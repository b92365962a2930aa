"""Text functions as column expressions; all of them stay in the JVM.

A null text gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of a token, and the scripts that language tags go by.
TOKEN = r"[\p{L}\p{N}_]+"
ARABIC, CHINESE, JAPANESE, LATIN = r"[\x{0600}-\x{06FF}]", r"[\x{4E00}-\x{9FFF}]", r"[\x{3040}-\x{30FF}]", "[A-Za-z]"

# How steps, list items and reference lines begin or what they hold.
STEP_LINE = r"(?i)^(?:step\s+\d+|\d+[.)]|[a-z]\)|[-*•])"
LIST_LINE = r"^(?:\d+[.)]|[A-Za-z]\)|[-*•])"
REFERENCE_LINE = r"[:=|<>(]"
STEP_START = r"^((?:step\s+)?(?:\d+|[a-zA-Z])[).:-]\s+)"


#: What trimming takes off both ends: the white space of regular expressions.
SPACE = " \t\n\x0b\f\r"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def normalize_spaces(text: Column) -> Column:
    """Line ends to LF, no-break spaces to spaces, runs of blanks to one, at most one empty line."""
    # Most texts have no CR and no run of empty lines, and most blanks stand alone: these stay as they are.
    out = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    out = F.when(F.contains(out, F.lit("\n\n\n")), F.regexp_replace(out, r"\n{3,}", "\n\n")).otherwise(out)
    return trimmed(F.regexp_replace(F.replace(out, F.lit("\u00a0"), F.lit(" ")), r"[ \t]{2,}|\t", " "))


def contains_arabic(text: Column) -> Column:
    return F.rlike(text, F.lit(ARABIC))


def detect_languages(text: Column) -> Column:
    """Tags of the scripts found, in the order ar, zh, ja, en; ``unknown`` if there is none."""
    tags = [F.when(F.rlike(text, F.lit(p)), F.lit(t)) for t, p in (("ar", ARABIC), ("zh", CHINESE), ("ja", JAPANESE), ("en", LATIN))]
    found = F.array_compact(F.array(*tags))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def tokens(text: Column, least: int = 2) -> Column:
    """Distinct lower-case words of at least ``least`` characters, in order of appearance."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: F.char_length(x) >= least))


def normalize_question(text: Column) -> Column:
    """Lower case; what is neither a word character nor a space becomes a space; spaces folded."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]+", " ")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def section_label(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def folded(text: Column) -> Column:
    """Spaces folded, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def excerpt(text: Column, size: int = 420) -> Column:
    return F.left(text, F.lit(size))


def excerpt_at_border(text: Column, size: int = 900, least: int = 540) -> Column:
    """Up to ``size`` characters whole; longer texts end at the last empty line if that is at
    ``least`` or later, else at the last space, else at ``size``, followed by `` ...``."""
    head = F.left(text, F.lit(size))
    backwards = F.reverse(head)
    line = size - F.instr(backwards, "\n\n") - 1
    space = size - F.instr(backwards, " ")
    cut = (
        F.when((F.instr(backwards, "\n\n") > 0) & (line >= least), line)
        .when(F.instr(backwards, " ") > 0, space)
        .otherwise(F.lit(size))
    )
    short = F.concat(F.regexp_replace(F.left(text, cut), r"\s+$", ""), F.lit(" ..."))
    return F.when(F.char_length(text) <= size, text).otherwise(short)


def asset_url(path: Column) -> Column:
    """Path below the public asset folder."""
    return F.concat(F.lit("/assets/"), F.regexp_replace(F.regexp_replace(path, "^/+", ""), "^data/", ""))


def title_of_path(path: Column) -> Column:
    """File stem with underscores and dashes as spaces, or the file name if that is blank."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.trim(F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "[_-]", " "))
    return F.when(stem == "", name).otherwise(stem)


def sibling_path(source: Column, reference: Column) -> Column:
    """A reference beside a source file; ``..`` is kept as it is."""
    return F.concat(F.regexp_replace(source, r"[^/]*$", ""), reference)


def lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    cut = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n"), lambda x: F.trim(x))
    return F.filter(cut, lambda x: x != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def at_most_words(text: Column, n: int) -> Column:
    """Whether a text has no more than ``n`` words, told in one pass that stops at the next one."""
    return ~F.rlike(text, F.lit(rf"^\s*+(?:\S++\s++){{{n}}}\S"))


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _share(items: Column, holds) -> Column:
    return once(items, lambda own: F.when(F.size(own) > 0, F.size(F.filter(own, holds)) / F.size(own)).otherwise(F.lit(0.0)))


def step_density(text: Column) -> Column:
    return _share(lines(text), lambda x: F.rlike(x, F.lit(STEP_LINE)))


def list_density(text: Column) -> Column:
    return _share(lines(text), lambda x: F.rlike(x, F.lit(LIST_LINE)))


def reference_density(text: Column) -> Column:
    return _share(lines(text), lambda x: F.rlike(x, F.lit(REFERENCE_LINE)))


def numeric_density(text: Column) -> Column:
    return _share(words(text), lambda x: F.rlike(x, F.lit(r"[\d%]")))


def definition_density(title: Column, text: Column) -> Column:
    """0.1 for a short title, 0.1 for a lead with a colon or of few words, 0.08 for few lines."""
    short = F.when(F.size(words(title)) <= 8, 0.1).otherwise(0.0)

    def of(own: Column) -> Column:
        lead = F.get(own, F.lit(0))
        opening = F.when(F.contains(lead, F.lit(":")) | (F.size(words(lead)) <= 12), 0.1).otherwise(0.0)
        few = F.when(F.size(own) <= 6, 0.08).otherwise(0.0)
        return F.when(F.size(own) > 0, short + opening + few).otherwise(F.lit(0.0))

    return once(lines(text), of)


def step_number(text: Column) -> Column:
    """``1.``, ``a)`` or ``step 2:`` at the start, in lower case only; empty if there is none."""
    return F.trim(F.regexp_extract(F.trim(text), STEP_START, 1))


def inline_math_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(":math:`[^`]+`"))


def numbers(text: Column) -> Column:
    """All numbers in a text, as they are written."""
    return F.regexp_extract_all(text, F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0))


def number_or_null(text: Column) -> Column:
    return F.when(F.rlike(F.trim(text), F.lit(r"^[-+]?\d+(?:\.\d+)?$")), F.trim(text).cast("double"))


def location_hint(anchor: Column) -> Column:
    """The first of page, slide, sheet, JSON path, rst path and line that an anchor has."""

    def said(name: str, field: str) -> Column:
        value = anchor[field].cast("string")
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name} "), value))

    fields = [("page", "page_number"), ("slide", "slide_number"), ("sheet", "sheet_name"), ("json", "json_path"), ("rst", "rst_path"), ("line", "line_start")]
    return F.coalesce(*[said(n, f) for n, f in fields], anchor["source_label"])


def embedding_text(title: Column, section_path: Column, kind: Column, location: Column, content: Column, archetype: Column) -> Column:
    """The labelled rendering of a chunk that is embedded."""
    place = F.when(F.coalesce(location, F.lit("")) == "", F.lit("unknown")).otherwise(location)
    head = [("Document title: ", title), ("Archetype: ", archetype), ("Section path: ", F.array_join(section_path, " > ")), ("Content type: ", kind), ("Location: ", place)]
    return F.concat(*[F.concat(F.lit(label), value, F.lit("\n")) for label, value in head], F.lit("\nContent:\n"), content)


def casefolded(text: Column) -> Column:
    """A text for comparison whatever its case; the sharp s, which is two letters in capitals, is two here."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def cleaned_list(text: Column, most: int, question: bool = False, asked: Column | None = None) -> Column:
    """A model's answer line by line without bullets and numbers, and without quotes at either end;
    the first of equal lines, whatever their case, stays, and none that equals ``asked``, the text
    that the model was asked about; at most ``most``; with ``question`` each ends in ``?``."""
    unmarked = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s*(?:[-*]|\d+[.)])\s*", ""))
    bare = F.transform(unmarked, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^[\"' ]+|[\"' ]+$", ""))
    kept = F.filter(bare, lambda x: x != "")
    if question:
        kept = F.transform(kept, lambda x: F.when(F.endswith(x, F.lit("?")), x).otherwise(F.concat(x, F.lit("?"))))

    def distinct(own: Column) -> Column:
        keys = F.transform(own, casefolded)
        return F.filter(own, lambda x, i: F.array_position(keys, casefolded(x)) == i + 1)

    if asked is not None:
        kept = F.filter(kept, lambda x: ~casefolded(x).eqNullSafe(casefolded(asked)))
    return F.slice(once(kept, distinct), 1, most)


def closed_labels(text: Column, allowed: list[str]) -> Column:
    """Comma or line separated labels of a closed set, in the order of the text."""
    said = F.transform(F.split(F.lower(text), r"[,\n]"), lambda x: F.trim(x))
    return F.array_intersect(said, F.array(*[F.lit(a) for a in allowed]))


def iso_seconds(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
