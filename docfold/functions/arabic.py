"""Arabic text: compatibility forms, direction marks, digits and numbers written backwards.

Unicode normalisation and rules that rewrite a match have no built-in function, so one Arrow
function per rule set applies them to whole batches.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Direction marks, and the Arabic-Indic digits.
MARKS = "‏‎"
DIGITS = {ord(c): str(i) for i, c in enumerate("٠١٢٣٤٥٦٧٨٩")}


# Where numbers stand reversed, and what is put before and after the repaired
# digits. The first pattern has two forms, with and without the end of a line as its border.
LIST_NUMBER = r"(?m)(?P<lead>^|[ \t]*[-(]?[ \t]*)\.(?P<digits>[0-9]{1,3})(?=\s%s)"
INSIDE_SPACE = r"(?P<lead>(?<=\s))\.(?P<digits>[0-9]{1,3})(?=[\u0600-\u06FF(]%s)"
INSIDE_WORD = r"(?P<lead>(?<=[\u0600-\u06FF]))\.(?P<digits>[0-9]{1,3})(?=[\u0600-\u06FF(]%s)"
PERCENT = r"(?P<lead>)٪(?P<digits>[0-9]{1,3})"
REVERSED = ((LIST_NUMBER, "", "."), (INSIDE_SPACE, " ", " "), (INSIDE_WORD, " ", " "), (PERCENT, "", "٪"))
SPACING = ((r"[ \t]+", " "), (r"\s+([،؛:.])", r"\1"), (r"([(:])\s+", r"\1"), (r"\s+([)])", r"\1"))


def backwards(digits: str) -> str:
    """A run of digits that was read from the wrong side; one that ends in 0 is right already."""
    return digits if len(digits) > 1 and digits.endswith("0") else digits[::-1]


def repair_numbers(text: str, at_end: bool = True) -> str:
    """``٪05`` to ``50٪`` and ``.03`` to ``30.``; at the end of a line only with ``at_end``."""
    for pattern, before, after in REVERSED:
        pattern = pattern % ("|$" if at_end else "") if "%s" in pattern else pattern
        text = re.sub(pattern, lambda m: f"{m['lead']}{before}{backwards(m['digits'])}{after}", text)  # noqa: B023
    return text


def normalize(text: str, at_end: bool = True, compatibility: bool = True) -> str:
    if compatibility:
        text = unicodedata.normalize("NFKC", text)
    text = repair_numbers(text.translate({ord(c): None for c in MARKS}).translate(DIGITS), at_end)
    for pattern, put in SPACING:
        text = re.sub(pattern, put, text)
    return text.strip()


def normalized(text: Column, at_end: bool = True, compatibility: bool = True) -> Column:
    """Each text normalised; null stays null."""

    @F.arrow_udf("string")
    def apply(batch: pa.Array) -> pa.Array:
        return pa.array([None if t is None else normalize(t, at_end, compatibility) for t in batch.to_pylist()], pa.string())

    return apply(text)


def normalize_text(text: Column) -> Column:
    """Spaces and empty lines folded, and, where there is Arabic, its own rules. Other texts go to no Python."""
    plain = T.normalize_spaces(text)
    return F.coalesce(normalized(F.when(T.contains_arabic(plain), plain)), plain)
