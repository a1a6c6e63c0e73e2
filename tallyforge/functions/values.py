"""Column expressions for trimming, missing values and numbers written as text (all JVM-side)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that only say that there is no value, compared in lower case.
MISSING_WORDS = [
    "null", "(null)", "none", "nil", "nan", "na", "n/a", "n.a.", "n.a", "#n/a", "n/d", "n.d.", "s/d", "k.a.", "k. a.", "\\n",
    "missing", "(missing)", "blank", "(blank)", "empty", "(empty)", "unknown", "undefined", "not provided",
    "not available", "not applicable", "not specified", "no data", "no value", "tbd", "tba",
    "sin dato", "sin datos", "desconocido", "nicht angegeben", "keine angabe", "unbekannt", "fehlt",
    "inconnu", "non renseigné", "manquant", "não informado", "desconhecido", "<na>", "<null>",
]

#: Signs that only say that there is no value.
MISSING_SIGNS = "-–—?.…_*"
#: The one of MISSING_WORDS that names a number: where numbers are asked for it stands for a value that isn't finite.
NOT_A_NUMBER = "nan"
#: All Unicode white space, the space without width and the byte order mark.
SPACES = "".join(chr(c) for c in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
#: Signs that may stand around the digits of an amount: all currency signs of Unicode, commas and %.
AMOUNT_SIGNS = "".join(c for c in map(chr, range(0x1FFFF)) if unicodedata.category(c) == "Sc") + ",%"

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
WHOLE = r"^[+-]?[0-9]+(\.0*)?$"


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only U+0020, and byte order marks."""
    return F.trim(c, F.lit(SPACES))


def is_missing(c: Column, token: Column | None = None, numeric: bool = False) -> Column:
    """Never null: true for null, blank, the feed's own token, and words or signs that say there is no value.

    In a ``numeric`` column NaN is a number that isn't finite, as infinities are, and not a missing one.
    """
    text = strip(c)
    words = [w for w in MISSING_WORDS if not (numeric and w == NOT_A_NUMBER)]
    test = c.isNull() | (F.trim(text, F.lit(MISSING_SIGNS)) == "") | F.lower(text).isin(words)
    if token is not None:
        test = test | F.coalesce(text == strip(token), F.lit(False))
    return F.coalesce(test, F.lit(True))


def number(c: Column) -> Column:
    """A finite decimal or scientific number after removing currency signs, commas and ``%``; else null."""
    text, bare = strip(c), strip(F.translate(c, AMOUNT_SIGNS, ""))
    value = F.when(text.rlike(NUMBER), text).when(bare.rlike(NUMBER), bare).try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)
