"""Quote containment."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evistrata.common import as_col
from evistrata.functions.text import strip

# Typographic ligatures and their letters.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}


def is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.char_length(value)


def _fold(value: str | None) -> str | None:
    if value is None:
        return None
    value = re.sub(r"(?<=\w)-\s*\n\s*(?=\w)", "", unicodedata.normalize("NFKC", value))
    return re.sub(r"[\s\W_]+", " ", value).casefold().strip()


@F.pandas_udf(StringType())
def _fold_unicode(values: pd.Series) -> pd.Series:
    return values.map(_fold)


def folded_text(value: str | Column) -> Column:
    """Comparable text: compatibility forms, joined line breaks, single spaces, case-folded.

    ASCII text is folded in the JVM; only other text crosses to the Arrow
    function, because Spark has no Unicode normalisation of its own.
    """
    value = as_col(value)
    joined = F.regexp_replace(value, r"(?<=\w)-\s*\n\s*(?=\w)", "")
    ascii_form = F.trim(F.lower(F.regexp_replace(joined, r"[\s\W_]+", " ")))
    return F.when(is_ascii(value), ascii_form).otherwise(_fold_unicode(F.when(~is_ascii(value), value)))


def quote_check(quote: str | Column, text: str | Column, folded_quote: str | Column, folded: str | Column, min_length: int = 12) -> Column:
    """Struct of status, method, matched excerpt and confidence."""
    quote = strip(quote)
    return settled_check(quote, (F.length(quote) >= min_length) & ~as_col(text).contains(quote), folded_quote, folded, min_length)


def settled_check(quote: str | Column, open_: str | Column, folded_quote: str | Column, folded: str | Column, min_length: int = 12) -> Column:
    """The struct of :func:`quote_check` for a stripped quote; ``open_``: long enough, and not in the text as it is."""
    quote, fq, ft = as_col(quote), as_col(folded_quote), as_col(folded)
    close = (F.length(fq) >= min_length) & ft.contains(fq)

    def result(status: str, method: str, excerpt: Column, confidence: float) -> Column:
        return F.struct(
            F.lit(status).alias("validation_status"), F.lit(method).alias("validation_method"),
            excerpt.alias("matched_excerpt"), F.lit(confidence).alias("confidence"))

    return (
        F.when(F.length(quote) < min_length, result("failed", "none", F.lit(""), 0.0))
        .when(~as_col(open_), result("passed", "exact", quote, 1.0))
        .when(close, result("passed", "normalized", quote, 0.9))
        .otherwise(result("failed", "normalized", F.lit(""), 0.0))
    )


def letters_only(value: str | Column) -> Column:
    """Lower-case letters, digits and underscores of a text, ligatures spelled out."""
    out = as_col(value)
    for joined, letters in LIGATURES.items():
        out = F.replace(out, F.lit(joined), F.lit(letters))
    return F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}_]+", "")


def prefix_found(quote: str | Column, letters: str | Column) -> Column:
    """The first 60, the first 120 or all characters of the quote occur; an empty quote passes."""
    quote, letters = F.coalesce(as_col(quote), F.lit("")), as_col(letters)
    found = quote == ""
    for part in (F.substring(quote, 1, 60), F.substring(quote, 1, 120), quote):
        bare = letters_only(part)
        found = found | ((bare != "") & letters.contains(bare))
    return found
