"""Text normalisation, fuzzy matching and label cleaning."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hebrew points, quotation marks to drop, and final letters with their plain forms.
POINTS = "[\\u0591-\\u05C7]"
MARKS = "[\\u05F3\\u05F4\"'\\u2018\\u2019\\u201C\\u201D]"
FINAL, PLAIN = "ךםןףץ", "כמנפצ"


def _plain_columns(col: Column) -> Column:
    text = F.regexp_replace(col, POINTS, "")
    text = F.regexp_replace(text, MARKS, "")
    text = F.translate(text, FINAL, PLAIN)
    return F.trim(F.regexp_replace(text, r"(?U)[\s\-_.]+", " "))


@F.pandas_udf(T.StringType())
def _compatible(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _folded(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else x.casefold())


def normalize_text(col: Column | str, ascii_only: bool = False) -> Column:
    """Text as compared by contains: compatibility form, without points and quotes, plain final letters,
    one space for white space and joiners, case folded; null is empty.

    ascii_only: for values known to be ASCII, leaves out the two steps that need Python.
    """
    col = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    if ascii_only:
        return F.lower(_plain_columns(col))
    return _folded(_plain_columns(_compatible(col)))


def plain_text(value: str) -> str:
    """normalize_text of one value."""
    import re

    text = unicodedata.normalize("NFKC", value or "")
    text = re.sub("[֑-ׇ]", "", text)
    text = re.sub("[׳״\"'‘’“”]", "", text)
    text = text.translate(str.maketrans(FINAL, PLAIN))
    return re.sub(r"[\s\-_.]+", " ", text).strip().casefold()


def ratio_of(one: str, two: str) -> float:
    """100 times the best Indel similarity of the shorter text with any window of the longer.

    Windows run over both ends of the longer text. Common subsequences are
    counted with one machine integer as bit rows.
    """
    short, long_ = (one, two) if len(one) <= len(two) else (two, one)
    if not short:
        return 100.0 if not long_ else 0.0
    m, best = len(short), 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << m) - 1
    for start in range(1 - m, len(long_)):
        window = long_[max(0, start) : start + m]
        if 200.0 * len(window) / (m + len(window)) <= best:
            continue
        row = full
        for c in window:
            hit = row & masks.get(c, 0)
            row = ((row + hit) | (row - hit)) & full
        common = m - row.bit_count()
        best = max(best, 200.0 * common / (m + len(window)))
    return best


def partial_ratio(col: Column, target: str) -> Column:
    """ratio_of against one target, in Arrow batches."""

    @F.pandas_udf(T.DoubleType())
    def run(values: pd.Series) -> pd.Series:
        known = {x: ratio_of(x or "", target) for x in values.unique()}
        return values.map(known)

    return run(col)


def sanitize(col: Column, most: int) -> Column:
    """One space for white space, trimmed, at most so many characters."""
    return F.substring(F.trim(F.regexp_replace(col, r"\s+", " ")), 1, most)


def clean_tags(col: Column, max_len: int | None = None, max_n: int | None = None, fold_case: bool = False, pattern: str | None = None) -> Column:
    """Trimmed, shortened, without empty ones and repeats, at most max_n; pattern: only tags that match it whole."""
    tags = F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda t: F.trim(t) if max_len is None else F.trim(F.substring(F.trim(t), 1, max_len)))
    tags = F.filter(tags, lambda t: t.isNotNull() & (t != ""))
    if pattern:
        tags = F.filter(tags, lambda t: t.rlike(f"^(?:{pattern})$"))
    if fold_case:
        folded = F.transform(tags, F.lower)
        tags = F.filter(tags, lambda t, i: F.array_position(folded, F.lower(t)) == i + 1)
    else:
        tags = F.array_distinct(tags)
    return tags if max_n is None else F.slice(tags, 1, max_n)


#: Columns that may name a feature, the best first.
NAME_COLUMNS = ("שם", "name", "Name", "title", "callSign", "netId", "id")


def display_name(df: DataFrame) -> Column:
    """The first name column that isn't blank."""
    there = [c for c in NAME_COLUMNS if c in df.columns]
    blank = F.lit(None).cast("string")
    return F.coalesce(*[F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.trim(F.col(f"`{c}`").cast("string"))) for c in there], blank)
