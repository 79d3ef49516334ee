"""Text functions of the checks: built-in Column expressions where Spark has them, Arrow UDFs for the rest.

Spark has no Unicode decomposition and no longest-matching-block similarity, so ``normalize`` and
``similarity`` and what rests on them are Arrow-batched UDFs. ASCII variants are pure Columns.
Words are structs (text, cx, cy, conf, added).
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pixels of the grid that duplicates are found on, how far a pre-printed word may be, and height of a line in reading order.
CELL, NEAR, LINE = 16, 22, 20
DATE_FORMATS = {"us": "MMddyyyy", "fr": "ddMMyyyy"}


def plain(text: str | None) -> str | None:
    """Lower case, decomposed, without combining marks."""
    if text is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def plain_key(text: str | None) -> str | None:
    return None if text is None else re.sub(r"[^0-9a-z]", "", plain(text))


def plain_tokens(texts) -> list[str]:
    return sorted({t for x in texts if x is not None for t in re.findall(r"[0-9a-z]+", plain(x)) if len(t) >= 2})


def ratio_of(a: str, b: str) -> float:
    """Twice the matched characters of the longest matching blocks, over all characters; the order of the two matters."""
    return SequenceMatcher(None, a, b).ratio()


def overlap_of(a: list[str], b: list[str]) -> float:
    """The worst of the smaller set's best similarities to the larger one's; 0 if either is empty.

    Lengths bound a similarity, and a member that does as well as the worst so far can't change it: most pairs need no matching.
    """
    if not len(a) or not len(b):
        return 0.0
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    same, worst = set(many), 1.0
    most = lambda x, y: 2.0 * min(len(x), len(y)) / (len(x) + len(y))
    for x in few:
        if x in same:
            continue
        best = 0.0
        for y in sorted(many, key=lambda y: -most(x, y)):
            if most(x, y) <= best or best >= worst:
                break
            if not set(x).isdisjoint(y):
                best = max(best, _ratio_again(x, y))
        worst = min(worst, best)
    return worst


@lru_cache(maxsize=1 << 16)
def _ratio_again(a: str, b: str) -> float:
    return ratio_of(a, b)


def best_run(words: list[dict], value: str, longest: int = 4) -> float:
    """The best similarity of a value to a run of up to so many words in reading order, of half to twice its length."""
    goal = plain_key(value)
    if not goal or not len(words):
        return 0.0
    keys = [plain_key(w["text"]) for w in sorted(words, key=lambda w: (w["cy"] // LINE, w["cx"]))]
    runs = {"".join(keys[i : i + n]) for n in range(1, min(longest, len(keys)) + 1) for i in range(len(keys) - n + 1)}
    return max((ratio_of(r, goal) for r in runs if r and 0.5 * len(goal) <= len(r) <= 2.0 * len(goal)), default=0.0)


@F.pandas_udf(T.StringType())
def normalize(text: pd.Series) -> pd.Series:
    return text.map(plain, na_action="ignore")


@F.pandas_udf(T.StringType())
def key(text: pd.Series) -> pd.Series:
    return text.map(plain_key, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens(texts: pd.Series) -> pd.Series:
    """The distinct normalised tokens of two or more characters of an array of texts, sorted."""
    return texts.map(plain_tokens, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio_of(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else overlap_of(list(x), list(y)) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def best_ngram(words: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([None if w is None or v is None else best_run(list(w), v) for w, v in zip(words, value)], dtype="float64")


def alnum_count(texts: Column) -> Column:
    """ASCII letters and digits in an array of texts."""
    return F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + F.length(F.regexp_replace(t, "[^0-9A-Za-z]", "")))


def ascii_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^0-9a-z]", "")


def ascii_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z]+"), F.lit(0)), lambda t: F.length(t) >= 2)))


def reading_order(words: Column) -> Column:
    """Words by line, then left to right, then as they came."""
    placed = F.transform(words, lambda w, i: F.struct(F.floor(w["cy"] / LINE).alias("line"), w["cx"].alias("cx"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(placed), lambda p: p["w"])


def confident(words: Column, min_conf: Column | float, added_only: bool = True) -> Column:
    limit = min_conf if isinstance(min_conf, Column) else F.lit(min_conf)
    return F.filter(words, lambda w: (w["conf"] >= limit) & (w["added"] if added_only else F.lit(True)))


def within(words: Column, x0: Column, y0: Column, x1: Column, y1: Column, margin: int = 0) -> Column:
    """Words whose centre is in a zone widened by a margin; edges belong to it."""
    return F.filter(words, lambda w: w["cx"].between(x0 - margin, x1 + margin) & w["cy"].between(y0 - margin, y1 + margin))


def _firsts(words: Column, tag) -> Column:
    """Of words with one tag the first, in their order; by sorting, so long arrays take no time squared."""
    # each sorted word beside the one before it; no lambda reads another's variables, which Spark can't match in inputs of UDFs
    tagged = F.array_sort(F.transform(words, lambda w, i: F.struct(tag(w).alias("t"), i.alias("i"), w.alias("w"))))
    before = F.concat(F.array(F.lit(None)), F.slice(tagged, F.lit(1), F.greatest(F.size(tagged) - 1, F.lit(0))))
    pairs = F.zip_with(tagged, before, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    new = F.filter(pairs, lambda p: p["a"].isNotNull() & ~p["a"]["t"].eqNullSafe(p["b"]["t"]))
    return F.transform(F.array_sort(F.transform(new, lambda p: F.struct(p["a"]["i"].alias("i"), p["a"]["w"].alias("w")))), lambda p: p["w"])


def first_of_cell(words: Column) -> Column:
    """Of words with one lower-cased text in one cell of the grid, the first."""
    return _firsts(words, lambda w: F.struct(F.lower(w["text"]).alias("t"), F.floor(F.floor(w["cx"]) / CELL).alias("x"), F.floor(F.floor(w["cy"]) / CELL).alias("y")))


def first_of_place(words: Column) -> Column:
    """Of words with one text at one place, the first."""
    return _firsts(words, lambda w: F.struct(w["text"].alias("t"), w["cx"].alias("x"), w["cy"].alias("y")))


def zone_words(page: Column, zone: Column, sensor: Column | str, min_conf: Column | float) -> Column:
    """The words of a zone by the page sensor, the zone sensor, or both with duplicates taken out; page and zone are already cut to it."""
    which = sensor if isinstance(sensor, Column) else F.lit(sensor)
    empty = F.filter(page, lambda w: F.lit(False))
    both = F.concat(F.when(which != "zone", page).otherwise(empty), F.when(which != "page", F.coalesce(zone, empty)).otherwise(empty))
    return first_of_cell(confident(both, min_conf))


def printed_date(words: Column, date_format: Column) -> Column:
    """The date that words from left to right spell in 8 digits, by the form's format; null if they don't."""
    ordered = F.transform(F.array_sort(F.transform(words, lambda w, i: F.struct(w["cx"].alias("x"), i.alias("i"), w["text"].alias("t")))), lambda s: s["t"])
    digits = F.regexp_replace(F.array_join(ordered, " "), r"[^0-9]", "")
    out = F.lit(None).cast("date")
    for name, pattern in DATE_FORMATS.items():
        out = F.when(date_format == name, F.try_to_date(digits, pattern)).otherwise(out)
    return F.when(F.length(digits) == 8, out)


def any_date(text: Column) -> Column:
    """A declared date: day first, ISO, or month first, tried in that order."""
    return F.coalesce(*[F.try_to_date(text, p) for p in ("dd/MM/yyyy", "yyyy-MM-dd", "MM/dd/yyyy")])


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def sheet_code(text: Column) -> Column:
    """S and one or two digits, as S with two."""
    digits = F.regexp_extract(text, r"S\s*(\d{1,2})", 1)
    return F.when(digits != "", F.concat(F.lit("S"), F.lpad(digits, 2, "0")))


def joined_key(*parts: Column) -> Column:
    """The key of a page's degradation: its factors' texts, joined."""
    return F.concat_ws("_", *parts)


def name_matches(a: Column, b: Column) -> Column:
    """Either holds the other; never if one is empty."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a))


def content_tag(value: Column) -> Column:
    return F.substring(F.sha1(F.to_json(value).cast("binary")), 1, 10)


def draw_seed(key_text: Column) -> Column:
    """A number from a key that is the same in every process."""
    return F.conv(F.substring(F.sha1(key_text.cast("binary")), 1, 12), 16, 10).cast("long")


def format_date(date: Column, date_format: Column) -> Column:
    return F.when(date_format == "us", F.date_format(date, "MM/dd/yyyy")).otherwise(F.date_format(date, "dd/MM/yyyy"))
