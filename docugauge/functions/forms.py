"""What is printed on a form: values by role, a variant's defect included, laid out over fields."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from docugauge.functions.text import format_date


def printed_value(role: Column, value: Column, *, date_kind: Column, date_format: Column, filing: Column, valid_until: Column, expired_until: Column, variant: Mapping[str, Column]) -> Column:
    """The text of a role; null if the variant leaves it empty.

    variant: Columns ``emptied`` (boolean), ``replacement`` (text or null), ``expired`` (boolean), ``expired_days`` (int or
    null). A replacement comes first; expiration dates follow the clock and the defect, a signature's date the clock.
    """
    late = F.coalesce(F.date_sub(filing, variant["expired_days"]), F.when(F.coalesce(variant["expired"], F.lit(False)), expired_until).otherwise(valid_until))
    plain = F.when(F.coalesce(date_kind == "expiration", F.lit(False)), format_date(late, date_format)).when(role == "signature_date", format_date(filing, date_format)).otherwise(value)
    return F.when(~F.coalesce(variant["emptied"], F.lit(False)), F.coalesce(variant["replacement"], plain))


def placed(value: Column, fields: Column, most: Column) -> Column:
    """A map of field to text: over several fields the parts between marks, in one field the whole, without marks and cut if it is too long.

    fields: array of field ids; most: map of field id to its longest text. Fields beyond the parts are left out.
    """
    bare = lambda v: F.regexp_replace(v, "[^0-9A-Za-z]", "")
    parts = F.split(value, "[^0-9A-Za-z]+")
    limit = F.try_element_at(most, F.get(fields, F.lit(0)))
    one = F.when(F.length(value) > limit, F.substring(bare(value), F.lit(1), limit)).otherwise(value)
    n = F.least(F.size(fields), F.size(parts))
    return F.when(F.size(fields) > 1, F.map_from_arrays(F.slice(fields, 1, n), F.slice(parts, 1, n))).otherwise(F.map_from_arrays(F.slice(fields, 1, 1), F.array(one)))


def wrapped(text: Column, width: int) -> Column:
    """Lines of whole words, each as long as the width allows; a longer word is a line of its own."""
    empty = F.array().cast("array<string>")

    def add(lines: Column, word: Column) -> Column:
        last = F.coalesce(F.get(lines, F.size(lines) - 1), F.lit(""))
        longer = F.trim(F.concat(last, F.lit(" "), word))
        fits = (F.length(longer) <= width) | (last == "")
        return F.when(F.size(lines) == 0, F.array(word)).when(fits, F.concat(F.slice(lines, 1, F.greatest(F.lit(0), F.size(lines) - 1)), F.array(longer))).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(F.split(text, " "), empty, add)
