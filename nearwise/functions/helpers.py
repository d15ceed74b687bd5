"""Small scalar helpers as column expressions."""

from __future__ import annotations

import logging
import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(v: Column) -> Column:
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))


def round_half_up_from_zero(v: Column) -> Column:
    """Towards zero, but up from a half on: negative values always go towards zero."""
    whole = truncated(v)
    return F.when(v < whole + F.lit(0.5), whole).otherwise(F.ceil(v))


def ceil_text(s: Column) -> Column:
    """Of a decimal number as text: one above its floor unless the first decimal is 0 or missing."""
    first = F.substring(F.substring_index(s, ".", -1), 1, 1)
    plain = (F.instr(s, ".") == 0) | (first == "") | (first == "0")
    return F.floor(s.cast("double")) + F.when(plain, 0).otherwise(1)


def abs_diff(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def log_base(n: Column, base: Column) -> Column:
    return F.ln(n) / F.ln(base)


def in_sorted(values: Column, v: Column) -> Column:
    return F.array_contains(values, v)


def truth_text(b: Column) -> Column:
    return F.when(b, "T").otherwise("F")


def is_truth_text(s: Column) -> Column:
    return F.upper(F.substring(s, 1, 1)).isin("T", "Y")


def null_or_empty(*values: Column) -> Column:
    """Whether all texts are null or empty."""
    return reduce(lambda a, b: a & b, [v.isNull() | (F.length(v) == 0) for v in values])


def null_or_empty_array(v: Column) -> Column:
    return v.isNull() | (F.size(v) == 0)


def before_point(s: Column) -> Column:
    return F.substring_index(s, ".", 1)


def nth_index(s: Column, part: str, n: int, start: int = 0) -> Column:
    """Place (from 0) of the n-th occurrence, overlaps included, from `start` on; -1 if there are fewer."""
    at = F.locate(part, s, start + 1)
    for _ in range(n - 1):
        at = F.when(at == 0, 0).otherwise(F.when(F.locate(part, F.substring(s, at + 1, F.length(s))) == 0, 0).otherwise(at + F.locate(part, F.substring(s, at + 1, F.length(s)))))
    return at - 1


def bytes_of(s: Column) -> Column:
    """'4G' and '4GB' -> 4 * 10^9: units B, K, M, G of any case, in powers of 1000; digits alone are bytes."""
    number = F.regexp_extract(s, r"^(\d+)", 1).cast("long")
    unit = F.upper(F.regexp_extract(s, r"^\d+([A-Za-z]?)", 1))
    scale = F.when(unit.isin("", "B"), F.lit(1).cast("long")).when(unit == "K", F.lit(1000).cast("long")).when(unit == "M", F.lit(1000000).cast("long")).when(unit == "G", F.lit(1000000000).cast("long"))
    return F.when(scale.isNull(), F.raise_error(F.concat(F.lit("unknown unit: "), s)).cast("long")).otherwise(number * scale)


def random_output_dir(base: str, draw: Callable[[int], int] = random.randrange) -> str:
    """A folder below `base` that a number from 0 to 998 names."""
    return f"{base if base.endswith('/') else base + '/'}{draw(999)}"


def log_if(on: bool, source: object, message: Callable[[], object]) -> None:
    """The message, which is only made if `on`, to the log of the source's class."""
    if on:
        logging.getLogger(type(source).__qualname__).info("%s", message())
