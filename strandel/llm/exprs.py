"""Column expressions shared by the operators that stay inside Spark SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
_STEP = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once a row."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sum_of(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def sums_before(lengths: Column) -> Column:
    """For each entry of an array of long the sum of those before it, in two levels of bounded cost."""

    def within(blocks: Column, all_: Column) -> Column:
        return F.transform(all_, lambda _, k: blocks[F.floor(k / _STEP).cast("int")] + sum_of(F.slice(all_, (F.floor(k / _STEP) * _STEP + 1).cast("int"), (k % _STEP).cast("int"))))

    def levels(all_: Column) -> Column:
        number = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(all_) - 1) / _STEP).cast("int")))
        own = F.transform(number, lambda b: sum_of(F.slice(all_, b * _STEP + 1, _STEP)))
        return let(own, lambda o: let(F.transform(o, lambda _, b: sum_of(F.slice(o, 1, b))), lambda blocks: within(blocks, all_)))

    return let(lengths, levels)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points.

    The parts between matches and the matches themselves give the places by their lengths.
    """

    def place(found: Column, parts: Column) -> Column:
        gaps = F.zip_with(parts, found, lambda p, m: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
        return let(sums_before(gaps), lambda before: F.transform(found, lambda m, k: let(before[k] + F.length(parts[k]), lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))))

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda parts: place(found, parts))))
