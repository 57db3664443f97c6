"""Places of regular expressions in a text, as Column expressions whose time grows with the number of matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPANS = "array<struct<start:int,end:int,value:string>>"
#: An array that grows element by element is copied each time, so none grows beyond this.
BLOCK, LEVELS = 64, 3


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def before(values: Column, zero: int, combine: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """For each element what combining ``zero`` and all elements before it gives (sums, largest so far).

    Blocks of ``BLOCK`` elements are combined one by one, then the results of the blocks
    in the same way, so the work is in proportion to the elements.
    """
    def grown(part: Column) -> Column:
        return F.aggregate(part, F.array(F.lit(zero)), lambda done, x: F.concat(
            done, F.array(combine(F.element_at(done, -1), x))))

    if levels == 1:
        return F.slice(grown(values), 1, F.size(values))

    def of_blocks(blocks: Column) -> Column:
        results = F.transform(blocks, lambda b: F.element_at(b, -1))
        return let(before(results, zero, combine, levels - 1), lambda first: F.flatten(F.zip_with(
            blocks, first, lambda b, x: F.transform(F.slice(b, 1, F.size(b) - 1), lambda v: combine(x, v)))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
                         lambda i: grown(F.slice(values, i * BLOCK + 1, BLOCK)))
    return F.when(F.size(values) <= BLOCK, F.slice(grown(values), 1, F.size(values))).otherwise(let(blocks, of_blocks))


def spans(text: Column, pattern: Column | str, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches with their places in code points, end exclusive.

    What lies between the matches comes from a split by the same pattern; the lengths
    add up to the places. The pattern must not match empty text.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(whole: Column) -> Column:
        values = F.regexp_extract_all(text, pattern, F.lit(value_group)) if value_group else whole
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
        parts = F.zip_with(F.zip_with(gaps, whole, lambda gap, match: F.struct(
            F.char_length(gap).alias("gap"), F.char_length(match).alias("length"))), values,
            lambda part, value: F.struct(part["gap"].alias("gap"), part["length"].alias("length"), value.alias("value")))
        return let(parts, added)

    def added(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: p["gap"] + p["length"])
        return let(lengths, lambda own: F.zip_with(parts, before(own, 0, lambda a, b: a + b), lambda p, at: F.struct(
            (at + p["gap"]).alias("start"), (at + p["gap"] + p["length"]).alias("end"), p["value"].alias("value"))))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda whole: F.when(
        F.size(whole) > 0, placed(whole)).otherwise(no_spans()))


def no_spans() -> Column:
    return F.array().cast(_SPANS)


def spans_if(gate: Column, text: Column, pattern: Column | str, value_group: int = 0) -> Column:
    """The matches where a cheaper test lets the text through, else none."""
    return F.when(gate, spans(text, pattern, value_group)).otherwise(no_spans())
