"""Matches of a pattern with their places, and running totals, which Spark's own functions don't give.

`aggregate` copies an array whenever it appends to it, so a list of n entries built that way costs n * n. Here lists are
built in blocks of about the square root of n, and the blocks' own totals are carried on: n * sqrt(n) small copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.validators import let

#: Ordered as matches are: by start, longest first, then by kind.
MATCH = "struct<start:int,neg_length:int,kind_ord:int,value:string>"
MATCHES = f"array<{MATCH}>"


def no_matches() -> Column:
    return F.array().cast(MATCHES)


def in_blocks(values: Column, body: Callable[[Column], Column]) -> Column:
    """An array of body(block) for the blocks of an array that is not empty."""
    return let(F.ceil(F.sqrt(F.size(values))).cast("int"), lambda width: F.transform(F.sequence(F.lit(0), F.size(values) - 1, width), lambda i: body(F.slice(values, i + 1, width))))


def running(numbers: Column, merge: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """Of an int array that is not empty: for each entry the total of all up to it (or their greatest, ...)."""
    last = lambda a: F.get(a, F.size(a) - 1)
    step = lambda a, x: F.concat(a, F.array(F.when(F.size(a) == 0, x).otherwise(merge(last(a), x))))
    totals = lambda values: F.aggregate(values, F.array().cast("array<int>"), step)

    def joined(blocks: Column) -> Column:
        return let(totals(F.transform(blocks, last)), lambda upto: F.flatten(F.transform(blocks, lambda block, k: let(F.get(upto, k - 1), lambda before: F.when(before.isNull(), block).otherwise(F.transform(block, lambda x: merge(before, x)))))))

    return let(numbers, lambda n: let(in_blocks(n, totals), joined))


def located(text: Column, pattern: str, group: int = 0, neighbours: bool = False) -> Column:
    """All non-overlapping matches, left to right: array<struct<start, end, match, value>>; places are code points.

    Around n matches are n + 1 gaps, so places are running sums of both lengths. value is the group; one other than 0
    must end where the match does, and start is that of the group. neighbours: also the characters before and after, if any.
    """
    def places(m: Column, g: Column, v: Column, ends: Column) -> Column:
        def place(x: Column, i: Column) -> Column:
            value, end = F.get(v, i), F.get(ends, i)
            out = [(end - F.length(value)).alias("start"), end.alias("end"), x.alias("match"), value.alias("value")]
            if neighbours:
                # Where no character lies between two matches, the neighbour belongs to the other match.
                side = lambda gap, other, edge: F.when(gap != "", edge(gap, F.lit(1))).otherwise(F.coalesce(edge(other, F.lit(1)), F.lit("")))
                out += [side(F.get(g, i), F.get(m, i - 1), F.right).alias("before"), side(F.get(g, i + 1), F.get(m, i + 1), F.left).alias("after")]
            return F.struct(*out)

        return F.transform(m, place)

    sizes = lambda m, g: F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.length(x))
    every = lambda m, g, v: let(running(sizes(m, g)), lambda ends: places(m, g, v, ends))
    values = lambda m, g: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: every(m, g, v)) if group else every(m, g, m)
    none = F.array().cast(f"array<struct<start:int,end:int,match:string,value:string{',before:string,after:string' if neighbours else ''}>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda g: values(m, g))))


def find_all(text: Column, pattern: str, kind_ord: int, keep: Callable[[Column], Column] | None = None, group: int = 0, neighbours: bool = False) -> Column:
    """The matches of located() that keep() accepts. A match that is not kept has been consumed all the same."""
    found = located(text, pattern, group, neighbours)
    if keep:
        found = F.filter(found, keep)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), (x["start"] - x["end"]).alias("neg_length"), F.lit(kind_ord).alias("kind_ord"), x["value"].alias("value")))
