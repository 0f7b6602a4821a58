"""Matches of a regular expression with their places in code points, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dietlens.functions.text import let

_BLOCK = 64


def running_sums(values: Column) -> Column:
    """Sum of each value and all before it (longs). Blocks of _BLOCK are summed first, so long lists stay cheap."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a + b)

    def within(block: Column) -> Column:
        return F.transform(block, lambda _, i: total(F.slice(block, F.lit(1), i + 1)))

    def stitched(blocks: Column) -> Column:
        def add(totals: Column) -> Column:
            return F.flatten(F.transform(blocks, lambda block, k: let(
                total(F.slice(totals, F.lit(1), k)), lambda before: F.transform(within(block), lambda x: x + before)
            )))

        return let(F.transform(blocks, total), add)

    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))
    cut = F.transform(starts, lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    return F.when(F.size(values) == 0, values).otherwise(let(cut, stitched))


def find_all(text: Column, pattern: str, context: int = 0) -> Column:
    """The leftmost non-overlapping matches as an array of (start, end, text); `pattern` must not match the empty string.

    `split` gives what lies between the matches; the lengths of both, summed up, give the places. The end is exclusive. None
    for a null text. With `context` also before and after: so many characters at most beside the match and up to the next one.
    """

    def placed(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, gap: F.length(m).cast("long") + F.length(gap))

        def spans(ends: Column) -> Column:
            def span(m: Column, k: Column) -> Column:
                end = F.get(ends, k)
                fields = [(end - F.length(m)).alias("start"), end.alias("end"), m.alias("text")]
                if context:
                    fields += [F.right(F.get(gaps, k), F.lit(context)).alias("before"), F.left(F.get(gaps, k + 1), F.lit(context)).alias("after")]
                return F.struct(*fields)

            return F.transform(found, span)

        return let(running_sums(steps), spans)

    none = F.array().cast(f"array<struct<start:bigint,end:bigint,text:string{',before:string,after:string' if context else ''}>>")
    matches = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return let(matches, lambda found: F.when(F.size(found) == 0, none).otherwise(
        let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps))
    ))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def passes_luhn(number: Column) -> Column:
    """Whether a string of ASCII digits has a right Luhn check digit."""
    values = F.transform(F.split(F.reverse(number), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))

    def add(total: Column, pair: Column) -> Column:
        doubled = pair["d"] * 2
        return total + F.when(pair["i"] % 2 == 0, pair["d"]).when(doubled > 9, doubled - 9).otherwise(doubled)

    pairs = F.transform(F.filter(values, lambda d: d.isNotNull()), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), add) % 10 == 0


def listed(spans: Column) -> Column:
    """`kind:start:end` of an array of (kind, rank, start, end), by start, rank, end; comma-joined."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end")))
