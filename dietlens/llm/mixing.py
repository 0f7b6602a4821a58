"""Mixing sources to target weights by entropy balancing.

Each source gets a token target. Among all rates per document that meet it and stay within MOST, those nearest to 1 in relative
entropy are exp(lambda * size), cut at MOST: one dual variable per source, found by Newton steps over a histogram of sizes that
stay within a bracket. The rates are then rounded to whole copies, so that the tokens taken follow the running sum of the rates.

All sums are exact (integers), so order of execution cannot change a result and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dietlens.llm.common import count_words, hot_limit, identified, join_counted, quoted
from dietlens.operators.keys import add_row_id
from dietlens.session import BROADCAST_ROWS, materialize

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents of a source that are rounded in one run, in the mean.
RUN = 4096
#: Newton steps at most, and the share of the target by which the expected tokens may miss it.
STEPS, NEAR = 60, 1e-7
_GRAIN = 1 << 20  # rates are summed in units of 1 / _GRAIN


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source_key, n_docs, tokens, target, full) of each source; full: its target is `most` times its tokens.

    Sources in code point order, null last, have the weights in turn and share all tokens. What a target would have beyond
    `most` times its source's tokens is shared among the rest by weight, until none is above.
    """
    sources = sizes.groupBy("source_key").agg(F.count("*").alias("n_docs"), F.sum("size").alias("tokens"))
    sources = add_row_id(sources.withColumn("last", F.col("source_key") == "null"), ["last", "source_key"], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", weight.cast("long")), "sources")
    exact = "decimal(38,0)"
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    above, share, weighed = F.lit(False), 0, 1
    n_full = -1
    while True:  # the share per weight only grows, so each round adds full sources or is the last
        n, full_tokens, weighed = sources.agg(
            F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, F.col("tokens"))), F.lit(0)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == n_full or not weighed:
            break
        n_full, share = n, total - most * full_tokens
        above = F.lit(most).cast(exact) * F.col("tokens") * F.lit(weighed).cast(exact) <= F.col("weight").cast(exact) * F.lit(share).cast(exact)
    target = F.when(above, (most * F.col("tokens")).cast("double"))
    if weighed:
        target = target.otherwise(F.col("weight") * F.lit(float(share)) / F.lit(float(weighed)))
    return sources.select("source_key", "place", "n_docs", "tokens", target.alias("target"), above.alias("full"))


def _rate(tilt: Column, size: Column, mean: Column, most: int) -> Column:
    """exp(tilt * size / mean), cut at `most`; the exponent is cut first, as exp overflows."""
    return F.when(F.isnull(tilt), F.lit(float(most))).otherwise(F.least(F.exp(F.least(tilt * size / mean, F.lit(20.0))), F.lit(float(most))))


def solve(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """`targets` with mean and tilt: the dual variable of each source, null if its target is full or it has no tokens.

    A Newton step is a groupBy over the histogram (source, size, n). A step that leaves the bracket of its source is replaced by
    the middle of the bracket, and without a bracket by a bounded step.
    """
    histogram = sizes.filter("size > 0").groupBy("source_key", "size").agg(F.count("*").alias("n"))
    histogram = materialize(histogram, "histogram")
    mean = F.col("tokens") / F.greatest(F.col("n_docs"), F.lit(1)).cast("double")
    targets = targets.withColumn("mean", F.when(F.col("tokens") > 0, mean).otherwise(F.lit(1.0)))
    none = F.lit(None).cast("double")
    state = materialize(targets.filter(~F.col("full") & (F.col("tokens") > 0)).select(
        "source_key", "mean", "target", F.lit(0.0).alias("tilt"), none.alias("low"), none.alias("high")
    ), "tilts")
    few = state.count() <= BROADCAST_ROWS
    for _ in range(STEPS):
        rows = histogram.join(F.broadcast(state) if few else state, "source_key")
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), most)
        units = F.round(rate * _GRAIN).cast("long")
        taken = (units * F.col("size")).cast("decimal(38,0)") * F.col("n")
        slope = F.round(F.when(rate < most, rate * F.col("size") / F.col("mean") * _GRAIN).otherwise(0.0)).cast("long")
        slope = (slope * F.col("size")).cast("decimal(38,0)") * F.col("n")
        sums = rows.groupBy("source_key").agg(
            (F.sum(taken).cast("double") / _GRAIN).alias("taken"), (F.sum(slope).cast("double") / _GRAIN).alias("slope")
        )
        step = state.join(sums, "source_key").withColumn("miss", F.col("taken") - F.col("target"))
        low = F.when(F.col("miss") <= 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("miss") >= 0, F.col("tilt")).otherwise(F.col("high"))
        step = step.withColumns({"low": low, "high": high})
        newton = F.when(F.col("slope") > 0, F.col("tilt") - F.col("miss") / F.col("slope"))
        inside = (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        middle = (F.col("low") + F.col("high")) / 2
        far = F.when(F.col("miss") < 0, F.col("tilt") + 1 + F.abs("tilt")).otherwise(F.col("tilt") - 1 - F.abs("tilt"))
        bounded = F.abs(newton - F.col("tilt")) <= 1 + F.abs("tilt")
        best = F.when(F.abs("miss") <= F.lit(NEAR) * F.col("target"), F.col("tilt"))
        best = best.when(inside & (bounded | middle.isNotNull()), newton).otherwise(F.coalesce(middle, far))
        near = F.abs("miss") <= F.lit(NEAR) * F.col("target")
        state = materialize(step.select("source_key", "mean", "target", best.alias("tilt"), "low", "high", near.alias("near")), "tilts")
        if state.filter("not near").isEmpty():
            break
        state = state.drop("near")
    return materialize(targets.join(state.select("source_key", "tilt"), "source_key", "left"), "solved")


def _diffuse(carried: Sequence[str], most: int):
    """Copies of the rows of each run, in descending size: the tokens taken follow the running sum of the rates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, wanted, taken = None, 0.0, 0
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            runs = zip(*(column[c].to_pylist() for c in ("place", "run", "part", "size", "rate")), strict=True)
            copies = np.empty(batch.num_rows, np.int64)
            for i, (place, number, part, size, rate) in enumerate(runs):
                if at != (place, number, part):
                    at, wanted, taken = (place, number, part), 0.0, 0
                wanted += rate * size
                least = int(rate)
                # One copy beside the rate's neighbours at most, so that small documents make up for what large ones leave over.
                copy = round((wanted - taken) / size) if size else least
                copy = max(0, least - 1, min(most, least + 2, copy))
                copies[i] = copy
                taken += copy * size
            yield pa.RecordBatch.from_arrays([*[column[c] for c in carried], pa.array(copies)], names=[*carried, "copies"])

    return run


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """Per row: `id_col`, the `keep` columns, size, source_size, target, rate, copies, taken.

    A null text has size 0; a null source is a source of its own, the last. Rows of size 0 get one copy, or `most` in a full
    source, and take nothing. Repeated rows are mixed like different ones. An empty table gives an empty table. Texts of any length
    are counted whole. Other columns are not read, whatever their names; `keep` must not name what is returned. Rounding runs
    over about RUN rows of a source at a time, in descending size, so what is left over is below the size of a small document per run.
    """
    docs, row = identified(docs)
    carried = list(dict.fromkeys([id_col, *keep, *row]))
    key = F.when(F.col(source_col).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    sizes = docs.select(*carried, key.alias("source_key"), count_words(F.col(text_col)).alias("size"))
    sizes = materialize(sizes, "sizes")
    n = sizes.count()
    solved = solve(sizes, source_targets(sizes, weights, most), most)
    rate = F.when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean"), most))
    order = F.xxhash64(id_col, "size")
    rated = join_counted(sizes, solved, ["source_key"], "n_docs", n).withColumns({
        "rate": rate, "order": order, "run": F.pmod(order, F.ceil(F.col("n_docs") / RUN)).cast("int"),
    })
    rated = materialize(rated.select(*carried, "size", F.col("tokens").alias("source_size"), "target", "place", "rate", "order", "run"), "rated")
    # Runs that repeated ids make large are dealt out by row; they are at most 1 / HOT_SHARE.
    large = rated.groupBy("place", "run").agg(F.count("*").alias("n")).filter(F.col("n") > max(4 * RUN, hot_limit(n)))
    parts = large.select("place", "run", F.ceil(F.col("n") / RUN).alias("parts"))
    dealt = rated.join(F.broadcast(parts), ["place", "run"], "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64(*row), F.col("parts")), F.lit(0)).cast("int")
    ).drop("parts")
    dealt = dealt.repartition("place", "run", "part").sortWithinPartitions(
        "place", "run", "part", F.desc("size"), "order", id_col, *row
    )
    out = [*carried, "size", "source_size", "target", "rate"]
    schema = T.StructType([dealt.schema[c] for c in out]).add("copies", "long")
    mixed = dealt.mapInArrow(_diffuse(out, most), schema)
    return mixed.select(id_col, *keep, "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """Each row of `docs` as often as the mix takes it, with all its columns; see `mix`."""
    whole, row = identified(docs)
    taken = mix(whole, id_col, text_col, source_col, row, **settings).filter("copies > 0").select(*row, "copies")
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return whole.join(taken.select(*row, again.alias("copy")), row).select(*[quoted(c) for c in docs.columns])
