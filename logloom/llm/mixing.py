"""Mixing sources to target weights by entropy balancing.

Every document has a rate, the number of times that the mix should take it. Among all rates that meet the sources' word targets, entropy balancing
picks those nearest to one in relative entropy, which are exponentially tilted: rate = min(limit, exp(lambda * size / mean size))
with one lambda to a source. The lambdas solve a convex dual; Newton's iterations on it are Spark jobs over the histogram of sizes, with a bracket around
each lambda for steps that would leave it. The rates are then rounded into whole copies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rank_within, read, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, LIMIT = (3.0, 1.0, 2.0), 1.5, 2
#: A source is solved when its words are within this part of the target; no more iterations than this are made.
TOLERANCE, ITERATIONS = 1e-9, 60
SOURCE = ["__no_source", "__source"]


def words(text: Column) -> Column:
    """Words of a whole text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sources: DataFrame, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """Add `target` to sources (source_size, weight): share of all words by weight, at most limit times a source's size.

    What a source can't take is dealt out again by weight until none is above its cap. Each round is one aggregation; the driver
    gets its few sums.
    """
    cap = F.col("source_size") * float(limit)
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level >= cap
        n, used, weight = sources.agg(F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not weight:
            break
        level, capped = (total - (used or 0.0)) / weight, n
    return sources.withColumn("target", F.least(F.col("weight") * level, cap))


def tilts(sizes: DataFrame, sources: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add `tilt` (lambda) to sources: distributed Newton iterations on the dual, over the histogram sizes (source, size, n).

    A source whose target is its cap has no finite lambda and gets infinity: all its rates are the limit. One without words gets 0.
    """
    key = [*SOURCE]
    mean = F.when(F.col("source_size") > 0, F.col("source_size") / F.col("docs")).otherwise(1.0)
    at_cap = F.col("target") >= F.col("source_size") * (limit * (1 - 1e-12))
    start = F.when(F.col("source_size") == 0, 0.0).when(at_cap, float("inf")).otherwise(0.0)
    state = stored(sources.withColumn("mean", mean).withColumn("tilt", start).withColumn("low", F.lit(-math.inf)).withColumn("high", F.lit(math.inf)).withColumn("done", (F.col("source_size") == 0) | at_cap), "tilts")
    for _ in range(ITERATIONS):
        if not state.where("not done").take(1):
            break
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(limit)), F.exp(F.least(F.col("tilt") * x, F.lit(50.0))))
        sums = (
            sizes.join(state.where("not done").select(*key, "tilt", "mean"), key)
            .withColumn("words", F.col("n") * F.col("size") * rate)
            .groupBy(*key)
            .agg(F.sum("words").alias("now"), F.sum(F.when(rate < limit, F.col("words") * x).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("now") - F.col("target")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        moved = state.join(sums, key, "left").withColumn("low", low).withColumn("high", high)
        newton = F.col("tilt") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        middle = F.when(F.col("low") == -math.inf, F.col("high") * 2 - 1).when(F.col("high") == math.inf, F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        inside = (newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - F.col("tilt")) < 4)
        solved = F.abs(gap) <= F.col("target") * TOLERANCE
        moved = moved.withColumn("__done", F.col("done") | solved | (F.col("high") - F.col("low") < 1e-13))
        state = stored(moved.withColumn("tilt", F.when(F.col("__done"), F.col("tilt")).when(inside, newton).otherwise(middle)).withColumn("done", F.col("__done")).select(state.columns), "tilts")
    return state.drop("low", "high", "done")


def copies_by_size(sizes: DataFrame, tilted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add `copies` to the histogram: how many copies the n documents of one source and size have between them.

    Rates are rounded along falling sizes, so that the sum of copies is never off by one or more; what words are then missing from the target
    or above it is made up by whole copies, longest first. A group is one source's histogram, a row for each size.
    """

    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False).reset_index(drop=True)
        size, n, target = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), float(group["target"].iloc[0])
        with np.errstate(invalid="ignore", over="ignore"):
            tilt = np.where(size > 0, float(group["tilt"].iloc[0]) * (size / group["mean"].iloc[0]), 0.0)
        rate = np.minimum(limit, np.exp(np.minimum(tilt, 50.0)))
        edges = np.floor(np.r_[0.0, np.cumsum(n * rate)] + 0.5).astype(np.int64)
        copies = np.clip(np.diff(edges), 0, limit * n)
        gap = round(target) - int((copies * size).sum())
        for i in np.flatnonzero(size):
            step = min(gap // int(size[i]), int(limit * n[i] - copies[i])) if gap > 0 else -min(-gap // int(size[i]), int(copies[i]))
            copies[i] += step
            gap -= step * int(size[i])
        return group.assign(copies=copies)[[*SOURCE, "size", "n", "copies", "source_size", "target"]]

    shape = "__no_source boolean, __source string, size long, n long, copies long, source_size long, target double"
    return sizes.join(tilted.select(*SOURCE, "target", "source_size", "tilt", "mean"), SOURCE).groupBy(*SOURCE).applyInPandas(rounded, shape)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """Columns of docs but the text, plus size, source_size, target, copies and taken (= copies x size).

    docs has doc_id, text, source. Sources by code point, null last, weigh `weights`, repeating. Null and empty texts have size 0 and keep
    one copy, as their rate is one. Equal rows are counted one by one. No row exceeds `limit` copies. Reruns agree: places come from doc_id,
    then the text's hash. No rows give no rows. Columns of docs that clash with the added ones are replaced.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    sized = docs.withColumns({"size": words(F.col("text")), "__no_source": F.col("source").isNull(), "__source": F.coalesce("source", F.lit("")), "__hash": F.xxhash64("text")})
    ranked = stored(rank_within(sized.drop("text"), [*SOURCE, "size"], ["doc_id", "__hash"], "__rank"), "ranked")
    sizes = stored(ranked.groupBy(*SOURCE, "size").agg(F.count("*").alias("n")), "sizes")
    sources = sizes.groupBy(*SOURCE).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    placed = rank_within(sources.withColumn("__all", F.lit(0)), ["__all"], SOURCE, "__place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = placed.withColumn("weight", cycle[(F.col("__place") % len(weights)).cast("int")])
    tilted = tilts(sizes, stored(capped_targets(weighed, share, limit), "targets"), limit)
    dealt = stored(copies_by_size(sizes, tilted, limit), "copies")
    out = ranked.drop(*[c for c in added if c != "size"]).join(dealt, [*SOURCE, "size"])
    own = F.expr("((__rank + 1) * copies) div n - (__rank * copies) div n")  # equal sizes share their copies evenly
    out = out.withColumn("copies", own).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[f"`{c}`" for c in docs.columns if c not in [*added, "text"]], *added)


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """The mix itself: each row of docs as often as its copies say, with the columns of docs."""
    numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    taken = stored(mix(numbered.select("__row", "doc_id", "source", "text"), weights, share, limit).where("copies > 0").select("__row", F.col("copies").cast("int").alias("__copies")), "taken")
    # a row for each document: joined by a shuffle at any size, never broadcast
    out = numbered.join(taken.hint("merge"), "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.select(*[f"`{c}`" for c in docs.columns])


def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
