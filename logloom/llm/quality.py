"""A quality classifier learnt from preferences: Bradley-Terry pairwise ranking.

Every document has a strength, a weighted sum of features of its whole text. That document i is preferred to document j has the probability
1 / (1 + exp(strength j - strength i)), so the weights come from a logistic loss on feature differences over pairs of a preferred and a rejected document.
The threshold is a quantile of the strengths: below it lies the share of documents that the labels reject. Scores map it to `cut`.

All labelled documents are paired, and the threshold is an exact quantile of all their strengths. Pairs are made by an equality join, Newton's
iterations sum their gradient and curvature with Spark, and the quantile is found by counts in ever narrower bins.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, id_crc32, partitions, rank_within, read, sample_keys, stored

PARTNERS, RIDGE, ITERATIONS, CUT = 6, 1e-3, 12, 0.3
#: Bins of one pass that looks for a quantile.
BINS = 4096
FEATURES = ("length", "words", "upper", "digit", "symbol", "space", "lines", "word_length", "new_words", "top_word", "echo", "new_lines", "shout", "wordless", "ends", "same_symbol")

#: The class of each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 plain punctuation, 5 symbol, 6 space, 7 part of a non-ASCII character.
BYTE_CLASS = np.full(256, 0, np.uint8)
for _name, _bytes in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b".,;:?'\"()-"), (5, b"!#$%&*+/<=>@[\\]^_`{|}~"), (6, b" \t\n\r\x0b\x0c"), (7, bytes(range(128, 256)))):
    BYTE_CLASS[list(_bytes)] = _name


def features(text: str | None) -> list[float]:
    """FEATURES of one whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(BYTE_CLASS, weights=bytes_, minlength=8)
    n, words, lines = max(1, len(raw)), raw.split(), raw.split(b"\n")
    many = max(1, len(words))
    counts = Counter(words)
    letters, symbols = max(1.0, kinds[1] + kinds[2] + kinds[7]), bytes_[list(b"!#$%&*+/<=>@[\\]^_`{|}~")]
    return [
        math.log1p(len(raw)),
        math.log1p(len(words)),
        kinds[2] / letters,
        kinds[3] / n,
        kinds[5] / n,
        kinds[6] / n,
        math.log1p(len(lines)) / math.log(2 + many),
        min(40.0, len(raw) / many),
        len(counts) / many,
        max(counts.values(), default=0) / many,
        sum(a == b for a, b in zip(words, words[1:])) / many,
        len(set(lines)) / len(lines),
        sum(w.isupper() and len(w) > 1 for w in words) / many,
        sum(not w[0] > 64 for w in words) / many,
        kinds[4] / many,
        float(symbols.max()) / many,
    ]


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with column features, array<double>."""

    @F.pandas_udf("array<double>")
    def extract(values: pd.Series) -> pd.Series:
        return pd.Series([features(t if isinstance(t, str) else None) for t in values], dtype=object)

    return bounded_batches(docs).withColumn("features", extract(F.col(f"`{text}`")))


@dataclass
class Ranking:
    """weights of standardised features, their centre and scale, and the threshold of strengths."""

    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    threshold: float

    def strengths(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.centre) / self.scale, -8, 8) @ self.weights

    def scores(self, rows: list, cut: float) -> pd.Series:
        if not rows:
            return pd.Series([], dtype=float)
        odds = self.strengths(np.array(rows)) - self.threshold + math.log(cut / (1 - cut))
        return pd.Series(1 / (1 + np.exp(-np.clip(odds, -60, 60))))


def pairs(chosen: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """(better, worse) feature arrays: every document of either label is in at least one pair, if the other label has any.

    Each document of label 1 meets `partners` of label 0, or more where that many don't reach all of label 0.
    """
    numbered = rank_within(chosen.withColumn("__order", F.xxhash64("doc_id")), ["label"], ["__order", "doc_id"], "place")
    good, bad = numbered.where("label = 1"), numbered.where("label = 0")
    counts = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return good.select(F.col("features").alias("better"), F.col("features").alias("worse")).limit(0)
    each = max(partners, -(-counts[0] // counts[1]))
    place = F.pmod(F.col("place") * each + F.col("k"), F.lit(counts[0])).alias("place")
    meet = good.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(each - 1)))).select(F.col("features").alias("better"), place)
    return meet.join(bad.select("place", F.col("features").alias("worse")).hint("merge"), "place").select("better", "worse")


def fit(labelled: DataFrame, docs: DataFrame, each: int | None = None, partners: int = PARTNERS, ridge: float = RIDGE) -> Ranking:
    """Fit on labelled (doc_id, label 0 or 1) and docs (doc_id, text), with all labelled documents, or up to `each` of either label.

    Rows with a null id or label teach nothing. Without pairs all weights are 0.
    """
    return fit_features(labelled, with_features(docs.select("doc_id", "text")), each, partners, ridge)


def fit_features(labelled: DataFrame, docs: DataFrame, each: int | None = None, partners: int = PARTNERS, ridge: float = RIDGE) -> Ranking:
    """As fit, on docs (doc_id, features)."""
    spark, width = docs.sparkSession, len(FEATURES)
    known = labelled.where(F.col("label").isin(0, 1)).select("label", "doc_id").distinct()
    ids = stored(known.where("doc_id is not null") if each is None else sample_keys(known, "label", "doc_id", each), "quality_ids")
    # texts stay in place at any size: only features meet the labels
    chosen = stored(docs.select("doc_id", "features").join(ids.hint("merge"), "doc_id").select("doc_id", "label", "features").repartition(partitions(spark)), "quality_docs")
    stats = chosen.select(F.posexplode("features").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    centre, scale = np.zeros(width), np.ones(width)
    for r in stats:
        centre[r["k"]], scale[r["k"]] = r["m"], max(r["s"] or 0.0, 1e-6)
    ranking = Ranking(np.zeros(width), centre, scale, 0.0)
    met = stored(pairs(chosen, partners), "quality_pairs")

    def sums(weights: np.ndarray):
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, unit = np.zeros((width, width + 1)), Ranking(np.eye(width), centre, scale, 0.0)
            count = 0
            for batch in batches:
                if len(batch):
                    gaps = unit.strengths(np.stack(batch["better"])) - unit.strengths(np.stack(batch["worse"]))
                    wrong = 1 / (1 + np.exp(gaps @ weights))  # the probability that the pair goes the other way
                    total[:, 0] += gaps.T @ wrong
                    total[:, 1:] += (gaps * (wrong * (1 - wrong))[:, None]).T @ gaps
                    count += len(batch)
            if count:
                yield pd.DataFrame({"n": [count], "v": [total.ravel()]})

        return part

    for _ in range(ITERATIONS):
        parts = met.mapInPandas(sums(ranking.weights), "n long, v array<double>").select("n", F.posexplode("v").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
        if not parts:
            break
        total = np.zeros(width * (width + 1))
        for r in parts:  # features x (features + 1) numbers
            total[r["j"]] = r["v"]
        total, count = total.reshape(width, width + 1), parts[0]["n"]
        step = np.linalg.solve(total[:, 1:] + ridge * count * np.eye(width), total[:, 0] - ridge * count * ranking.weights)
        ranking.weights = ranking.weights + step
        if np.abs(step).max() < 1e-4:
            break
    ranking.threshold = quantile_threshold(chosen, ranking)
    return ranking


def at_ranks(values: DataFrame, ranks: list[int]) -> list[float]:
    """The values (column s, double) at these ranks from 0, exactly: each pass counts the values of a range in BINS bins and goes on with the bin of the rank."""

    def one(rank: int) -> float:
        low, high, before = *values.agg(F.min("s"), F.max("s")).first(), 0
        while low < high:
            bin_ = F.least(F.floor((F.col("s") - F.lit(low)) / F.lit((high - low) / BINS)), F.lit(BINS - 1)).alias("bin")
            for r in values.where(F.col("s").between(low, high)).groupBy(bin_).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("bin").collect():
                if before + r["n"] > rank:
                    break
                before += r["n"]
            low, high = r["low"], r["high"]
        return low

    return [one(r) for r in ranks]


def quantile_threshold(chosen: DataFrame, ranking: Ranking) -> float:
    """The quantile of strengths below which lies label 0's share of the labelled documents.

    It lies in the middle between the quantiles just below and just above that share (3 % of either label away), and so between the labels where
    strengths part them.
    """

    @F.pandas_udf("double")
    def strength(values: pd.Series) -> pd.Series:
        return pd.Series(ranking.strengths(np.stack(values)) if len(values) else [], dtype=float)

    counts = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return 0.0
    last, share = sum(counts.values()) - 1, counts[0] / sum(counts.values())
    places = [last * q for q in (max(0.0, share * 0.97), min(1.0, share + 0.03 * (1 - share)))]
    whole = [math.floor(x) for x in places]
    found = at_ranks(stored(chosen.select(strength("features").alias("s")), "quality_strengths"), [*whole, *(min(last, k + 1) for k in whole)])
    low, high = (found[i] + (found[i + 2] - found[i]) * (places[i] - whole[i]) for i in range(2))
    return (low + high) / 2


def score(docs: DataFrame, ranking: Ranking, cut: float = CUT, text: str = "text") -> DataFrame:
    """docs with score and predicted (1 if score >= cut): null and empty texts are scored like any other text. The threshold's score is `cut`."""

    @F.pandas_udf("double")
    def place(values: pd.Series) -> pd.Series:
        return ranking.scores([features(t if isinstance(t, str) else None) for t in values], cut)

    return bounded_batches(docs).withColumn("score", place(F.col(f"`{text}`"))).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def score_features(docs: DataFrame, ranking: Ranking, cut: float = CUT) -> DataFrame:
    """As score, on docs with column features."""

    @F.pandas_udf("double")
    def place(values: pd.Series) -> pd.Series:
        return ranking.scores(list(values), cut)

    return docs.withColumn("score", place("features")).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def held_out(doc_id: Column) -> Column:
    """The fifth of the ids whose labels fitting never sees."""
    return id_crc32(doc_id) % 5 == 0


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(with_features(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "features"), "quality_features")
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    return score_features(docs, fit_features(labels, docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
