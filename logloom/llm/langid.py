"""Language identification with string kernels.

Two texts are compared by the blended-spectrum presence kernel: how many distinct character n-grams of 1 to `longest` characters they share,
over the root of the product of how many each has. A Nystroem approximation represents every text by its kernel with a few landmark texts, and
one-versus-rest kernel ridge regression in that space gives a weight vector per language. Scoring is one matrix product over a batch: n-gram
presence (rows of texts) by weights (columns of languages), as the kernel with the landmarks is linear in presence.

The landmarks and the fitting rows are bounded samples, taken by hash and evenly from the languages; both bounds are parameters. Spark sums the Gram
matrix over the sample, and the driver solves one system of landmarks x landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, id_crc32, partitions, read, sample_keys, stored

LONGEST, BUCKET_BITS = 3, 17
LANDMARKS, FIT_ROWS, RIDGE = 192, 2400, 1e-3
LETTER = regex.compile(r"\p{L}")
#: Odd multipliers that mix a gram of each length into a bucket (any odd numbers would do).
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint64)


def gram_buckets(text: str, longest: int = LONGEST, bits: int = BUCKET_BITS) -> np.ndarray:
    """The distinct n-grams (1 to longest characters) of a whole text in lower case, white space as one space, as hash buckets, sorted."""
    code = np.frombuffer(" ".join(["", *text.lower().split(), ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    seen = np.zeros(1 << bits, bool)
    rolled = np.zeros(len(code), np.uint64)
    for n in range(longest):
        if len(code) <= n:
            break
        rolled = rolled[: len(code) - n] * np.uint64(1_000_003) + code[n:] + np.uint64(1)
        seen[(rolled * MIX[n % len(MIX)] >> np.uint64(17)) & np.uint64((1 << bits) - 1)] = True
    return np.flatnonzero(seen)


@dataclass
class KernelModel:
    """labels; each bucket's row of weights (row 0, of zeros, where no landmark has the n-gram); weights, a column for each label."""

    labels: list[str]
    index: np.ndarray
    weights: np.ndarray
    longest: int
    bits: int

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and score of each text; und and 0 for one that is null or has no letter."""
        at = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)]
        labels, scores = ["und"] * len(texts), np.zeros(len(texts))
        if at and self.labels:
            found = [gram_buckets(texts[i], self.longest, self.bits) for i in at]
            sizes = np.array([len(b) for b in found])
            # a batch of presence rows times the weights: the rows are sparse, so the product adds up the weights of the buckets present
            sums = np.add.reduceat(self.weights[self.index[np.concatenate(found)]], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
            values = sums / np.sqrt(sizes)[:, None]
            best = values.argmax(axis=1)
            sure = np.clip((values[np.arange(len(at)), best] + 1) / 2, 0.0, 1.0)
            for k, i in enumerate(at):
                labels[i] = self.labels[best[k]]
                scores[i] = sure[k]
        return labels, scores


def fit(labelled: DataFrame, landmarks: int = LANDMARKS, rows: int = FIT_ROWS, longest: int = LONGEST, bits: int = BUCKET_BITS, ridge: float = RIDGE) -> KernelModel:
    """Fit on labelled (text, label): up to `rows` texts, of which up to `landmarks` are landmarks, both shared evenly by the labels.

    Rows with null text or label or without a letter teach nothing. Sampled texts count once however often they are repeated. No rows give a
    model that answers und. Labels are languages: their number is taken to be small.
    """
    spark = labelled.sparkSession
    usable = labelled.where(F.col("text").rlike(r"\p{L}") & F.col("label").isNotNull()).select("text", "label", F.xxhash64("text").alias("key"))
    labels = sorted(r["label"] for r in usable.select("label").distinct().collect())
    index = np.zeros(1 << bits, np.int32)
    if not labels:
        return KernelModel([], index, np.zeros((1, 0)), longest, bits)
    keys = stored(sample_keys(usable, "label", "key", max(2, rows // len(labels))), "langid_keys")  # at most `rows` rows
    chosen = usable.join(F.broadcast(keys), ["label", "key"]).groupBy("label", "key").agg(F.min("text").alias("text"))
    chosen = stored(chosen.repartition(min(16, partitions(spark)), "key"), "langid_sample")
    each = Window.partitionBy("label").orderBy("key")
    few = max(1, landmarks // len(labels))
    marks = [r["text"] for r in chosen.withColumn("n", F.row_number().over(each)).where(F.col("n") <= few).orderBy("label", "key").collect()]  # at most `landmarks`
    found = [gram_buckets(t, longest, bits) for t in marks]
    known = np.unique(np.concatenate(found))
    index[known] = np.arange(1, len(known) + 1)  # row 0 is for n-grams that no landmark has
    present = np.zeros((len(known) + 1, len(marks)), np.float32)
    for k, grams in enumerate(found):
        present[index[grams], k] = 1 / np.sqrt(len(grams))

    def against(texts: list[str]) -> np.ndarray:
        out = []
        for text in texts:
            grams = gram_buckets(text, longest, bits)
            out.append(present[index[grams]].sum(axis=0, dtype=np.float64) / np.sqrt(len(grams)))
        return np.array(out)

    shared = spark.sparkContext.broadcast((index, present))  # at most buckets x landmarks: a bounded size

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """This task's part of kernel' kernel and kernel' targets, one row for each landmark."""
        (index, present), gram, goal = shared.value, np.zeros((len(marks), len(marks))), np.zeros((len(marks), len(labels)))
        for batch in batches:
            rows_ = []
            for text in batch["text"]:
                buckets = gram_buckets(text, longest, bits)
                rows_.append(present[index[buckets]].sum(axis=0, dtype=np.float64) / np.sqrt(len(buckets)))
            if rows_:
                kernel, target = np.array(rows_), np.where(batch["label"].to_numpy()[:, None] == np.array(labels)[None, :], 1.0, -1.0)
                gram += kernel.T @ kernel
                goal += kernel.T @ target
        yield pd.DataFrame({"k": range(len(marks)), "v": list(np.hstack([gram, goal]))})

    parts = chosen.mapInPandas(sums, "k int, v array<double>").select("k", F.posexplode("v").alias("j", "v")).groupBy("k", "j").agg(F.sum("v").alias("v")).collect()
    shared.destroy()
    total = np.zeros((len(marks), len(marks) + len(labels)))
    for r in parts:  # landmarks x (landmarks + languages) numbers
        total[r["k"], r["j"]] = r["v"]
    gram, goal = total[:, : len(marks)], total[:, len(marks) :]
    within = against(marks)
    count = chosen.count()
    # Nystroem: features are kernel @ within^(-1/2); ridge regression in them, folded back into weights over landmarks
    values, vectors = np.linalg.eigh((within + within.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    solved = np.linalg.solve(root @ gram @ root + ridge * count * np.eye(len(marks)), root @ goal)
    return KernelModel(labels, index, present @ (root @ solved), longest, bits)


def identify(docs: DataFrame, model: KernelModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score. A null text or one without a letter is `und` with score 0. Whole texts are read, however long."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages: a fixed size

    @F.pandas_udf("lang_pred string, score double")
    def decide(values: pd.Series) -> pd.DataFrame:
        labels, scores = [], []
        for i in range(0, len(values), 64):
            a, b = shared.value.decide([t if isinstance(t, str) else None for t in values.iloc[i : i + 64]])
            labels += a
            scores.append(b)
        return pd.DataFrame({"lang_pred": labels, "score": np.concatenate(scores) if scores else np.empty(0)})

    return bounded_batches(docs).withColumn("__found", decide(F.col(f"`{text}`"))).withColumns({"lang_pred": F.col("__found.lang_pred"), "score": F.col("__found.score")}).drop("__found")


def held_out(doc_id: Column) -> Column:
    """The third of the ids that fitting never sees."""
    return id_crc32(doc_id) % 3 == 1


def fit_documents(docs: DataFrame) -> KernelModel:
    """The model of a documents table: its rows that aren't held out and have a lang teach."""
    return fit(docs.where(~held_out(F.col("doc_id"))).select("text", F.col("lang").alias("label")))


def op7_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit_documents(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
