"""SimHash near-duplicates found through deletion-variant signatures.

The 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in 3 bits or fewer, one of their segments
differs in at most one bit; with that bit deleted the segments are equal. So every distinct fingerprint is indexed under
its 2 x 32 one-wildcard variants, rows meet on equal variants, and pairs that meet are verified bit by bit. A set of
fingerprints that meets under one variant gives a spanning forest of its links, never all its pairs. A set of more than `crowd`
is not compared as a whole: its members are cut further, into halves of the other segment under one-wildcard variants, which leaves
18 free bits, so that no set can outgrow a task whatever the corpus holds.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, read, stored
from .components import connected_components

BITS, SEGMENTS, DISTANCE = 64, 2, 3
#: Fingerprints under one variant that are compared in one go; more are cut further.
CROWD = 2048


def fingerprint_bytes(texts: list[str | None], width: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of each whole text over its word shingles; a bit is set if over half the shingle hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    digest, weights = xxhash.xxh64_intdigest, 1 << np.arange(8, dtype=np.uint64)
    bit_of = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: max(0, len(words) - width)].tolist()]
        stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        n = len(hashes)
        if n < 64:
            counts = np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0)
        else:
            counts = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ bit_of for k in range(8)])
        bits = (2 * counts > n).reshape(8, 8).astype(np.uint64) @ weights
        out[i] = np.frombuffer(bits.astype(np.uint8).tobytes(), "<u8")[0]
    return out


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """Columns of docs with column fingerprint_bits (long) added. Null and blank texts have fingerprint zero."""

    @F.pandas_udf("long")
    def simhash(values: pd.Series) -> pd.Series:
        return pd.Series(fingerprint_bytes([x if isinstance(x, str) else None for x in values], width, seed).view(np.int64))

    return bounded_batches(docs).withColumn("fingerprint_bits", simhash(F.col(f"`{text}`")))


def variants(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) of each fingerprint's 64 one-wildcard segment variants."""
    keys = []
    for segment in range(SEGMENTS):
        part = (prints >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
        for bit in range(32):
            keys.append((part & ~np.uint64(1 << bit)) | np.uint64(segment << 32 | bit << 33))
    return np.concatenate(keys), np.tile(prints, len(keys))


def finer(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, second key, fingerprint): the other segment cut into two halves, one of which differs by one bit at most."""
    other = np.where(keys >> np.uint64(32) & np.uint64(1), prints & np.uint64(0xFFFFFFFF), prints >> np.uint64(32))
    second = []
    for half in range(2):
        part = (other >> np.uint64(16 * half)) & np.uint64(0xFFFF)
        second += [(part & ~np.uint64(1 << bit)) | np.uint64(half << 16 | bit << 17) for bit in range(16)]
    return np.tile(keys, 32), np.concatenate(second), np.tile(prints, 32)


def forest(prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join prints exactly as all pairs within the distance do, at most one for each print."""
    left, a, b = prints, [], []
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue.append(left[0])
            left = left[1:]
        pivot = queue.pop()
        near = np.bitwise_count(left ^ pivot) <= distance
        if near.any():
            found = left[near]
            a.append(found)
            b.append(np.full(len(found), pivot))
            queue.extend(found)
            left = left[~near]
    empty = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _meet(columns: int, crowd: int | None):
    """For mapInPandas over rows of `columns` key columns, by which they are sorted, and a print: links, and the members of crowded sets (b null).

    A set may span batches, so a batch's last set is held back until its end is seen; no more than `crowd` rows are held.
    """

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, crowded = np.empty((0, columns + 1), np.uint64), None  # an unfinished set; the key of one already passed on as crowded
        for batch in itertools.chain(batches, [None]):
            rows = held if batch is None else np.concatenate([held, np.ascontiguousarray(batch.to_numpy(np.int64)).view(np.uint64)])
            held = rows[:0]
            if not len(rows):
                continue
            edges = np.flatnonzero((rows[1:, :columns] != rows[:-1, :columns]).any(axis=1)) + 1
            starts, stops = np.r_[0, edges], np.r_[edges, len(rows)]
            members, a, b = [], [], []
            if crowd and crowded is not None and (rows[0, :columns] == crowded).all():
                members.append(rows[: stops[0]])
                starts, stops = starts[1:], stops[1:]
            if batch is not None and len(starts):
                if not crowd or stops[-1] - starts[-1] <= crowd:
                    held = rows[starts[-1] :]
                    starts, stops = starts[:-1], stops[:-1]
                else:
                    crowded = rows[-1, :columns].copy()
            sizes = stops - starts
            two = starts[sizes == 2]
            near = np.bitwise_count(rows[two, columns] ^ rows[two + 1, columns]) <= DISTANCE
            a.append(rows[two, columns][near]), b.append(rows[two + 1, columns][near])
            for i, k in zip(starts[sizes > 2], stops[sizes > 2], strict=True):
                if crowd and k - i > crowd:
                    members.append(rows[i:k])
                else:
                    x, y = forest(rows[i:k, columns])
                    a.append(x), b.append(y)
            for rest in members:
                yield pd.DataFrame({"key": rest[:, 0].view(np.int64), "a": rest[:, columns].view(np.int64), "b": pd.array([None] * len(rest), "Int64")})
            x, y = np.concatenate(a), np.concatenate(b)
            if len(x):
                yield pd.DataFrame({"key": 0, "a": x.view(np.int64), "b": y.view(np.int64)}).drop_duplicates()

    return groups


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) longs that connect distinct fingerprints (column fingerprint_bits) as all pairs within 3 bits do."""
    spark = prints.sparkSession

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key, print_ = variants(batch["fingerprint_bits"].to_numpy(np.int64).view(np.uint64))
            yield pd.DataFrame({"key": key.view(np.int64), "a": print_.view(np.int64)})

    def index_finer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key, second, print_ = finer(batch["key"].to_numpy(np.int64).view(np.uint64), batch["a"].to_numpy(np.int64).view(np.uint64))
            yield pd.DataFrame({"key": key.view(np.int64), "second": second.view(np.int64), "a": print_.view(np.int64)})

    shape = "key long, a long, b long"
    met = prints.select("fingerprint_bits").mapInPandas(index, "key long, a long").repartition(partitions(spark), "key").sortWithinPartitions("key")
    met = stored(met.mapInPandas(_meet(1, crowd), shape), "met")
    rest = met.where("b is null").mapInPandas(index_finer, "key long, second long, a long")
    rest = rest.repartition(partitions(spark), "key", "second").sortWithinPartitions("key", "second").mapInPandas(_meet(2, None), shape)
    return met.where("b is not null").union(rest).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Fingerprints link at 3 differing bits or fewer; component_id is the smallest id reachable, over any chain of links. Null and blank
    texts have fingerprint zero and link like any other. Null ids are kept; a component of null ids alone has a null component_id.
    Repeated rows stay repeated. An empty table gives an empty table. Other columns of docs are left out.
    """
    printed = stored(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))).drop("text"), "prints")
    each = stored(printed.groupBy("fingerprint_bits").agg(F.min("doc_id").alias("least")), "each")
    roots = connected_components(links(each, crowd))
    rooted = each.join(roots, each.fingerprint_bits == roots.node, "left").select("fingerprint_bits", "least", F.coalesce("root", "fingerprint_bits").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = stored(rooted.join(least, "root").select("fingerprint_bits", "component_id"), "component")
    return printed.join(component, "fingerprint_bits").select("doc_id", F.lower(F.lpad(F.hex("fingerprint_bits"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component: one document of each group, with all its columns.

    Rows with a null id are kept, as nothing tells them apart; so are all rows that share a kept id.
    """
    found = near_duplicates(docs, doc_id, text)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    # the ids that go are as many as the corpus makes them: joined by a shuffle at any size, never broadcast
    return docs.join(gone.hint("merge"), F.col(f"`{doc_id}`") == F.col("__gone"), "left_anti")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
