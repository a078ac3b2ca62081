"""Near-duplicates by SimHash and deletion variants, verified by the similarity of whole texts: Jaccard of their distinct word shingles.

Texts of one shingle set are one node. A node's print is a SimHash of 1,728 bits, cut into 72 segments of 24; nodes meet where a segment differs in at
most one bit. At Jaccard 0.8 prints differ in 15.2 % of their bits, a segment in at most one with probability 0.102, so 0.04 % of such pairs don't meet
(computed), of closer pairs fewer. One half of such a segment is equal: nodes are dealt out by each half of each segment, and within a
half the other one's 12 deletion variants are compared. Pairs that meet and whose prints can belong to texts that similar are verified on the whole sets.

Of the nodes that meet in one half, each is first compared with the nearest before it, by print, which leaves few components. After that only
nodes in different components are compared, all of them whose prints and parities are near enough: no pair that meets across components stays uncompared.

A few segments are indexed before the others. Nodes that meet a crowd there go to that comparison whatever the other segments show, so these no longer tell
of them or pair them with each other, and that comparison too begins with the early segments: what they link isn't compared in the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import bounded_batches, partitions, stored
from .components import connected_components

WIDTH, SEED = 5, 42
SEGMENTS, HALF = 72, 12
WORDS = SEGMENTS * 2 * HALF // 64
#: Differing bits that a pair to verify may have, of the print's first 128 and of 512: five deviations over what Jaccard 0.8 gives (sets of 4 and 5
#: shingles: four, as their bits differ more often).
NEAR_FIRST, NEAR = 44, 131
#: Bits of a set's parities; pairs that a node begins with.
PARITIES, BEGIN = 1024, 4
#: Nodes under one variant of which the prints of all pairs are looked at in the first turn.
CROWD = 16
#: Segments that are indexed first.
EARLY = 6
#: Rows that a task compares at a time, and rows of a batch of index rows.
AT_ONCE = 1 << 15
_random = np.random.default_rng(SEED)
FLIP, MULTIPLY = _random.integers(0, 1 << 63, (2, WORDS), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
AGAIN = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct 64-bit hashes of a whole text's word shingles, sorted. A text of fewer words is one shingle; one without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: max(0, len(words) - width)].tolist()]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def print_of(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, 216 bytes: a bit is set if over half of the shingles have it. No shingles: zero."""
    counts = np.zeros(WORDS * 64, np.int64)
    for i in range(0, len(shingles), 255):  # as many as a byte counts
        mixed = (shingles[i : i + 255, None] ^ FLIP) * MULTIPLY
        mixed = (mixed ^ mixed >> np.uint64(32)) * AGAIN
        mixed ^= mixed >> np.uint64(29)
        counts += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(shingles))


def parities(shingles: np.ndarray) -> np.ndarray:
    """128 bytes: whether an odd number of the hashes falls on each of 1,024 places. Two sets' parities differ in no more places than the sets in hashes."""
    return np.packbits(np.bincount((shingles % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1)


@F.pandas_udf(StructType([StructField("node", LongType()), StructField("print", BinaryType()), StructField("size", LongType())]))
def _node_and_print(values: pd.Series) -> pd.DataFrame:
    nodes, prints, sizes = [], [], []
    for text in values:
        found = shingle_set(text if isinstance(text, str) else None)
        nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
        prints.append(print_of(found).tobytes() + parities(found).tobytes())
        sizes.append(len(found))
    return pd.DataFrame({"node": np.array(nodes, np.uint64).view(np.int64), "print": prints, "size": np.array(sizes, np.int64)})


@F.pandas_udf(ArrayType(LongType()))
def _shingles(values: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(text if isinstance(text, str) else None).view(np.int64) for text in values])


def alike(a: Column, b: Column) -> Column:
    """Whether the Jaccard similarity of two arrays of distinct values is 0.8 or more, in whole numbers."""
    both, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    near = F.least(F.size(a), F.size(b)) * 5 >= F.greatest(F.size(a), F.size(b)) * 4
    return F.when(near, both * 9 >= total * 4).otherwise(False)


@contextmanager
def _narrow_rows(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of many rows for as long as no texts go to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 10_000)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _halves(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, rest) of prints: each half of each segment, and the segment's other half."""
    number, three = np.arange(SEGMENTS, dtype=np.int64)[None, :] * 2, raw[:, : WORDS * 8].reshape(len(raw), SEGMENTS, 3).astype(np.int64)
    whole = three[:, :, 0] << 16 | three[:, :, 1] << 8 | three[:, :, 2]
    high, low = whole >> HALF, whole & (1 << HALF) - 1
    key = np.concatenate([number << HALF | high, number + 1 << HALF | low], axis=1).ravel()
    return key.astype(np.int32), np.concatenate([low, high], axis=1).ravel().astype(np.int32)


def _raw(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(rows, -1)


def _keys_of(early: bool) -> np.ndarray:
    """Places of the early segments' keys among those of a print, or of the others'."""
    return np.flatnonzero((np.arange(2 * SEGMENTS) % SEGMENTS < EARLY) == early)


def _index(batches: Iterator[pa.RecordBatch], early: bool) -> Iterator[pa.RecordBatch]:
    """(key, rest, c, d, node) of (node, print, known): the halves of the early segments or of the others, and the print's first 128 bits. A known
    node's rest has the bit above the half's set."""
    wanted = _keys_of(early)
    for batch in batches:
        nodes, known = batch.column("node").to_numpy(), batch.column("known").to_numpy(zero_copy_only=False)
        for i in range(0, len(nodes), 256):
            part = nodes[i : i + 256]
            raw = _raw(batch.column("print").slice(i, 256), len(part))
            key, rest = (x.reshape(len(part), -1)[:, wanted] for x in _halves(raw))
            rest = rest | known[i : i + 256, None].astype(np.int32) << HALF
            first = raw[:, :16].copy().view(np.int64)
            columns = [key.ravel(), rest.ravel(), *(np.repeat(x, len(wanted)) for x in (first[:, 0], first[:, 1], part))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "rest", "c", "d", "node"])


def _index_crowds(batches: Iterator[pa.RecordBatch], early: bool) -> Iterator[pa.RecordBatch]:
    """(key, node, root, size, bits) of (node, root, size, print): the keys of the early segments or of the others, 512 bits of the print and the parities."""
    wanted = _keys_of(early)
    for batch in batches:
        for i in range(0, len(batch), 64):
            part = batch.slice(i, 64)
            raw, each = _raw(part.column("print"), len(part)), len(wanted)
            bits = np.concatenate([raw[:, :64], raw[:, WORDS * 8 :]], axis=1)
            columns = [pa.array(_halves(raw)[0].reshape(len(part), -1)[:, wanted].ravel()), *(pa.array(np.repeat(part.column(x).to_numpy(), each)) for x in ("node", "root", "size"))]
            columns.append(pa.array([b for row in bits for b in [row.tobytes()] * each], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "root", "size", "bits"])


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of prints a against b, arrays of words in the last dimension, one number for each pair of the others."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1], np.uint16)
    for k in range(a.shape[-1]):
        out += np.bitwise_count(a[..., k] ^ b[..., k])
    return out


def _nearest_before(prints: np.ndarray) -> np.ndarray:
    """For each print but the first, the place of the one nearest to it among those before it."""
    out = []
    for i in range(1, len(prints), 256):
        far = _differing(prints[i : i + 256, None], prints[None, : i + 255])
        rows = np.arange(i, i + len(far))
        far[np.arange(far.shape[1])[None, :] >= rows[:, None]] = np.iinfo(np.uint16).max
        out.append(far.argmin(axis=1))
    return np.concatenate(out)


def _under_variants(key: np.ndarray, rest: np.ndarray, prints: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (a, b) of pairs to verify first of rows sorted by key, and the places of rows that have other pairs too. Known rows don't begin with each other."""
    known = np.zeros(len(key), bool) if known is None else known
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    bits = np.arange(HALF, dtype=np.int64)[:, None]
    code = ((group[None, :] * HALF + bits) << HALF | rest[None, :] & ~(1 << bits)).ravel()
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    sizes = np.diff(np.r_[starts, len(code)])
    at, of_run = order % len(key), np.repeat(sizes, sizes)
    a, b, crowded = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.zeros(len(key), bool)
    small = np.flatnonzero((of_run > 1) & (of_run <= CROWD))
    for d in range(1, CROWD):
        small = small[small + d < len(code)]
        small = small[code[small] == code[small + d]]
        if not len(small):
            break
        x, y = at[small], at[small + d]
        near = (_differing(prints[x], prints[y]) <= NEAR_FIRST) & ~(known[x] & known[y])
        a.append(np.maximum(x[near], y[near])), b.append(np.minimum(x[near], y[near]))
    for i in np.flatnonzero(sizes > CROWD):
        run = at[starts[i] : starts[i] + sizes[i]]
        if order[starts[i]] >= len(key) and (rest[run] == rest[run[0]]).all():
            continue  # the first bit's variant has them all
        crowded[run] = True
        run = np.sort(run)
        new = np.flatnonzero(~known[run[1:]])
        if len(new):
            a.append(run[1:][new]), b.append(run[_nearest_before(prints[run])][new])
    x, y = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    order = np.lexsort((_differing(prints[x], prints[y]), x))  # of each row's pairs with rows before it the nearest comes first
    first = np.r_[True, x[order][1:] != x[order][:-1]][: len(order)]
    later = order[~first]
    crowded[x[later]] = crowded[y[later]] = True
    return x[order[first]], y[order[first]], np.flatnonzero(crowded)


def _by_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables of about AT_ONCE that hold whole keys."""
    held: list[pa.RecordBatch] = []
    count, want = 0, AT_ONCE
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= want:
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            end = int(np.searchsorted(key, key[-1]))
            if end:
                yield table.slice(0, end)
                held, count = table.slice(end).combine_chunks().to_batches(), count - end
            want = max(AT_ONCE, 2 * count)  # a key that goes on isn't put together anew with every batch
    if count:
        yield pa.Table.from_batches(held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of index rows: pairs to verify first, and with a null b the nodes that meet others too, unless known."""
    told = np.empty(0, np.int64)
    for table in _by_groups(batches):
        key, rest, c, d, node = (table.column(x).to_numpy() for x in ("key", "rest", "c", "d", "node"))
        known, rest = rest >> HALF > 0, rest.astype(np.int64) & (1 << HALF) - 1
        a, b, crowd = _under_variants(key, rest, np.stack([c, d], axis=1).view(np.uint64), known)
        crowd = crowd[~known[crowd]]
        pairs = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], axis=1), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        if len(crowd):
            new = np.setdiff1d(node[crowd], told)
            told = new if len(told) > AT_ONCE else np.concatenate([told, new])
            yield pa.RecordBatch.from_arrays([pa.array(new), pa.nulls(len(new), pa.int64())], names=["a", "b"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of crowds (key, node, root, size, bits): all pairs of different roots that can be alike by sizes, parities and prints."""
    for table in _by_groups(batches):
        key, node, root, n = (table.column(x).to_numpy() for x in ("key", "node", "root", "size"))
        bits = _raw(table.column("bits"), len(key)).copy().view(np.uint64)
        prints, odd = bits[:, :8], bits[:, 8:]
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for i, k in zip(edges, edges[1:], strict=False):
            roots, size = np.unique(root[i:k], return_counts=True)
            rest = i + np.flatnonzero(root[i:k] != roots[size.argmax()])  # one side of each pair isn't of the largest
            for j in range(0, len(rest), 64):
                x = rest[j : j + 64]
                p, q = np.nonzero((_differing(prints[x, None], prints[None, i:k]) <= NEAR) & (root[x, None] != root[None, i:k]))
                x, y = x[p], i + q
                # alike sets of n and m shingles differ in (n + m) / 9 of them at most
                able = 9 * _differing(odd[x], odd[y]).astype(np.int64) <= n[x] + n[y]
                one, other = node[x[able]], node[y[able]]
                found = np.unique(np.stack([np.minimum(one, other), np.maximum(one, other)], axis=1), axis=0)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def components(printed: DataFrame) -> DataFrame:
    """(node, root) of the nodes that link with another, of stored rows (row, text, node, print, size)."""
    spark = printed.sparkSession
    each = stored(printed.groupBy("node").agg(F.min("row").alias("row"), F.any_value("print").alias("print"), F.any_value("size").alias("size")), "each")

    def meeting(nodes: DataFrame, early: bool, name: str) -> DataFrame:
        index = nodes.mapInArrow(partial(_index, early=early), "key int, rest int, c long, d long, node long")
        return stored(index.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(_meet, "a long, b long"), name)

    with _narrow_rows(spark):
        begun = meeting(each.select("node", "print", F.lit(False).alias("known")), True, "begun")
        known = begun.where("b is null").select(F.col("a").alias("node")).distinct().withColumn("known", F.lit(True))
        marked = each.join(known.hint("merge"), "node", "left").select("node", "print", F.coalesce("known", F.lit(False)).alias("known"))
        met = begun.union(meeting(marked, False, "met"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Those of stored pairs that link: the whole sets are read from the texts of nodes in any pair alone."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        rows = each.select("node", "row").join(ends.hint("merge"), "node")
        whole = stored(printed.select("row", "text").join(rows.hint("merge"), "row").select("node", _shingles("text").alias("s")), f"{name}_sets")
        one, two = whole.select(F.col("node").alias("a"), F.col("s").alias("sa")), whole.select(F.col("node").alias("b"), F.col("s").alias("sb"))
        return stored(pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(alike(F.col("sa"), F.col("sb"))).select("a", "b"), name)

    counted = met.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a")))
    ranked = stored(ranked, "ranked")
    links = verified(stored(ranked.where(F.col("place") <= BEGIN).select("a", "b"), "pairs"), "links")
    roots = stored(connected_components(links), "roots")
    later = ranked.where(F.col("place") > BEGIN).select(F.explode(F.array("a", "b")).alias("node"))
    crowd = stored(met.where("b is null").select(F.col("a").alias("node")).union(later).distinct(), "crowd")
    if crowd.isEmpty():
        return roots
    for early in (True, False):  # what the early segments join needn't be compared again
        rooted = crowd.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        shown = stored(rooted.join(each.hint("merge"), "node").select("node", "root", "size", "print"), "shown")
        with _narrow_rows(spark):
            shown = shown.mapInArrow(partial(_index_crowds, early=early), "key int, node long, root long, size long, bits binary")
            across = shown.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(_across, "a long, b long")
            across = stored(across.distinct(), "across")
        more = verified(across, "more_links")
        if not more.isEmpty():
            roots = stored(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "all_roots")
    return roots


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all columns of docs: the one with the least id (null ids last), of its repeats any one.

    Rows link if the Jaccard similarity of their 5-word shingles is 0.8 or more, over any chain of links. Texts without words are alike.
    """
    marked = bounded_batches(docs).withColumn("__made", _node_and_print(F.col(f"`{text}`"))).withColumn("__row", F.monotonically_increasing_id())
    rows = stored(marked, "shingled")
    node = F.col("__made.node").alias("node")
    printed = rows.select(F.col("__row").alias("row"), F.col(f"`{text}`").alias("text"), node, F.col("__made.print").alias("print"), F.col("__made.size").alias("size"))
    ids = rows.select(F.col("__row").alias("row"), node, F.col(f"`{doc_id}`").alias("id"))
    rooted = ids.join(components(printed).hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = stored(rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("least")).select(F.col("least.row").alias("__row")), "stay")
    return rows.join(stay.hint("merge"), "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
