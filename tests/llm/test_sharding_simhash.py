import random
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from logloom.llm import components, sharding, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def jump(key, shards):
    """The published loop, one key at a time."""
    b, j = -1, 0
    key &= (1 << 64) - 1
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_loop():
    keys = [0, 1, 2, 17, -1, 2**63 - 1, *random.Random(3).sample(range(10**12), 500)]
    for shards in (1, 2, 8, 9, 1000):
        got = sharding.jump_hash(np.array(keys, np.int64).view(np.uint64), shards)
        assert got.tolist() == [jump(k, shards) for k in keys]


def test_shard_contract(spark):
    rows = [(i, "é" * (i % 7), "en", "s", 0) for i in range(400)] + [(None, None, None, None, None), (5, "", "x", None, 1), (5, "", "x", None, 1)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit("clash")), 8).toPandas()
    assert len(got) == len(rows) and set(got.law) == {"key"}
    for number, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert (got.grown_shard[got.grown_shard != got["shard"]] == 8).all()
    one = got[got.doc_id == 9].iloc[0]
    assert (one["size"], one.text_crc32, one["shard"]) == (5, zlib.crc32("éé".encode()), jump(9, 8))
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0


def test_write_shards(spark, tmp_path):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert {(d, s) for d, s in zip(back.doc_id, back["shard"])} == {(d, jump(d, 4)) for d in range(50)}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min(groups[find(k)]) for k, i in enumerate(ids)}


def test_fingerprints_match_the_plain_sum():
    texts = ["", None, " \t\n", "One", "one TWO", "Äa b\x0bc d", "x " * 400, *(" ".join(random.Random(i).choices("abcdefgh", k=i)) for i in range(1, 200, 7))]
    assert simhash.fingerprint_bytes(texts).tolist() == [plain_fingerprint(t) for t in texts]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        words = [rng.choice("abcdefghijkl") * rng.randint(1, 3) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(len(words))] = "edit"
    texts += ["", None, "  "]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(rng.sample(texts, len(texts)))]
    want = plain_components([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows])
    for crowd in (2048, 3):
        got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), crowd=crowd).toPandas()
        assert dict(zip(got.doc_id, got.component_id)) == want
        assert dict(zip(got.doc_id, got.fingerprint)) == {r[0]: f"{plain_fingerprint(r[1]):016x}" for r in rows}
    kept = simhash.deduplicate(spark.createDataFrame(rows, DOCS))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_links_of_a_dense_ball(spark):
    """Thousands of prints around one centre, far over the crowd limit: the same components as all pairs give."""
    rng = np.random.default_rng(1)
    centre = np.uint64(0x123456789ABCDEF0)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(900)]
    prints = np.unique(np.array([int(centre) ^ f for f in flips], np.uint64))
    want = plain_components(prints.tolist(), prints.tolist())
    df = spark.createDataFrame(pd.DataFrame({"fingerprint_bits": prints.view(np.int64)}))
    groups = lambda roots: sorted(tuple(sorted(k for k in roots if roots[k] == r)) for r in set(roots.values()))
    for crowd in (4, 60):
        roots = {int(x): int(x) for x in prints.view(np.int64)} | {r.node: r.root for r in components.connected_components(simhash.links(df, crowd)).collect()}
        assert sorted(tuple(sorted(x % 2**64 for x in g)) for g in groups(roots)) == groups(want)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 201), (200, 201)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_and_null_tables(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, None, None, None, None), (None, "a b c", None, None, None), (3, "a b c", None, None, None), (3, "a b c", None, None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).toPandas()
    assert got.component_id.isna().sum() == 1 and (got.component_id.dropna() == 3).all() and len(got) == 4
