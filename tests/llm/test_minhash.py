import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from logloom.llm import minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BINS, SHIFT, TOP = 256, 55, (1 << 63) - 1


def hash_of(*values):
    """xxhash64 of Spark over longs or one string: each value's hash is the next one's seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", (v + (1 << 63)) % (1 << 64) - (1 << 63)), h)
    return h


def plain(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [hash_of(w.decode()) for w in lowered.encode().split()]
    if not words:
        return []
    grams = {hash_of(*words[i : i + 5]) & TOP for i in range(max(1, len(words) - 4))}
    mins = [None] * BINS
    for g in grams:
        b = g >> SHIFT
        mins[b] = g if mins[b] is None else min(mins[b], g)
    out = []
    for i, m in enumerate(mins):
        if m is None:
            factor, offset = hash_of(i, 1) & (BINS - 1) | 1, hash_of(i, 2) & (BINS - 1)
            j = 0
            while mins[(factor * j + offset) % BINS] is None:
                j += 1
            m = hash_of(mins[(factor * j + offset) % BINS], i)
        out.append(m & 255)
    return out


def texts():
    rng = random.Random(3)
    out = ["", " \n", "One", "one two three four", "A b\x0bC d e", "é É x y z w v"]
    return out + [" ".join(rng.choices("abcdefghijklmnop", k=n)) for n in (5, 6, 12, 60, 300, 2000)] + ["same words " * 500]


def test_fingerprints_match_brute_force(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*texts(), None])]
    got = minhash.fingerprints(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {r[0]: bytes(plain(r[1])).hex() for r in rows}


def test_likeness_is_near_jaccard(spark):
    rng = random.Random(8)
    rows = []
    for share in (0.0, 0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 1.0):
        for n in (40, 150, 1200):
            a = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            cut = int(n * share)
            b = a[:cut] + [f"v{rng.randrange(10**9)}" for _ in range(n - cut)]
            x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
            rows.append((" ".join(a), " ".join(b), len(x & y) / len(x | y)))
    df = spark.createDataFrame(rows, "a string, b string, j double").select(minhash.fingerprint_bins(F.col("a")).alias("a"), minhash.fingerprint_bins(F.col("b")).alias("b"), "j")
    errors = [r.e - r.j for r in df.select("j", minhash.likeness(F.col("a"), F.col("b")).alias("e")).collect()]
    assert max(map(abs, errors)) < 0.12 and abs(sum(errors) / len(errors)) < 0.02


def plain_neighbours(rows):
    out, n = [], len(rows)
    for k, (number, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % n][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = plain(text), plain(edited), plain(following)

        def near(x, y):
            if not x or not y:
                return float(x == y)
            share = sum(p == q for p, q in zip(x, y)) / BINS
            return max(0.0, (share - 1 / 256) / (255 / 256))

        out.append((number, len(text), hashlib.sha256(edited.encode()).hexdigest(), bytes(a).hex(), bytes(b).hex(), near(a, b), near(a, c)))
    return out


@pytest.mark.parametrize("count", [1, 2, 7, 90])
def test_neighbours_match_brute_force(spark, count):
    rng = random.Random(count)
    ids = sorted(rng.sample(range(-50, 10_000), count))
    rows = [(i, rng.choice([*texts(), None, "ñ😀 " * 7])) for i in ids]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rng.sample(rows, count)], DOCS).withColumn("next_text", F.lit("clash")).withColumn("bins", F.lit(1))
    got = sorted(tuple(r) for r in minhash.neighbours(docs).collect())
    want = plain_neighbours(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:]) for w in want]


def test_neighbours_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a", None, None, None), (1, "b", None, None, None), (1, "b", None, None, None), (2, None, None, None, None)], DOCS)
    got = minhash.neighbours(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == [(False, 0, 1), (True, 1, 1), (True, 1, 1), (True, 2, 0)]
    assert minhash.neighbours(spark.createDataFrame([], DOCS)).count() == 0


def test_main_path_has_no_python(spark):
    plan = minhash.neighbours(spark.createDataFrame([(1, "a", "", "", 0)], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
