"""Inputs that once ended a query or lost rows."""

import pytest
from pyspark.sql import functions as F

from logloom.llm import common, mixing, pii, quality, sharding


def test_a_long_run_of_zeros_is_an_ip_part(spark):
    text = "at " + "0" * 5000 + "1.2.3.4 and " + "0" * 5000 + ".1.2.3 and " + "1" * 5000 + ".1.2.3"
    want = [("ip", 3, 5010), ("ip", 5015, 10021)]
    assert [s for s in pii.base_spans(text) if s[0] == "ip"] == want
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert [r.n_ip for r in pii.detect(docs, pii.Detector()).orderBy("doc_id").collect()] == [2, 0]


def test_a_mix_keeps_a_column_named_copies(spark):
    docs = spark.createDataFrame([(i, "one two three", "ab"[i % 2], "x" * i) for i in range(20)], "doc_id long, text string, source string, copies string")
    out = mixing.mixed_documents(docs).collect()
    assert out and all(r.copies == "x" * r.doc_id for r in out)


@pytest.mark.parametrize(("good", "bad"), [(5, 95), (95, 5), (7, 7), (0, 4), (4, 0)])
def test_every_labelled_document_is_in_a_pair(spark, good, bad):
    rows = [(i, int(i < good), [float(i)]) for i in range(good + bad)]
    met = quality.pairs(spark.createDataFrame(rows, "doc_id long, label int, features array<double>")).collect()
    assert all(r.better[0] < good <= r.worse[0] for r in met)
    seen = {r.better[0] for r in met} | {r.worse[0] for r in met}
    assert len(seen) == (good + bad if good and bad else 0)


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_shards_are_written_where_shard_puts_them(spark, tmp_path, kind):
    docs = spark.range(50).select(F.col("id").cast(kind).alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(docs, str(tmp_path / kind), 8)
    written = {str(r.doc_id): r.shard for r in spark.read.parquet(str(tmp_path / kind)).collect()}
    assert written == {str(r.doc_id): r.shard for r in sharding.shard(docs, 8).collect()}


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session)
