import itertools
import os
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom import plans
from logloom.operators import MODES, Remap, assemble, unnest_rows
from logloom.functions import coerce
from logloom.sources import from_lines, read_lines, stream_lines, to_json_lines, write_json
from logloom.sources.sinks import for_each_batch
from logloom.streaming import assemble_stream
from logloom.streaming.multiline import feed

SMALL = "/root/testdata/sf0.001"
LINES = ["[2021-01-01] start", "    at foo()", "    at bar()", "[2021-01-02] next", "    at baz()"]


def plain_records(lines, pattern, mode):
    """A line at a time, as an assembler with one buffer does it."""
    buffer, out = None, []
    for line in lines:
        hit = bool(re.search(pattern, line))
        if mode == "halt_before" and hit and buffer is not None:
            out.append(buffer)
            buffer = None
        buffer = line if not buffer else buffer + "\n" + line
        if mode == "halt_with" and hit or mode.startswith("continue") and not hit:
            out.append(buffer)
            buffer = None
    return out + ([buffer] if buffer is not None else [])


def streams():
    rng = random.Random(7)
    return {f"s{k}": [rng.choice(["[x] a", "  b", "", "c]"]) for _ in range(rng.randrange(1, 25))] for k in range(12)} | {"golden": LINES}


@pytest.mark.parametrize("mode", MODES)
def test_assemble_is_the_buffer(spark, mode):
    rows = [(k, i, line) for k, lines in streams().items() for i, line in enumerate(lines)]
    got = {}
    for r in sorted(assemble(spark.createDataFrame(rows, "stream_id string, seq long, line string").repartition(5), r"^\[", mode).collect(), key=lambda r: (r.stream_id, r.record_no)):
        got.setdefault(r.stream_id, []).append(r.record)
    assert got == {k: plain_records(lines, r"^\[", mode) for k, lines in streams().items()}


@pytest.mark.parametrize("mode", MODES)
def test_feed_is_the_buffer(mode):
    for lines in streams().values():
        buffer, out = None, []
        for line in lines:
            buffer, done = feed(buffer, line, line.startswith("["), mode)
            out += done
        assert out + ([buffer] if buffer is not None else []) == plain_records(lines, r"^\[", mode)


def test_stream_keeps_open_records_between_batches(spark, tmp_path):
    folder = tmp_path / "in"
    for k, part in enumerate(([0, 1], [2, 3, 4], [5])):
        lines = [*LINES, "[2021-01-03] last"]
        spark.createDataFrame([("a", i, lines[i]) for i in part], "stream_id string, seq long, line string").coalesce(1).write.mode("append").json(str(folder))
        time.sleep(0.05)
    stream = spark.readStream.schema("stream_id string, seq long, line string").option("maxFilesPerTrigger", 1).json(str(folder))
    out = assemble_stream(stream, r"^\[", "halt_before").writeStream.format("memory").queryName("assembled").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        out.processAllAvailable()
    finally:
        out.stop()
    rows = sorted(spark.table("assembled").collect(), key=lambda r: r.record_no)
    assert [r.record for r in rows] == plain_records(LINES, r"^\[", "halt_before")


def test_remap_program(spark):
    events = spark.createDataFrame([("1", "yes"), ("x", "no"), ("3", "drop")], "message string, kind string")
    out = (
        Remap(events).abort_if(F.col("kind") == "drop").assign_or("v", "err", coerce.to_int(F.col("message"))).assign("a.b.c", F.lit(True)).branch(F.col("kind") == "yes", "ok", F.lit(True), F.lit(False))
        .drop("kind").events
    )
    rows = {r.message: r for r in out.collect()}
    assert set(rows) == {"1", "x"} and rows["1"].v == 1 and rows["1"].err is None and rows["x"].v is None and rows["x"].err
    assert rows["1"].a.b.c is True and rows["1"].ok is True and rows["x"].ok is False and "kind" not in out.columns
    kept = Remap(events).assign_must("n", coerce.to_int(F.col("message"))).events
    assert [r.n for r in kept.collect()] == [1, 3]
    assert Remap(events).keep_root(F.struct(F.lit(1).alias("only"))).events.columns == ["only"]


def test_abort_reaches_the_scan(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    plan = plans.QUERIES["remap_events"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "event_type" in plan.partition("PushedFilters")[2] and "user_id" not in plan.partition("ReadSchema")[2]


def test_unnest(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "i int, x array<string>")
    assert [(r.i, r.x) for r in unnest_rows(df, "x").collect()] == [(1, "a"), (1, "b")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\ntwo\n")
    events = read_lines(spark, str(tmp_path / "in"), "file")
    assert [r.json for r in to_json_lines(events).collect()] == ['{"message":"one","source_type":"file"}', '{"message":"two","source_type":"file"}']
    write_json(events, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert from_lines(spark.createDataFrame([(b"x",)], "value binary")).first().message == "x"
    seen = []
    query = for_each_batch(stream_lines(spark, str(tmp_path / "in")), lambda df, k: seen.append(sorted(r.message for r in df.collect())), str(tmp_path / "at"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert list(itertools.chain(*seen)) == ["one", "two"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    found, df = con.sql(plans.ORACLE_SQL[name]), plans.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    want = sorted(tuple(shown(r[found.columns.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_queries_without_sql(spark):
    assert set(plans.QUERIES) - set(plans.ORACLE_SQL) == {"fn_hashes", "fn_ip_ciphers", "random_columns"}
    rows = plans.QUERIES["fn_ip_ciphers"](spark, SMALL).collect()
    assert all(r.ip == r.decrypted != r.encrypted and r.same for r in rows)
    import hashlib

    import xxhash

    for r in plans.QUERIES["fn_hashes"](spark, SMALL).collect():
        name = f"Customer#{r.c_custkey:09}".encode()
        assert r.sha3 == hashlib.sha3_512(name).hexdigest() and r.sha512_256 == hashlib.new("sha512_256", name).hexdigest()
        assert r.xx % 2**64 == xxhash.xxh64_intdigest(name, 0)
    assert all(5 <= r.whole < 9 and 1 <= r.part < 2 and r.bytes == 12 for r in plans.QUERIES["random_columns"](spark, SMALL).collect())
