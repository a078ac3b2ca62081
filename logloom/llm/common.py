"""Shared helpers of the training-data operators: stored stages, ranks and text columns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"
#: Set where the session names no shared folder (tests on one machine).
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset and the master is local.

    Without one on a cluster this raises: executors would write where no other reads.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="spark-")
    return _own["dir"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage: what follows survives lost executors without computing df again, and sees one fixed copy of it.
    """
    path = f"{shared_folder(df.sparkSession)}/logloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(docs: DataFrame, rows: int = 256) -> DataFrame:
    """docs, with the session's Arrow batches held to `rows` rows: whole texts go to Python, and a batch of them has to fit beside others."""
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return docs


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unsigned(value: Column) -> Column:
    """An int column's 32 bits as an unsigned long."""
    return value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def utf8_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def id_crc32(doc_id: Column) -> Column:
    """crc32 of the id as text; the usual source of a stable split."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def rank_within(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add column `name`: the row's place from 0, gapless, among rows of equal `group` (columns without null) in `order`.

    A group may hold any share of the rows. The rows are dealt out by ranges of group and order together, so a hot group
    covers many partitions; each row gets its place in its own partition, and a small table with a row for each partition
    and group in it says how many rows of the group came before. Rows equal in group and order are placed in any order. A
    column `name` that df has is replaced.
    """
    keys, df = [*group, *order], df.drop(name)
    source = stored(df, f"{name}_in")
    part, at, first, count, before = (f"__{name}_{x}" for x in ("part", "at", "first", "count", "before"))
    dealt = source.repartitionByRange(partitions(df.sparkSession), *[F.col(f"`{k}`").asc_nulls_first() for k in keys])
    dealt = dealt.sortWithinPartitions(*[F.col(f"`{k}`").asc_nulls_first() for k in keys])
    dealt = stored(dealt.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    sizes = dealt.groupBy(part, *group).agg(F.count("*").alias(count), F.min(at).alias(first))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum(count).over(earlier), F.lit(0)))
    ranked = dealt.join(sizes.drop(count), [part, *group]).withColumn(name, F.col(before) + F.col(at) - F.col(first))
    return ranked.select(*[f"`{c}`" for c in df.columns], name)


def sample_keys(rows: DataFrame, label: str, key: str, each: int) -> DataFrame:
    """At most `each` distinct (label, key) of every label, as near to `each` as its rows allow: a sample by the key's hash.

    A first pass counts each label's rows; a second lets through by hash about three times as many keys as are wanted and cuts those to `each`. So
    no more than that is ever ordered, whatever share of the rows a label has. Null labels and keys are left out.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(label, key)
    counts = known.groupBy(label).agg(F.approx_count_distinct(key, 0.02).alias("__count"))
    order = F.xxhash64(F.lit("sample"), key)
    through = F.col("__order").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40)) < F.lit(3.0 * each + 50) / F.col("__count")
    near = known.withColumn("__order", order).join(F.broadcast(counts), label).where(through).select(label, key, "__order").distinct()
    by_hash = Window.partitionBy(label).orderBy("__order", key)
    return near.withColumn("__n", F.row_number().over(by_hash)).where(F.col("__n") <= each).select(label, key)
