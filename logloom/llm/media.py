"""Media columns: payloads kept once by content-defined chunks, and read back verified.

A payload is wrapped as a WAV file of 8-bit samples: a header, then the payload. A rolling gear hash over its last 32 bytes cuts it where its content says so, so that an insertion moves no cut
further on. Chunk digests are deduplicated by Spark aggregations and joins: each distinct chunk is kept by one medium alone, its owner, in that medium's pack; the
others list its digest. A medium's ordered chunk list then gives back its bytes, checked against every chunk's digest and the whole's.

Bytes move as little as they can, by one plan at any size. Chunk lists (digests and lengths) are what is shuffled to find owners. A pack whose medium shares nothing is read back where it lies;
only chunks that others list, and packs that list others' chunks, travel.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read, shared_folder, stored

LEAST, USUAL_BITS, MOST, DIGEST = 512, 11, 16_384, 16
#: Rows, of 64 bits each, of the table that tells which texts may have marks: it is broadcast, and has no more rows than this at any size.
BROADCAST_ROWS = 300_000
#: The random number of each byte value in the gear hash: any fixed ones do.
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
WAV = "<4sI4s4sIHHIIHH4sI"


def payload_of(text: str | None) -> bytes:
    """UTF-8, with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64)


def header(n: int) -> bytes:
    """The header of a RIFF WAVE file of n unsigned 8-bit samples, one channel, 8000 a second."""
    return struct.pack(WAV, b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n)


def samples(media: bytes) -> bytes:
    """The samples of such a file."""
    *_, kind, n = struct.unpack_from(WAV, media)
    if kind != b"data" or len(media) != 44 + n:
        raise ValueError("not a whole WAV file of this form")
    return media[44:]


def cuts(payload: bytes) -> list[int]:
    """Lengths of a payload's chunks: LEAST to MOST bytes, the last may be shorter."""
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # after these, h[i] is the sum of gear[payload[i - k]] << k over the last 32 bytes
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    ends = (np.flatnonzero(h >> np.uint32(32 - USUAL_BITS) == 0) + 1).tolist()
    out, at, n = [], 0, len(payload)
    while at < n:
        k = bisect_left(ends, at + LEAST)
        end = min(n, at + MOST, ends[k] if k < len(ends) else n)
        out.append(end - at)
        at = end
    return out


def chunked(payload: bytes) -> tuple[list[int], list[bytes], list[bytes]]:
    """Lengths, chunks and their digests."""
    lengths, at, chunks = cuts(payload), 0, []
    for n in lengths:
        chunks.append(payload[at : at + n])
        at += n
    return lengths, chunks, [hashlib.blake2b(c, digest_size=DIGEST).digest() for c in chunks]


def chunk_lists(docs: DataFrame) -> DataFrame:
    """doc_id, key (the text's SHA-256), n_bytes, digests for each row of docs: a medium's ordered chunk list."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(len(t.encode("utf-8", "surrogatepass")), chunked(payload_of(t))[2]) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "key": batch["key"], "n_bytes": [r[0] for r in rows], "digests": [r[1] for r in rows]})

    return _keyed(docs).mapInPandas(listed, f"doc_id {_kind(docs)}, key binary, n_bytes long, digests array<binary>")


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return bounded_batches(docs).select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))


def ownership(lists: DataFrame) -> DataFrame:
    """For media that share anything: key, absent and lent chunk numbers (null for a medium that has copies and shares nothing else).

    A digest's owner is the place with the least hash among all that list it: one aggregation over digests, whatever their number of places.
    """
    media = stored(lists.groupBy("key").agg(F.count("*").alias("rows"), F.any_value("digests").alias("digests")), "media")
    chunks = media.select("key", F.posexplode("digests").alias("number", "digest")).withColumn("place", F.xxhash64("key", "number"))
    shared = stored(chunks.groupBy("digest").agg(F.count("*").alias("places"), F.min("place").alias("first")).where("places > 1").drop("places"), "shared")
    own = F.col("place") == F.col("first")
    marks = chunks.join(shared, "digest").groupBy("key").agg(F.collect_list(F.when(~own, F.col("number"))).alias("absent"), F.collect_list(F.when(own, F.col("number"))).alias("lent"))
    copies = media.where("rows > 1").select("key")
    return stored(copies.join(marks, "key", "full"), "marks")


def may_be_marked(keyed: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of keyed (key, ...) with `maybe`: true for every key that marks has, and for a few others whose bit is the same.

    So texts that share nothing stay where they are. The more marks there are for the table's bits, the more texts go on to the join.
    """
    rows = max(1, BROADCAST_ROWS)
    word, bit = F.pmod(F.xxhash64("key"), F.lit(rows)).alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(key, 1), 64) as int))").alias("bit")
    table = stored(marks.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")), "marked_bits")
    met = keyed.withColumns({"word": word, "bit": bit}).join(F.broadcast(table), "word", "left")
    return met.withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))).drop("word", "bit", "bits")


def packs(docs: DataFrame, marks: DataFrame, path: str) -> DataFrame:
    """Write one pack for each medium to path: its chunk list and, in a row, the bytes of the chunks that it owns."""
    keyed = may_be_marked(_keyed(docs), marks)
    alone = keyed.where("not maybe").select("key", "text", *[F.lit(None).cast("array<int>").alias(c) for c in ("absent", "lent")])
    once = keyed.where("maybe").groupBy("key").agg(F.any_value("text").alias("text"))  # copies of a text are already few when they leave their tasks
    marked = once.join(marks.hint("merge"), "key", "left").select("key", "text", "absent", "lent")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, absent, lent in zip(batch["key"], batch["text"], batch["absent"], batch["lent"]):
                payload = payload_of(text)
                lengths, chunks, digests = chunked(payload)
                head = header(len(payload))
                gone = set(() if absent is None else absent)
                body = b"".join(c for i, c in enumerate(chunks) if i not in gone)
                rows.append((key, head, hashlib.sha256(head + payload).digest(), lengths, digests, sorted(gone), sorted(() if lent is None else lent), body))
            yield pd.DataFrame(rows, columns=["key", "head", "media_sha", "lengths", "digests", "absent", "lent", "body"])

    shape = "key binary, head binary, media_sha binary, lengths array<int>, digests array<binary>, absent array<int>, lent array<int>, body binary"
    made = alone.union(marked).mapInPandas(pack, shape)
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def _slices(lengths, absent, body: bytes) -> dict[int, bytes]:
    """A pack's own chunks by number."""
    gone, at, out = set(absent), 0, {}
    for i, n in enumerate(lengths):
        if i not in gone:
            out[i] = body[at : at + n]
            at += n
    return out


def read_back(stored_packs: DataFrame, use: Callable[[bytes], tuple], shape: str) -> DataFrame:
    """key and what use(media bytes) returns (columns of shape), for every medium of the packs.

    Raises if a chunk or a whole medium is not what its digest says.
    """

    def lend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for lengths, digests, absent, lent, body in batch[["lengths", "digests", "absent", "lent", "body"]].itertuples(index=False):
                own = _slices(lengths, absent, body)
                rows += [(digests[i], own[i]) for i in lent]
            yield pd.DataFrame(rows, columns=["digest", "chunk"])

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                have = _slices(r.lengths, r.absent, r.body) | {f["number"]: f["chunk"] for f in (() if r.fetched is None else r.fetched)}
                chunks = [have[i] for i in range(len(r.lengths))]
                media = r.head + b"".join(chunks)
                if any(hashlib.blake2b(c, digest_size=DIGEST).digest() != d for c, d in zip(chunks, r.digests, strict=True)) or hashlib.sha256(media).digest() != r.media_sha:
                    raise ValueError(f"medium {r.key.hex()} is damaged")
                rows.append((r.key, *use(media)))
            yield pd.DataFrame(rows, columns=names)

    names = ["key", *(x.split()[0] for x in shape.split(","))]
    alone, sharing = stored_packs.where("size(absent) = 0"), stored_packs.where("size(absent) > 0")
    wanted = sharing.select("key", "digests", F.explode("absent").alias("number")).select("key", "number", F.get("digests", "number").alias("digest"))
    fetched = wanted.join(stored_packs.where("size(lent) > 0").mapInPandas(lend, "digest binary, chunk binary"), "digest")
    fetched = fetched.groupBy("key").agg(F.collect_list(F.struct("number", "chunk")).alias("fetched"))
    columns = ["key", "head", "media_sha", "lengths", "digests", "absent", "body"]
    none = F.lit(None).cast("array<struct<number:int,chunk:binary>>").alias("fetched")
    whole = alone.select(*columns, none).mapInPandas(rebuild, f"key binary, {shape}")
    joined = sharing.select(*columns).join(fetched, "key").select(*columns, "fetched").mapInPandas(rebuild, f"key binary, {shape}")
    return whole.union(joined)


def store(docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(members, packs) of docs (doc_id, text): members has doc_id, key and n_bytes of every row, packs (under path) each distinct medium once.

    Null texts count as empty; equal texts are one medium, also where rows repeat. Other columns are left out.
    """
    lists = stored(chunk_lists(docs), "chunk_lists")
    return lists.select("doc_id", "key", "n_bytes"), packs(docs, ownership(lists), path)


def restore(stored_packs: DataFrame) -> DataFrame:
    """key and media (a WAV file's bytes, verified) of every medium."""
    return read_back(stored_packs, lambda media: (media,), "media binary").dropDuplicates(["key"])


def digest_columns(media: bytes) -> tuple:
    """Sizes, checksums and features of a medium, from its bytes as read back."""
    payload = samples(media)
    wave = np.frombuffer(payload, np.uint8).astype(np.int64)
    high = wave >= 128
    feature = f"sum={wave.sum()};squares={(wave * wave).sum()};peak={wave.max()};crossings={(high[1:] != high[:-1]).sum()};silent={(wave == 0).sum()}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def describe(docs: DataFrame) -> DataFrame:
    """Store docs (doc_id, text) in the shared folder, read every medium back, and give each row its medium's digest columns."""
    members, kept = store(docs, f"{shared_folder(docs.sparkSession)}/logloom-{uuid.uuid4().hex}/packs")
    shape = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    found = stored(read_back(kept, digest_columns, shape), "described").dropDuplicates(["key"])
    return members.join(stored(found, "found"), "key").drop("key")


def op10_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(read(spark, sf_dir, "documents").select("doc_id", "text"))
