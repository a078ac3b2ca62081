import hashlib
import io
import random
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import media

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_cuts(payload):
    """The same cuts from a rolling hash, a byte at a time."""
    h, at, out = 0, 0, []
    for i, b in enumerate(payload):
        h = (h << 1) + int(media.GEAR[b]) & 0xFFFFFFFF
        n = i + 1 - at
        if n >= media.LEAST and h >> (32 - media.USUAL_BITS) == 0 or n == media.MOST or i + 1 == len(payload):
            out.append(n)
            at = i + 1
    return out


def test_cuts_are_those_of_the_rolling_hash():
    rng = np.random.default_rng(1)
    for payload in (bytes(64), rng.bytes(64), rng.bytes(100_032), bytes(50_048), b"ab" * 40_000, rng.bytes(704)):
        assert media.cuts(payload) == plain_cuts(payload)


def test_cuts_come_back_after_an_insertion():
    body = np.random.default_rng(2).bytes(60_000)
    first, second = (set(media.chunked(p)[2]) for p in (body, body[:100] + b"inserted" + body[100:]))
    assert len(first & second) >= len(first) - 3


def test_the_form_is_a_wav_file():
    payload = media.payload_of("sound é")
    assert len(payload) == 64 and payload.startswith("sound é".encode())
    with wave.open(io.BytesIO(media.header(64) + payload)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getnframes(), w.readframes(64)) == (1, 1, 64, payload)
    assert media.samples(media.header(64) + payload) == payload and media.payload_of(None) == bytes(64)
    with pytest.raises(ValueError):
        media.samples(media.header(64) + payload[:-1])


def corpus():
    rng = random.Random(6)
    parts = ["".join(rng.choices("abcdefghij é", k=6000)) for _ in range(5)]
    texts = [rng.choice(parts) + "".join(rng.choices("xyz", k=rng.randrange(3000))) + rng.choice(parts) for _ in range(40)]
    texts += [texts[0]] * 5 + ["", None, "", "x" * 64, "x" * 63, "z" * 400_000]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0), (None, "n", None, None, None)]


def test_round_trip_and_dedup(spark, tmp_path):
    rows = corpus()
    members, packs = media.store(spark.createDataFrame(rows, DOCS), str(tmp_path / "packs"))
    back = {bytes(r.key): bytes(r.media) for r in media.restore(packs).collect()}
    want = {hashlib.sha256((t or "").encode()).digest(): media.payload_of(t) for _, t, *_ in rows}
    assert {k: media.samples(v) for k, v in back.items()} == want
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.key)) for r in members.collect()) == sorted((i is not None, i or 0, hashlib.sha256((t or "").encode()).digest()) for i, t, *_ in rows)
    kept = packs.dropDuplicates(["key"]).agg(F.sum(F.octet_length("body"))).first()[0]
    distinct = {d: len(c) for p in want.values() for _, chunks, digests in [media.chunked(p)] for c, d in zip(chunks, digests)}
    assert kept == sum(distinct.values()) < sum(map(len, want.values())) / 2


def test_packs_join_by_shuffle_gives_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "BROADCAST_ROWS", 0)
    rows = corpus()
    _, packs = media.store(spark.createDataFrame(rows, DOCS), str(tmp_path / "packs"))
    assert {media.samples(bytes(r.media)) for r in media.restore(packs).collect()} == {media.payload_of(t) for _, t, *_ in rows}


def test_describe_contract(spark):
    rows = corpus()
    got = media.describe(spark.createDataFrame(rows, DOCS).withColumn("feature", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        payload = media.payload_of(by_id[r.doc_id])
        form = media.header(len(payload)) + payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((by_id[r.doc_id] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        assert r.feature.startswith(f"sum={sum(payload)};")
    assert media.describe(spark.createDataFrame([], DOCS)).count() == 0


def test_damage_is_found(spark, tmp_path):
    _, packs = media.store(spark.createDataFrame([(1, "text " * 500, "", "", 0)], DOCS), str(tmp_path / "packs"))
    with pytest.raises(Exception, match="damaged"):
        media.restore(packs.withColumn("body", F.overlay("body", F.lit(b"!!"), F.lit(700)))).collect()
