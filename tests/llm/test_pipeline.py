import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import common, pii
from test_sharding_simhash import plain_components, plain_fingerprint

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_stages_in_turn(spark):
    docs = common.read(spark, SMALL, "documents")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "123 --", "en", "s", 6), (10**6 + 2, "", "en", "s", 0)], docs.schema)
    docs, columns = docs.union(extra), docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(common.stored(stage(spark, kept[-1], SMALL), name))
    assert all(k.columns == columns for k in kept[1:-1])
    rows = [{} for _ in kept]
    for found, df in zip(rows, kept[:-1]):
        for r in df.collect():
            found.setdefault(r.doc_id, []).append(r)

    lettered = {i for i, (r,) in rows[0].items() if r.text and any(c.isalpha() for c in r.text)}
    assert set(rows[1]) == lettered and 10**6 not in lettered

    ids = sorted(rows[1])
    want = plain_components(ids, [plain_fingerprint(rows[1][i][0].text) for i in ids])
    assert set(rows[2]) == set(want.values())

    for i, (r,) in rows[3].items():
        before = rows[2][i][0].text
        base = pii.base_spans(before)
        assert r.n_chars == len(r.text) and all(before[a:b] not in r.text for k, a, b in base if k in ("email", "card"))
        if not any(c.isdigit() or c == "@" for c in before):
            assert r.text == before

    copies = {i: len(r) for i, r in rows[4].items()}
    assert set(copies) <= set(rows[3]) and set(copies.values()) <= {1, 2}
    words = {i: len(r[0].text.encode().split()) for i, r in rows[3].items()}
    total = sum(words[i] * n for i, n in copies.items())
    assert abs(total - 1.5 * sum(words.values())) < 0.02 * total

    last = kept[-1].toPandas()
    assert last[last.piece == 0].groupby("doc_id").size().to_dict() == copies
    for _, part in last.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 4096


def test_run_gives_the_last_stages_rows(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.agg(F.count("*")).first()[0] > 50
