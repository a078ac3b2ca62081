import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import licenses, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# The base patterns as they are given, for brute force.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if 2 * d < 10 else 2 * d - 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 14 <= len(digits) <= 19 and plain_luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0]), s[2]))


def card(rng):
    body = "".join(rng.choices("0123456789", k=15))
    return next(body + c for c in "0123456789" if plain_luhn(body + c))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.B_%+-@@0129 ()..\n,é", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_longer_texts():
    rng = random.Random(1)
    pieces = ["a.b@c-d.e.f", "@x.y", "a@b", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.4", "+1 (269) 555-3296", "+49.30-1234567890 ", "4111 1111 1111 1111", "x", " ", "\n", "-", "9" * 25]
    for _ in range(300):
        text = "".join(rng.choice([*pieces, card(rng)]) + rng.choice(["", " ", ","]) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 100_000, "(" * 200_000, "1 " * 100_000):
        pii.base_spans(text), pii.candidates(text)


@pytest.fixture(scope="module")
def detector(spark):
    rng = random.Random(2)
    rows = []
    for i in range(500):
        words = rng.choices("the of and token area number code than".split(), k=30)
        words[rng.randrange(30)] = rng.choice([f"jo.{i}@mail{i % 9}.example.com", f"{rng.randrange(256)}.{i % 256}.3.{rng.randrange(256)}", card(rng), f"+1 ({rng.randrange(100, 999)}) 555-{i:04}", f"{rng.randrange(10**15, 10**16)}", f"sum {rng.randrange(10**8)}", f'"{rng.randrange(16**20):x}"'])
        rows.append((i, " ".join(words)))
    return pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))


def test_trees_add_what_the_patterns_miss(detector):
    rng, found = random.Random(9), 0
    for _ in range(40):
        a, b = card(rng), card(rng)
        text = f"the {a} {b} of +1 (555) 201-{rng.randrange(10**4):04} {a} than"
        spans = pii.ordered(detector.spans(text)[1])
        assert set(detector.spans(text)[0]) <= set(spans)
        found += sum((k, text[i:j]) in (("card", a), ("card", b)) for k, i, j in spans)
    assert found >= 100
    for text in ("", "no data at all", "2023-01-02 12:34:56", "1,234,567,890", 'token = "9b0f3c"', "see chapter 3.4 and 12.5"):
        assert detector.spans(text)[1] == [], text
    assert [k for k, *_ in detector.spans("mail jo (at) example (dot) com now")[1]] == ["email"]


def test_detect_contract(spark, detector):
    rng = random.Random(3)
    texts = ["", None, "a@b.cd and 1.2.3.4", f"x {card(rng)} +1 (200) 555-1234", "é😀 " * 3 + "q@r.st", "w " * 60_000 + "z@y.xw"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "a@b.cd", None, None, None), (2, texts[2], "", "", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit("clash"))
    got = pii.detect(docs, detector).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a@b.cd" if r.doc_id is None else texts[r.doc_id] or ""
        base = plain_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(joined.split(",")) <= set(r.spans.split(","))
    assert pii.detect(docs.limit(0), detector).count() == 0


def test_redaction(spark, detector):
    rows = [(1, "mail a@b.cd, then 1.2.3.4!", "en", "s", 9), (2, None, None, None, None), (3, "clean", "en", "s", 5)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in pii.redact(docs, detector).collect()}
    assert got[1].text == "mail [EMAIL], then [IP]!" and got[2].text is None and got[3].text == "clean" and got[1].source == "s"
    assert pii.redacted("0123456789", [("card", 1, 4), ("phone", 3, 6), ("ip", 7, 8)]) == "0[CARD]6[IP]89"


def test_without_lessons_base_spans_stay(spark):
    plain = pii.fit(spark.createDataFrame([(None,), ("no digits",), ("",)], "text string"))
    assert plain.spans("a@b.cd") == ([("email", 0, 6)], [("email", 0, 6)])


def license_rows():
    mit = dict(licenses.known_licenses()[:6])["MIT"]
    shouted = "MIT LICENCE\n\nCopyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ;").replace("\n\n", "\n \n")
    texts = ["", None, mit, shouted, "prose\nReleased under the MIT Licence!\nmore", "Licensed under CC BY-NC 4.0.", "licensed   under\tthe Apache license, v2.0", f"intro\n\n{licenses.BSD_HEAD}{licenses.BSD_WARRANTY}\n\nend", "The software is permitted.", "SPDX-License-Identifier: ISC\nSPDX-License-Identifier: MIT", "é licensed under the MIT License", mit + " extra", "word " * 50_000]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, mit, None, None, None), (4, texts[4], "en", "s", 0)]


def test_license_scan(spark):
    got = {r.doc_id: (r.license_id, r.n_notices, r.license_ids) for r in licenses.scan(spark.createDataFrame(license_rows(), DOCS)).collect()}
    assert got[0] == got[1] == got[8] == got[10] == got[11] == got[12] == (None, 0, "")
    assert got[2][0] == got[3][0] == got[None][0] == "MIT"
    assert got[4] == (None, 1, "MIT") and got[5] == ("CC-BY-NC-4.0", 1, "CC-BY-NC-4.0") and got[6][0] == "Apache-2.0"
    assert got[7] == (None, 1, "BSD-2-Clause") and got[9] == (None, 2, "ISC,MIT")


def test_license_scan_equals_its_sql(spark):
    rows = license_rows()
    got = licenses.scan(spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash"))).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    want = con.sql(licenses.oracle_sql()).df()
    key = lambda d: sorted(str([None if pd.isna(x) else x for x in r]) for r in d[["doc_id", "license_id", "n_notices", "license_ids"]].itertuples(index=False))
    assert key(got) == key(want) and len(got) == len(rows)


def test_own_wordings_and_native_plan(spark):
    docs = spark.createDataFrame([(1, "Do what you like."), (2, "do  WHAT you like"), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, [("Like-1", "Do what you like!")]).collect()}
    assert got == {1: "Like-1", 2: "Like-1", 3: None}
    assert licenses.scan(docs.limit(0)).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_trees_learn_from_all_texts(spark, monkeypatch):
    seen, keep = {}, pii.stored

    def counted(df, name):
        seen[name] = keep(df, name)
        return seen[name]

    monkeypatch.setattr(pii, "stored", counted)
    texts = [f"jo.{i}@mail.example.com on 2020-01-02 10:11:12" for i in range(4500)]
    pii.fit(spark.createDataFrame([(t,) for t in [*texts, *texts[:100]]], "text string"))
    assert seen["pii_lessons"].count() == sum(len(list(pii.lessons(t))) for t in texts)
