import numpy as np

import corpus_pipeline
from logloom.llm import neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Places in rows of those that stay, by all pairs."""
    sets, root = [plain_shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return [min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for g in groups.values()]


def planted():
    rng = np.random.default_rng(3)
    word = lambda: "w" + str(rng.integers(10**9))
    texts, near = [], []
    for k in range(60):
        words = [word() for _ in range(300)]
        copy = list(words)
        for at in rng.choice(300, 1 + k % 8, replace=False):
            copy[at] = word()
        texts += [" ".join(words), " ".join(copy)]
        a, b = plain_shingles(texts[-2]), plain_shingles(texts[-1])
        near.append(len(a & b) / len(a | b))
    assert min(near) < 0.8 < 0.84 and sum(0.8 <= x < 0.9 for x in near) > 10
    hot = [word() for _ in range(200)]
    for k in range(60):  # more than SMALL copies that chain: each differs from the one before
        hot[(3 * k) % 200] = word()
        texts.append(" ".join(hot))
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


def test_near_dedup_equals_all_pairs(spark):
    rows = planted()
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "")
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(rows[i][0] for i in plain_kept(rows))
    assert neardup.deduplicate(kept.limit(0)).count() == 0


def test_one_row_of_a_group_stays_with_repeated_and_null_ids(spark):
    rows = planted()[:40]
    rows = [*rows, rows[0], rows[0], (None, rows[0][1], None, None, None), (None, "alone " * 9, None, None, None), (None, "alone " * 9, None, None, None), (None, None, None, None, None), (-1, " ", None, None, None)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(rows[i][0]) for i in plain_kept(rows)) and [r.doc_id for r in kept].count(0) == 1


def test_prints_meet_by_deletion_variants():
    """Two prints meet exactly where a segment differs in at most one bit."""
    rng = np.random.default_rng(4)
    one = rng.integers(0, 256, 216, dtype=np.uint8)
    for at in (0, 9, 12, 23):
        other = one.copy().reshape(72, 3)
        other[:] ^= np.array([1, 0, 1], np.uint8)  # two bits of each segment, one in either half
        assert not (neardup._halves(one[None])[0] == neardup._halves(other.reshape(1, -1))[0]).any()
        other[17] = one.reshape(72, 3)[17]
        other[17, at // 8] ^= 128 >> at % 8
        halves = [neardup._halves(p.reshape(1, -1)) for p in (one, other)]
        keys, rests, rows = (np.concatenate(x) for x in (*zip(*halves, strict=True), [[0] * 144, [1] * 144]))
        order = np.argsort(keys, kind="stable")
        a, b, crowd = neardup._under_variants(keys[order], rests[order].astype(np.int64), np.zeros((288, 2), np.uint64))
        assert {(rows[order][x], rows[order][y]) for x, y in zip(a, b, strict=True)} == {(1, 0)} and len(a) == 1 and not len(crowd)


def test_a_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    rng, made = np.random.default_rng(6), []
    words, texts = [f"w{i}" for i in range(150)], []
    for k in range(400):
        words = list(words) if k % 20 else [*texts[0].split()] if texts else words
        words[rng.integers(150)] = f"v{k}"
        texts.append(" ".join(words))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    keep = neardup.stored

    def counted(df, name):
        out = keep(df, name)
        made.append(out.count() if name in ("pairs", "across") else 0)
        return out

    monkeypatch.setattr(neardup, "stored", counted)
    kept = neardup.deduplicate(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(plain_kept(rows))
    assert sum(made) < 15 * len(rows)


def test_rows_of_a_crowd_follow_its_nodes_not_their_segments(spark, monkeypatch):
    """Near copies, most of them just under 0.8: what the meetings make a node doesn't grow with the group, and pairs that link only across it are found."""
    rng, keep, each = np.random.default_rng(7), neardup.stored, []
    for n in (150, 600):
        texts = []
        for k in range(n):
            words = [f"w{i}" for i in range(150)] if k % 3 else texts[k - 3].split() if k else [f"w{i}" for i in range(150)]
            for at in rng.choice(150, 6 if k % 3 else 1, replace=False):
                words[at] = f"v{k}x{at}"
            texts.append(" ".join(words))
        rows, made = [(i, t, "en", "s", 0) for i, t in enumerate(texts)], {}

        def counted(df, name, made=made):
            out = keep(df, name)
            made[name] = made.get(name, 0) + out.count()
            return out

        monkeypatch.setattr(neardup, "stored", counted)
        kept = neardup.deduplicate(spark.createDataFrame(rows, DOCS)).collect()
        assert sorted(r.doc_id for r in kept) == sorted(plain_kept(rows))
        each.append((made.get("begun", 0) + made["met"]) / n)
    assert max(each) < 2 * 2 * neardup.EARLY and each[1] < 1.5 * each[0]
