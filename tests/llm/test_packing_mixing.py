import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import mixing, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_best_fit(lengths, capacity):
    """The number of bins when every piece, longest first, goes to the open bin that it fills most."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    return rooms


def places(lengths, capacity):
    counts = {x: lengths.count(x) for x in set(lengths)}
    steps, opened = packing.best_fit_decreasing(counts, capacity)
    keys = [(s[0], s[1]) for s in steps.tolist()]
    assert keys == sorted(keys, key=lambda k: (-k[0], k[1]))
    out = []
    for length, count in counts.items():
        for rank in range(count):
            step = max((s for s in steps.tolist() if s[0] == length and s[1] <= rank), key=lambda s: s[1])
            out.append((step[3] + (rank - step[1]) // step[2], step[4] + (rank - step[1]) % step[2] * length, length))
    return sorted(out), opened


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120), st.integers(30, 45))
def test_counts_pack_as_piece_by_piece(lengths, capacity):
    found, opened = places(lengths, capacity)
    assert opened == len(plain_best_fit(lengths, capacity))
    filled = {}
    for sequence, offset, length in found:
        assert filled.get(sequence, 0) == offset
        filled[sequence] = offset + length
    assert sorted(capacity - x for x in filled.values()) == sorted(plain_best_fit(lengths, capacity))


def test_steps_are_bounded_by_the_capacity():
    rng = np.random.default_rng(0)
    few, _ = packing.best_fit_decreasing(dict(zip(range(1, 4097), rng.integers(1, 10, 4096).tolist())))
    many, _ = packing.best_fit_decreasing(dict(zip(range(1, 4097), rng.integers(10**8, 10**9, 4096).tolist())))
    assert len(many) < 60_000 and len(few) < 60_000


def test_word_ids_equal_the_tokenizer():
    tokenizer = packing.word_ids(packing.tokenizer_path())
    texts = ["", None, "Plain words, here. Twice, here.", "don't WE'LL 'sx it's.", "É é é İstanbul ΣΑΣ ς.", "a\tb\x0bc\x1cd e  f\r\n\ng", "!!! ??. x!! y?! ... .", "a1b2 3.14 1,000.", "<|endoftext|> x<|startoftext|>y", "漢字 かな 😀👍🏽 ｘ", "x" * 9000, "ab " * 3000, "ﬁ ß ẞ. ́x ý."]
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in tokenizer.encode(texts)]
        assert got == [tokenizer.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        tokenizer.empty()


def test_letters_that_normalise_to_marks_before_punctuation():
    encoder = packing.word_ids(packing.tokenizer_path())
    for core in ("\u0130", "KED\u0130", "\u0958", "a\u0958", "\u0928\u095b", "\ufb1d", "Stra\u00dfe", "\u00c9"):
        for tail in ("", *packing.TAILS):
            encoder.empty()
            got = np.frombuffer(next(encoder.encode([f"x {core}{tail} y."])), "<u4").tolist()
            assert got == encoder.tokenizer.encode(f"x {core}{tail} y.", add_special_tokens=False).ids
    encoder.empty()


def test_pack_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["tree", "river.", "Stone,", "x9"], k=rng.choice([0, 3, 700, 5000, 9000]))), "en", "s", 0) for i in range(60)]
    rows += [(None, None, None, None, None), (4, "same", "", "", 0), (4, "same", "", "", 0)]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), packing.tokenizer_path()).toPandas()
    tokenizer = packing.word_ids(packing.tokenizer_path()).tokenizer
    want = []
    for number, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, i in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[i : i + 4096], "<u4")
            want.append((number, k, i, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple(-1 if x is None or x != x else int(x) for x in r)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, want))
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 4096
    assert got.sequence_id.nunique() == len(plain_best_fit([w[3] for w in want], 4096))
    assert all(zlib.crc32(i) == c for i, c in zip(got.ids, got.ids_crc32))
    assert packing.pack_documents(spark.createDataFrame([], DOCS), packing.tokenizer_path()).count() == 0


def plain_targets(sizes, weights, share, limit):
    left, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * level >= limit * sizes[i]}
        for i in full or open_:
            target[i] = limit * sizes[i] if full else weights[i] * level
        left -= sum(target[i] for i in full)
        open_ -= full or open_
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = []
    for source, n in (("b", 300), ("a", 40), ("ä", 15), (None, 5), ("Z", 1), ("hot", 900)):
        rows += [(len(rows) + i, " ".join(["w"] * rng.choice([0, 1, 5, 5, 5, rng.randint(1, 400)])), "en", source, 0) for i in range(n)]
    rows += [(None, None, None, None, None), (3, "a b c d e", "x", "b", 1), (3, "a b c d e", "x", "b", 1), (9999, "", "en", "blank", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "size")
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all() and got.copies.between(0, 2).all()
    order = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = [sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in order]
    want = dict(zip(order, plain_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2)))
    got["source"] = got.source.where(got.source.notna(), None)
    for source in order:
        part = got[got.source.isna()] if source is None else got[got.source == source]
        assert part.target.iloc[0] == pytest.approx(want[source]) and part.source_size.iloc[0] == sizes[order.index(source)]
        assert abs(part.taken.sum() - want[source]) <= max(2, 0.002 * want[source]), source
    again = mixing.mix(df.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_rates_are_tilted(spark):
    """Where copies average below one in a source, they fall with size: the tilt is by words."""
    rows = [(i, "w " * (1 + i % 50), "en", "ab"[i % 2 and i < 900], 0) for i in range(1000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), weights=(1.0, 30.0), share=1.0).toPandas()
    low = got[got.source == "a"]
    assert low.copies.mean() < 1
    assert low[low["size"] <= 15].copies.mean() > low[low["size"] >= 35].copies.mean()


def test_mixed_documents(spark):
    rows = [(i, "one two three", "en", "ab"[i % 2], i) for i in range(40)] + [(0, "one two three", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    counts = mixing.mix(docs).toPandas().groupby("doc_id").copies.sum()
    assert out.toPandas().groupby("doc_id").size().to_dict() == counts[counts > 0].to_dict()
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mixed_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_a_cased_tokenizer_and_a_byte_level_one_keep_their_own_ids(tmp_path):
    """Where case or spaces count, the shortcuts are off; with a cache too small for one slice the ids are the same as well."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    texts = ["", None, "Hello hello, HELLO.  a\nb", " x" * 50]
    vocab = {c: i for i, c in enumerate(sorted({*pre_tokenizers.ByteLevel.alphabet(), "He", "Ġx"}))}
    cased = Tokenizer(models.BPE(vocab, [("H", "e"), ("Ġ", "x")]))
    cased.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    cased.save(str(tmp_path / "cased.json"))
    found = packing.WordIds(str(tmp_path / "cased.json"))
    assert not found.by_words and not found.folds
    assert [x.tolist() for x in found.encode(texts)] == [cased.encode(t or "", add_special_tokens=False).ids for t in texts]
    small = packing.WordIds(packing.tokenizer_path(), held_bytes=200)
    texts += [" ".join(f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" for i in range(k, k + 40)) + "!" for k in range(30)]
    for text in texts * 2:
        assert next(small.encode([text])).tolist() == small.tokenizer.encode(text or "", add_special_tokens=False).ids
    assert small.known.nbytes + small.ids.nbytes + small.used.nbytes <= 200
    assert [x.tolist() for x in small.encode(["", ""])] == [[], []]
