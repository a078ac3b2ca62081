"""Best-fit-decreasing packing of token sequences, exact over the whole corpus.

Documents are cut into pieces of at most `capacity` tokens. Pieces of one length are interchangeable, so the plan needs only how
many pieces there are of each length: at most `capacity` numbers come to the driver, whatever the corpus holds. Best fit decreasing
runs on those counts. A segment tree over the remaining capacities finds the tightest open bin in logarithmic time, and bins
that look alike are kept as ranges of sequence ids. A piece then finds its sequence from its rank among pieces of its length. The result is the
one that placing every document in turn would give.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, rank_within, read, stored

CAPACITY, END_ID = 4096, 1
#: Bytes of known words and their ids that a Python worker keeps; text bytes encoded in one go.
CACHE_BYTES, SLICE_BYTES = 12 << 20, 2 << 20
TAILS = ".,;:!?"
#: A word of Latin letters, and at most one closing sign. Their lower case is one letter each and none joins with a sign in NFC.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
#: Texts and words on which a tokenizer's properties are probed.
PROBES = ["Plain words, here.  Twice\n\nhere. ", " don't WE'LL 'sx it's 3.14 x9", "\u00c9t\u00e9 \u00e9 stra\u00dfe \u0130 \u03a3\u0391\u03a3 \u6f22\u5b57 \U0001f600!", "a\tb c(d)e ... --- %%% ***"]
FOLDED = ["a", "Hello", "HELLO", "\u00c9t\u00e9", "Stra\u00dfe", "\u00d1and\u00fa", "qzxvkj"]


class WordIds:
    """Token ids of texts, put together word by word in Arrow arrays.

    Words are split at spaces and line ends alone (what other white space a word holds is left to the tokenizer). A slice's words become a
    dictionary, and theirs in turn become one of cores: words of letters in lower case, without a closing sign. Only cores that aren't known
    pass through the tokenizer, so no word is a Python object unless it is new. Ids are kept as bytes, and are joined and gathered by Arrow.
    When the known cores outgrow `held_bytes`, those used most recently stay, as many as half of it holds.

    This rests on properties of the tokenizer file, which are probed when it is loaded. If the ids of a text aren't those of its words in a
    row, `by_words` is False and whole texts are encoded. If case or a closing sign changes the ids of a word's letters, `folds` is False and
    words are encoded as they stand. Either way the ids are the tokenizer's own.
    """

    def __init__(self, path: str, held_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer, self.held_bytes = Tokenizer.from_file(path), held_bytes
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.by_words = all(ids(t) == [x for w in t.replace("\n", " ").split(" ") for x in ids(w)] for t in PROBES)
        self.folds = self.by_words and all(ids(w + t) == ids(w.lower()) + ids(t) for w in FOLDED for t in ["", *TAILS])
        self.tails = self.encode_each(["", *TAILS])
        self.empty()

    def empty(self) -> None:
        self.known, self.ids, self.used, self.now = pa.array([], pa.string()), pa.array([], pa.binary()), np.empty(0, np.int64), 0

    def encode_each(self, words: list[str]) -> pa.Array:
        return pa.array([np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)], pa.binary())

    def encode_cores(self, cores: list[str]) -> pa.Array:
        """Words of letters alone: one call for all, cut where a token closes a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(cores)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.closes[ids]) + 1
        if len(stops) != len(cores):
            return self.encode_each(cores)
        offsets = np.r_[0, 4 * stops].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(cores), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])

    def ids_of(self, cores: pa.Array) -> pa.Array:
        """The ids of distinct cores, from what is known or else from the tokenizer."""
        self.now += 1
        at = pc.index_in(cores, value_set=self.known).to_numpy(zero_copy_only=False)  # NaN: not known
        fresh = np.flatnonzero(np.isnan(at)) if at.dtype.kind == "f" else np.empty(0, np.int64)
        if len(fresh):
            new = cores.take(pa.array(fresh))
            lettered = pc.match_substring_regex(new, LETTERS + "$").to_numpy(zero_copy_only=False) & self.folds
            for encode, part in ((self.encode_cores, lettered), (self.encode_each, ~lettered)):
                if part.any():
                    words = new.filter(pa.array(part))
                    at[fresh[part]] = np.arange(len(words)) + len(self.known)
                    self.known, self.ids = pa.concat_arrays([self.known, words]), pa.concat_arrays([self.ids, encode(words.to_pylist())])
            self.used = np.r_[self.used, np.zeros(len(new), np.int64)]
        at = at.astype(np.int64)
        self.used[at] = self.now
        found = self.ids.take(pa.array(at))
        held = self.known.nbytes + self.ids.nbytes + self.used.nbytes
        if held > self.held_bytes:
            stay = np.argsort(-self.used, kind="stable")[: len(self.used) * self.held_bytes // (2 * held)]
            self.known, self.ids, self.used = self.known.take(pa.array(stay)), self.ids.take(pa.array(stay)), self.used[stay]
        return found

    def ids_of_words(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words: those of their cores and closing signs."""
        if not self.folds:
            return self.ids_of(words)
        lettered = pc.match_substring_regex(words, LETTERS + "[" + TAILS + "]?$")
        cores = pc.if_else(lettered, pc.utf8_lower(pc.utf8_rtrim(words, TAILS)), words).dictionary_encode()
        sign = pc.index_in(pc.utf8_slice_codeunits(words, -1), value_set=pa.array(list(TAILS)))
        tails = pc.if_else(lettered, pc.add(sign.fill_null(-1), 1), 0)
        return pc.binary_join_element_wise(self.ids_of(cores.dictionary).take(cores.indices), self.tails.take(tails), b"")

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text of a string array or list (null: empty)."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not self.by_words:
            for text in texts.to_pylist():
                yield np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")
            return
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        each = self.ids_of_words(words.dictionary).cast(pa.large_binary()).take(words.indices)
        _, ends, data = each.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(each) + 1] // 4
        ids = np.frombuffer(data, "<u4") if data is not None and data.size else np.empty(0, "<u4")
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield ids[a:b]


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The process's own WordIds of a tokenizer file."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, binary) of each piece of each row's whole text, closed by END_ID.

    A null or empty text has the end id alone. Only texts of more than `capacity` ids have more than one piece.
    """
    closing = np.array([END_ID], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for batch in itertools.chain.from_iterable(map(slices, batches)):
            rows = [[], [], [], [], [], []]
            for i, found in enumerate(encoder.encode(batch.column("text"))):
                ids = np.r_[found, closing].tobytes()
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (i, k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            made = [pa.array(x, kind) for x, kind in zip(rows[1:], kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            out = [batch.column("doc_id").take(pa.array(rows[0], pa.int64())), *made]
            yield pa.RecordBatch.from_arrays(out[: 5 + with_ids], names=names[: 5 + with_ids])

    kind = docs.schema[doc_id].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(cut, shape)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of rows with at most `most` bytes of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


class OpenBins:
    """Ranges of open bins by remaining capacity, under a segment tree that finds the least capacity that still fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def mark(self, room: int) -> None:
        node = room + self.leaves
        self.any[node] = bool(self.ranges[room])
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def add(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.ranges[room].append((first, count))
            self.mark(room)

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of `length` or more that an open bin has."""
        node = length + self.leaves
        while not self.any[node]:
            while node & 1:  # a right child: go up until there is something to the right
                node //= 2
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, room: int) -> tuple[int, int]:
        found = self.ranges[room].pop()
        self.mark(room)
        return found


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Steps (length, first rank, pieces to a bin, first sequence, offset) and the number of sequences.

    Pieces of a length, by rank from a step's first rank on, go to the bins from its first sequence on, so many to a bin, the first of
    them at the offset. The number of steps is bounded by the capacity alone.
    """
    bins, steps, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            room = bins.tightest(length)
            first, count = (opened, total) if room is None else bins.take(room)
            space = capacity if room is None else room
            each = space // length
            full = min(count, (total - done) // each)
            if full:
                steps.append((length, done, each, first, capacity - space))
                bins.add(space - each * length, first, full)
                done += full * each
            part = total - done if full < count else 0
            if part:
                steps.append((length, done, part, first + full, capacity - space))
                bins.add(space - part * length, first + full, 1)
                done = total
            if room is None:
                opened += full + bool(part)
            else:
                bins.add(room, first + full + bool(part), count - full - bool(part))
    return np.array(steps, np.int64).reshape(-1, 5), opened


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows of pieces(): every row gets a place, none overlaps, sequences have no gaps.

    Rows that repeat are packed one by one. Lengths must be from 1 to `capacity`. No rows give no rows.
    """
    numbered = stored(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in numbered.groupBy("length").count().collect()}  # at most `capacity` rows
    steps, _ = best_fit_decreasing(counts, capacity)
    ranked = rank_within(numbered.drop("ids"), ["length"], ["doc_id", "piece", "row"], "rank")
    keys = steps[:, 0] << 48 | steps[:, 1]
    steps, keys = steps[np.argsort(keys)], np.sort(keys)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            step = steps[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            bin_, slot = np.divmod(rank - step[:, 1], step[:, 2])
            yield batch.drop(columns="rank").assign(sequence_id=step[:, 3] + bin_, offset=step[:, 4] + slot * length)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema) + ", sequence_id long, offset long"
    placed = ranked.mapInPandas(place, shape)
    if "ids" in found.columns:
        placed = placed.join(numbered.select("row", "ids"), "row")
    return placed.drop("row")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """pieces() and pack() of docs (doc_id, text; other columns are left out)."""
    return pack(pieces(docs, tokenizer, capacity, with_ids), capacity)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
