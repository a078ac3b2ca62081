"""One-permutation MinHash fingerprints, in DataFrame functions alone.

Every word shingle is hashed once. The hash's high bits name one of `bins` bins, and each bin keeps its least hash. Empty bins are filled by optimal
densification: bin i borrows from the first filled bin on a probe sequence of its own, so that equal sets borrow alike and unequal bins borrow
independently. Each bin then keeps its low-order `bits` bits, packed as hex, and likeness corrects for the bits that agree by chance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, partitions, read

WIDTH, BINS, BITS = 5, 256, 8


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def fingerprint_bins(text: Column, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> Column:
    """array<int> of `bins` low-order values of a whole text; empty for a text without words (and for null).

    bins is a power of 2. Words are what ASCII white space divides, with A-Z in lower case; a text of fewer than `width` words is one shingle.
    """
    if bins & (bins - 1):
        raise ValueError("bins must be a power of 2")
    shift = 64 - bins.bit_length()  # hashes are used without their sign: 63 bits, of which the highest name the bin
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lowered, SPACE + "+"), lambda w: w != "")
    empty = F.array(*[F.lit((i << shift) | ((1 << shift) - 1)) for i in range(bins)])  # the largest hash of each bin marks it as empty
    rest = F.lit((1 << shift) - 1)

    def shingles(w: Column) -> Column:
        """w: the words' hashes."""
        last = F.greatest(F.size(w) - width, F.lit(0))
        whole = F.array(F.xxhash64(w))
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) < width, whole).otherwise(each)

    def least(sorted_: Column) -> Column:
        return F.filter(sorted_, lambda h, i: (i == 0) | (F.shiftright(h, shift) != F.shiftright(F.get(sorted_, i - 1), shift)))

    def densified(mins: Column) -> Column:
        is_empty = lambda h: h.bitwiseAND(rest) == rest

        def borrowed(i: Column) -> Column:
            # probe j of bin i: factor * j + offset visits every bin, as the factor is odd; both are hashes of i. Probes go in growing blocks
            within, i = F.lit(bins - 1), i.cast("long")
            step = F.array(*[F.xxhash64(i, F.lit(k).cast("long")).bitwiseAND(within).bitwiseOR(F.lit(odd)) for k, odd in ((1, 1), (2, 0))])
            ends = [0, 2, 8, 32, bins] if bins > 32 else [0, bins]

            def first(s: Column, start: int, stop: int) -> Column:
                found = F.transform(F.sequence(F.lit(start), F.lit(stop - 1)), lambda j: F.get(mins, (F.get(s, F.lit(0)) * j + F.get(s, F.lit(1))).bitwiseAND(within).cast("int")))
                return F.get(F.filter(found, lambda x: ~is_empty(x)), F.lit(0))

            # hashed once more with the bin's number: else the borrowers' low bits would all agree by one and the same chance
            return F.xxhash64(let(step, lambda s: F.coalesce(*[first(s, a, b) for a, b in zip(ends, ends[1:])])), i)

        def fill(h: Column, i: Column) -> Column:
            return F.when(~is_empty(h), h).otherwise(borrowed(i))

        return F.transform(mins, lambda h, i: fill(h, i).bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))

    hashes = let(F.transform(words, lambda x: F.xxhash64(x)), shingles)
    mins = let(F.sort_array(F.concat(F.transform(hashes, lambda h: h.bitwiseAND(F.lit((1 << 63) - 1))), empty)), least)
    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(let(mins, densified)))


def packed(values: Column, bits: int = BITS) -> Column:
    """The bins' values as lowercase hex, bits / 4 digits to a bin; the empty string for no words."""
    digits = bits // 4
    return F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), digits, "0")), ""))


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated Jaccard likeness of two fingerprints' bin arrays, 0 to 1, without the 2 ** -bits of bins that agree by chance.

    Two texts without words are alike (1); one without words is unlike any other (0).
    """
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    chance = 1.0 / (1 << bits)
    share = equal / F.greatest(F.size(a), F.size(b))
    estimate = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(estimate)


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """docs with column fingerprint (hex). Null texts count as empty; equal texts have equal fingerprints."""
    return docs.withColumn("fingerprint", packed(fingerprint_bins(F.col(f"`{text}`"), width, bins, bits), bits))


def with_next(docs: DataFrame, key: str, carried: list[str], buckets: int | None = None) -> DataFrame:
    """docs with next_<c> for each carried column: the value of the row that follows by `key` ascending, null keys first; the last row's is the first row.

    Rows are dealt out by ranges of the key, whose bounds are quantiles of it; each range also gets a copy of the next range's first rows, so that
    no range needs another and one shuffle does. Rows of equal keys follow one another by their carried values' hash.
    """
    buckets = buckets or 4 * partitions(docs.sparkSession)
    ends = docs.agg(F.percentile_approx(key, F.array(*[F.lit(i / buckets) for i in range(buckets)]), F.lit(max(10_000, 20 * buckets))), F.min(key), F.count("*") - F.count(key)).first()
    bounds = sorted({*(ends[0] or []), *([] if ends[1] is None else [ends[1]])})  # each is a key that occurs; the first is the least
    wide = max(1, int(len(bounds) ** 0.5))
    kind = docs.schema[key].dataType
    all_bounds = F.array(*[F.lit(b).cast(kind) for b in bounds]) if bounds else F.array().cast("array<long>")
    coarse = F.array(*[F.lit(b).cast(kind) for b in bounds[::wide]]) if bounds else all_bounds
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col(key)))
    block = let(below(coarse), lambda c: F.when(c == 0, 0).otherwise((c - 1) * wide + below(F.slice(all_bounds, (c - 1) * wide + 1, F.lit(wide)))))
    own = F.when(F.col(key).isNull(), 0).otherwise(block)  # bucket 0 holds null keys, bucket b the keys from bounds[b - 1] on
    first = 0 if ends[2] else 1
    wraps = F.col(key).isNull() if ends[2] else F.col("__own") == 1
    starts = F.array_contains(all_bounds, F.col(key)) & (F.col("__own") > first)
    wraps = wraps & (F.col(key).isNull() if ends[2] else F.array_contains(all_bounds, F.col(key)))
    places = F.array_compact(F.array(F.struct(F.col("__own").alias("b"), F.lit(0).alias("copy")), F.when(starts, F.struct((F.col("__own") - 1).alias("b"), F.lit(1).alias("copy"))), F.when(wraps, F.struct(F.lit(len(bounds)).alias("b"), F.lit(2).alias("copy")))))
    dealt = docs.withColumn("__own", own).withColumn("__at", F.explode(places)).withColumn("__bucket", F.col("__at.b")).withColumn("__copy", F.col("__at.copy"))
    order = Window.partitionBy("__bucket").orderBy("__copy", F.col(key).asc_nulls_first(), F.xxhash64(*carried))
    following = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return following.where("__copy = 0").select(*docs.columns, *[f"next_{c}" for c in carried])


def neighbours(docs: DataFrame, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """For each row of docs (doc_id, text): its fingerprint, that of its edited text, and its likeness to that and to the next document.

    The edited text has the last half of the characters replaced by the first as many of the next document (by doc_id, null first; after the last
    comes the first). Null texts count as empty. Repeated ids follow one another by their texts' hash.
    """
    make = lambda c: fingerprint_bins(F.col(c), width, bins, bits)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_next(texts.withColumn("bins", make("text")), "doc_id", ["text", "bins"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    made = own.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited).drop("text", "next_text").withColumn("edited_bins", make("edited"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins"), bits).alias("fingerprint"),
        packed(F.col("edited_bins"), bits).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins"), bits).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins"), bits).alias("near_next"),
    )


def op9_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "documents"))
