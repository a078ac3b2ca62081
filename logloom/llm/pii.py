"""Personal data: base patterns, and gradient-boosted trees over candidate spans.

Base spans are exact patterns for e-mail addresses, IPv4 addresses, card numbers and phone numbers; they always stay. Beside them, high-recall generators
propose overlapping spans that only resemble such data: addresses with `at` and `dot`, numbers in other groupings. Boosted trees (Spark's own) judge each
candidate by its format and its surroundings. They learn from all documents: base spans, as they stand and rewritten in looser forms, against
candidates that no base span touches. Thresholds are set for each kind on a quarter of the texts that fitting doesn't see. A document is then scored where
it lies: whole texts are read in one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, read, sample_keys, stored

KINDS = ("email", "ip", "card", "phone")
#: Trees and their depth; the share of negatives that a threshold may let through.
TREES, DEPTH, LET_THROUGH = 12, 3, 0.001

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive, so that a long run of digits is read once; the base pattern never starts or ends inside a run.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether a digit string's check sum holds."""
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Each @ with a domain, extended to the left as far as its local part goes: what the base pattern finds, in linear time."""
    free = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if start < m.start():
            yield "email", start, m.end()
            free = m.end()


def base_spans(text: str) -> list[Span]:
    """The base spans of a whole text by start, then kind: leftmost and non-overlapping within a kind, failing ones dropped."""
    out = list(emails(text)) if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = digits_of(m.group()) if m.end() - m.start() <= 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# Generators: each proposes spans of its kind; they overlap freely. Bounded repeats keep them linear.
AT, DOT = r"(?:@|[ ]?[\[(](?:at|AT|@)[\])][ ]?|[ ](?:at|AT)[ ])", r"(?:\.|[ ]?[\[(](?:dot|DOT|\.)[\])][ ]?|[ ](?:dot|DOT)[ ])"
GENERATORS = {
    "email": (re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{AT}[A-Za-z0-9-]{{1,63}}+(?:{DOT}[A-Za-z0-9-]{{2,63}}+){{1,4}}"),),
    "ip": (re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[ ]?(?:\.|[\[(]\.[\])])[ ]?[0-9]{1,3}){3}(?![0-9.])"),),
    "card": (
        re.compile(r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){12,18}(?![0-9])"),
        re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
        re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./-][0-9]{4}){3}(?![0-9])"),
    ),
    "phone": (
        re.compile(r"(?<![0-9])(?:\+|00|\()?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}(?![0-9])"),
        re.compile(r"\+[0-9]{1,3}[ ]?\(?[0-9]{2,4}\)?[ -]?[0-9]{3}[ -]?[0-9]{4}(?![0-9])"),
    ),
}
LOOSE = re.compile(rf"{AT}[A-Za-z0-9-]{{1,63}}{DOT}")
FEATURES = ("kind", "length", "digits", "others", "luhn", "plus", "parens", "groups", "first", "last", "largest", "part", "before", "after", "cue", "at", "dots", "hex", "line_share")
CUES = re.compile(r"(?i)(?:mail|contact|reach|write|call|tel|phone|mobile|fax|card|visa|credit|ip|host|server|address|addr)\W*\Z")


def candidates(text: str) -> list[Span]:
    kinds = KINDS if "@" in text or LOOSE.search(text) else KINDS[1:]
    return sorted({(kind, m.start(), m.end()) for kind in kinds for generator in GENERATORS[kind] for m in generator.finditer(text)})


def features(text: str, span: Span) -> list[float]:
    """FEATURES of a candidate: its format, and what stands next to it."""
    kind, a, b = span
    body, digits = text[a:b], digits_of(text[a:b])
    groups = re.findall(r"[0-9]+", body)
    before, after, lead = text[a - 1 : a], text[b : b + 1], text[max(0, a - 24) : a]

    def kind_of(c: str) -> float:
        return 0.0 if not c or c.isspace() else 1.0 if c in ".,;:!?)(" else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0

    return [
        float(KINDS.index(kind)),
        float(b - a),
        float(len(digits)),
        float(sum(not c.isalnum() for c in body)),
        float(len(digits) >= 12 and luhn(digits)),
        float("+" in body[:1] or before == "+"),
        float("(" in body),
        float(len(groups)),
        float(len(groups[0]) if groups else 0),
        float(len(groups[-1]) if groups else 0),
        float(max(map(len, groups), default=0)),
        float(min(999, max((int(g[:4]) for g in groups), default=0))),
        kind_of(before),
        kind_of(after),
        float(bool(CUES.search(lead))),
        float("@" in body) + 2.0 * bool(re.search(r"(?i)\bat\b", body)),
        float(body.count(".")) + 8.0 * bool(re.search(r"(?i)\bdot\b", body)),
        float(bool(re.search(r"[a-fA-F0-9]\Z", lead)) + bool(re.match(r"[a-fA-F0-9]", after or " "))),
        float(sum(c.isdigit() for c in lead)) / 24,
    ]


def looser(kind: str, body: str, pick: int) -> str:
    """A base span rewritten as people write such data to be read by others."""
    digits = digits_of(body)
    if kind == "email":
        local, _, domain = body.partition("@")
        at, dot = ((" at ", " dot "), (" (at) ", "."), ("[at]", "[dot]"), ("(at)", "(dot)"))[pick % 4]
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return body.replace(".", ("[.]", "(.)", " . ")[pick % 3])
    if kind == "card":
        return ("." if pick % 2 else "/").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, rest = digits[-10:-7] or "020", digits[-7:]
    return (f"({area}) {rest[:3]}-{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}", f"{area}.{rest[:3]}.{rest[3:]}", f"00{digits}")[pick % 4]


def harmless(pick: int) -> str:
    """Numbers that resemble personal data without being any: a time, an amount, a version, a book number, a count."""
    a, b, c = pick % 97, pick // 97 % 89, pick // 8633 % 83
    forms = ("{y}-{m:02}-{d:02} {h:02}:{n:02}", "{d:02}.{m:02}.{y} {h:02}:{n:02}", "{a},{b:03},{c:03},{d:03}", "{a}.{b}.{c}", "978-{d}-{b:02}-{a:03}{c:03}-{n}", "{y}/{m:02}/{d:02}", "{a:04}{b:04}{c:02}{n:02}", "{d:02}/{m:02}/{y} {b:04}")
    return forms[pick % len(forms)].format(y=1970 + a % 60, m=1 + b % 12, d=1 + c % 28, h=a % 24, n=b % 60, a=a, b=b, c=c)


def overlaps(spans: list[Span]):
    """A test for whether a stretch touches any of the spans."""
    starts, reach = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        starts.append(a)
        reach.append(max(b, reach[-1] if reach else 0))
    return lambda a, b: (k := bisect_right(starts, b - 1)) > 0 and reach[k - 1] > a


def lessons(text: str) -> Iterator[tuple[list[float], float]]:
    """(features, label): base spans as they stand and in a looser form, against candidates that no base span touches and in harmless numbers."""
    base = base_spans(text)
    touched = overlaps(base)
    for kind, a, b in base:
        yield features(text, (kind, a, b)), 1.0
        pick, lead, tail = zlib.crc32(text[a:b].encode()) >> 3, text[max(0, a - 30) : a], text[b : b + 30]
        body = looser(kind, text[a:b], pick)
        yield features(lead + body + tail, (kind, len(lead), len(lead) + len(body))), 1.0
        for k in range(3):
            body = harmless(pick + 1009 * k)
            shown = " " + body + " "
            for span in candidates(shown):
                yield features(shown, span), 0.0
    for span in candidates(text):
        if not touched(span[1], span[2]):
            yield features(text, span), 0.0


@dataclass
class Detector:
    """Trees as nested (feature, split, left, right) tuples or leaf values, their weights, and each kind's threshold; without trees, base spans alone."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        def value(tree, at: np.ndarray) -> np.ndarray:
            if not isinstance(tree, tuple):
                return np.full(len(at), tree)
            feature, split, left, right = tree
            out, goes = np.empty(len(at)), rows[at, feature] <= split
            out[goes], out[~goes] = value(left, at[goes]), value(right, at[~goes])
            return out

        every = np.arange(len(rows))
        return 1 / (1 + np.exp(-2 * sum(w * value(t, every) for w, t in zip(self.weights, self.trees))))

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """The base spans and all spans of a whole text. Added spans touch neither base spans nor one another: the likeliest go first."""
        if not ANY.search(text) and not LOOSE.search(text):
            return [], []
        base = base_spans(text)
        if not self.trees:
            return base, base
        touched = overlaps(base)
        proposed = [s for s in candidates(text) if not touched(s[1], s[2])]
        added: list[Span] = []
        if proposed:
            sure = self.probabilities(np.array([features(text, s) for s in proposed]))
            able = [(-p, s[1], KINDS.index(s[0]), s[2], s) for p, s in zip(sure, proposed) if p >= self.thresholds[s[0]]]
            starts: list[int] = []  # of added spans, sorted, with their ends
            ends: dict[int, int] = {}
            for *_, s in sorted(able):
                k = bisect_right(starts, s[1])
                if (k == 0 or ends[starts[k - 1]] <= s[1]) and (k == len(starts) or starts[k] >= s[2]):
                    starts.insert(k, s[1])
                    ends[s[1]] = s[2]
                    added.append(s)
        return base, ordered(base + added)


def fit(docs: DataFrame, rows: int | None = None, trees: int = TREES, depth: int = DEPTH) -> Detector:
    """Fit on all distinct texts of docs (text) that have a digit, an @ or the like, or on at most `rows` of them; without both labels there are no trees."""
    spark = bounded_batches(docs).sparkSession
    usable = docs.select("text", F.xxhash64("text").alias("key")).where(F.col("text").rlike(r"[0-9@]"))
    if rows is not None:
        keys = stored(sample_keys(usable.withColumn("label", F.lit(0)), "label", "key", rows), "pii_keys")  # at most `rows` rows
        usable = usable.join(F.broadcast(keys.select("key")), "key")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(key, n, f, label) for key, text in zip(batch["key"], batch["text"]) for n, (f, label) in enumerate(lessons(text))]
            yield pd.DataFrame(found, columns=["key", "n", "row", "label"])

    # equal texts teach once: their lessons are told apart by the text's hash and their number, so that no text is shuffled
    each = usable.mapInPandas(learn, "key long, n int, row array<double>, label double").dropDuplicates(["key", "n"])
    fold = F.pmod("key", F.lit(4)).cast("int").alias("fold")
    taught = stored(each.select("row", "label", fold), "pii_lessons")
    table = taught.withColumn("features", array_to_vector("row"))
    counts = {r["label"]: r["n"] for r in table.where("fold <> 0").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Detector()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.3, seed=1, subsamplingRate=1.0).fit(table.where("fold <> 0").select("features", "label"))

    def nested(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return node.prediction()
        return node.split().featureIndex(), node.split().threshold(), nested(node.leftChild()), nested(node.rightChild())

    found = Detector([nested(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights))

    @F.pandas_udf("double")
    def sure(values: pd.Series) -> pd.Series:
        return pd.Series(found.probabilities(np.stack(values)) if len(values) else [], dtype=float)

    unseen = taught.where("fold = 0 and label = 0").select(F.col("row")[0].cast("int").alias("kind"), sure("row").alias("p"))
    limits = {r["kind"]: r["t"] for r in unseen.groupBy("kind").agg(F.percentile("p", F.lit(1 - LET_THROUGH)).alias("t")).collect()}
    found.thresholds = {k: max(0.8, min(1.0, limits.get(i, 0.0) + 0.02)) for i, k in enumerate(KINDS)}
    return found


def detect(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, the numbers of base spans by kind, base_sha256, spans for each row of docs (doc_id, text). Null texts count as empty."""
    names = [f"n_{k}" for k in KINDS]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, every = detector.spans(text) if isinstance(text, str) else ([], [])
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            found = pd.DataFrame(rows, columns=[*names, "base_sha256", "spans"])
            found.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield found

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded_batches(docs).select("doc_id", "text").mapInPandas(find, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span as its kind in brackets; spans that touch become one, named by the first."""
    out, at, merged = [], 0, []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """docs with every span of its texts redacted; null stays null, other columns stay as they are."""

    @F.pandas_udf("string")
    def clean(values: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, detector.spans(t)[1]) if isinstance(t, str) else None for t in values], dtype=object)

    return bounded_batches(docs).withColumn(text, clean(F.col(f"`{text}`")))


def op8_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return detect(docs, fit(docs))
