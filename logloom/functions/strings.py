"""String functions. Letters are those of ASCII in case changes; offsets and lengths named so are in bytes."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coerce import to_float
from .fallible import Fallible, fallible, java_regex

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Pattern = str | re.Pattern


def _java(pattern: Pattern) -> str:
    return java_regex(pattern.pattern if isinstance(pattern, re.Pattern) else pattern)[0]


def _literal(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def upcase(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def downcase(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def strip_whitespace(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def contains(c: Column, substring: Column | str) -> Column:
    return F.contains(c, F.lit(substring))


def starts_with(c: Column, prefix: Column | str) -> Column:
    return F.startswith(c, F.lit(prefix))


def ends_with(c: Column, suffix: Column | str) -> Column:
    return F.endswith(c, F.lit(suffix))


def contains_all(c: Column, substrings: list[str], case_sensitive: bool = True) -> Column:
    out, subject = F.lit(True), c if case_sensitive else downcase(c)
    for s in substrings:
        out = out & F.contains(subject, F.lit(s) if case_sensitive else downcase(F.lit(s)))
    return out


def split(c: Column, pattern: Pattern, limit: int = -1) -> Column:
    """By a literal string or a compiled pattern, into at most `limit` pieces."""
    return F.split(c, _java(pattern) if isinstance(pattern, re.Pattern) else _literal(pattern), limit)


def join(c: Column, separator: str = "") -> Fallible:
    """An array of strings; a null element is an error."""
    return fallible(F.forall(c, lambda x: x.isNotNull()), F.array_join(c, separator), "join: all elements must be strings")


def replace(c: Column, pattern: Pattern, with_: str) -> Column:
    """Every occurrence of a literal string or a compiled pattern; `with_` has no group references."""
    if isinstance(pattern, re.Pattern):
        return F.regexp_replace(c, _java(pattern), with_.replace("\\", r"\\").replace("$", r"\$"))
    return F.replace(c, F.lit(pattern), F.lit(with_)) if pattern else c


def slice_(c: Column, start: int = 0, end: int | None = None) -> Column:
    """Bytes from start up to end, negative ones from the end; a character that is cut shows as U+FFFD."""
    raw, n = c.cast("binary"), F.octet_length(c)
    at = lambda i: F.least(F.greatest(F.lit(i) if i >= 0 else n + i, F.lit(0)), n)
    first, last = at(start), n if end is None else at(end)
    cut = F.substring(raw, first + 1, F.greatest(last - first, F.lit(0)))
    return F.when(F.octet_length(c) == F.char_length(c), F.decode(cut, "UTF-8")).otherwise(F.make_valid_utf8(cut.cast("string")))


def _words(c: Column) -> Column:
    parted = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(parted, "[^A-Za-z0-9]+"), lambda w: w != "")


def _capital(w: Column) -> Column:
    return F.concat(upcase(F.substring(w, 1, 1)), downcase(F.substring(w, F.lit(2), F.length(w))))


def snakecase(c: Column) -> Column:
    return downcase(F.array_join(_words(c), "_"))


def screamingsnakecase(c: Column) -> Column:
    return upcase(F.array_join(_words(c), "_"))


def kebabcase(c: Column) -> Column:
    return downcase(F.array_join(_words(c), "-"))


def camelcase(c: Column) -> Column:
    return F.array_join(F.transform(_words(c), lambda w, i: F.when(i == 0, downcase(w)).otherwise(_capital(w))), "")


def pascalcase(c: Column) -> Column:
    return F.array_join(F.transform(_words(c), _capital), "")


def basename(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, "/+$", ""), "([^/]*)$", 1)


def dirname(c: Column) -> Column:
    """`.` without a slash; the root stays."""
    bare = F.regexp_replace(c, "(?<=.)/+$", "")
    return F.when(~F.contains(bare, F.lit("/")), ".").when(bare.rlike("^/[^/]*$"), "/").otherwise(F.regexp_replace(bare, "/[^/]*$", ""))


def split_path(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda x: x != "")


def strlen(c: Column) -> Column:
    return F.char_length(c)


def truncate(c: Column, limit: int, ellipsis: bool = False) -> Column:
    limit = max(0, limit)
    cut = F.left(c, F.lit(limit))
    return F.when(F.char_length(c) > limit, F.concat(cut, F.lit("..." if ellipsis else ""))).otherwise(c)


def find(c: Column, pattern: Pattern, from_: int = 0) -> Column:
    """The byte index of the first occurrence at or after `from_`, or -1. ASCII texts only if `from_` is given."""
    rest = F.substring(c, F.lit(from_ + 1), F.length(c)) if from_ else c
    place = F.regexp_instr(rest, F.lit(_java(pattern))) if isinstance(pattern, re.Pattern) else F.instr(rest, pattern)
    return F.when(c.isNotNull(), F.when(place > 0, F.octet_length(F.left(rest, place - 1)) + from_).otherwise(-1))


def match(c: Column, pattern: Pattern) -> Column:
    return c.rlike(_java(pattern))


def match_any(c: Column, patterns: list[Pattern]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | match(c, p)
    return out


def strip_ansi_escape_codes(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)\x1b(\\[[^@-~]*[@-~]?|\\][^\x07\x1b]*(\x07|\x1b\\\\)?|.)", "")


@F.pandas_udf(T.DoubleType())
def shannon_entropy(values: pd.Series) -> pd.Series:
    """Bits a byte; 0 for an empty string."""

    def bits(text):
        if text is None:
            return None
        counts = np.bincount(np.frombuffer(text.encode(), np.uint8))
        p = counts[counts > 0] / max(1, counts.sum())
        return float(-(p * np.log2(p)).sum()) + 0.0

    return values.map(bits)


def parse_float(c: Column) -> Fallible:
    return to_float(c)


def redact(c: Column, filters: list[Pattern], redactor: str = "[REDACTED]") -> Column:
    """Every match of every pattern replaced. For arrays and objects, apply it to their strings with transform."""
    for p in filters:
        c = F.regexp_replace(c, _java(p), redactor.replace("\\", r"\\").replace("$", r"\$"))
    return c


def sieve(c: Column, pattern: Pattern, replace_single: str = "", replace_repeated: str | None = None) -> Column:
    """Keeps what matches; the first character of each run that doesn't becomes replace_single, each further one replace_repeated.

    ASCII texts, and a pattern that matches single characters, if a replacement is given.
    """
    kept = F.regexp_extract_all(c, F.lit(_java(pattern)), F.lit(0))
    if not replace_single and not replace_repeated:
        return F.array_join(kept, "")
    repeated = replace_single if replace_repeated is None else replace_repeated
    each = F.filter(F.split(c, ""), lambda x: x != "")
    full = "(?s)^(?:" + _java(pattern) + ")$"
    shown = F.transform(each, lambda x, i: F.when(x.rlike(full), x).when((i == 0) | F.get(each, i - 1).rlike(full), replace_single).otherwise(repeated))
    return F.array_join(shown, "")


def replace_with(c: Column, pattern: Pattern, use) -> Column:
    """Every match replaced by use(match), a string column of the match's column."""
    kept, found = F.split(c, _java(pattern)), F.regexp_extract_all(c, F.lit(_java(pattern)), F.lit(0))
    return F.array_join(F.flatten(F.zip_with(kept, found, lambda a, m: F.array(F.coalesce(a, F.lit("")), F.coalesce(use(m), F.lit(""))))), "")
