"""Encodings to and from text."""

from __future__ import annotations

import base64
import quopri
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fallible import Fallible, fallible


def encode_base16(c: Column) -> Column:
    return F.lower(F.hex(c.cast("binary")))


def decode_base16(c: Column) -> Fallible:
    return fallible(c.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.try_to_binary(c, F.lit("hex")).cast("string"), "decode_base16: bad digits")


def encode_base64(c: Column, charset: str = "standard", padding: bool = True) -> Column:
    """charset is standard or url_safe."""
    out = F.regexp_replace(F.base64(c.cast("binary")), "[\r\n]", "")
    out = F.translate(out, "+/", "-_") if charset == "url_safe" else out
    return out if padding else F.rtrim(out, F.lit("="))


def decode_base64(c: Column) -> Fallible:
    """Either alphabet; padding and white space are ignored, and so is a dangling character."""
    bare = F.regexp_replace(F.translate(c, "-_", "+/"), r"[=\s]", "")
    full = F.when(F.length(bare) % 4 == 1, F.left(bare, F.length(bare) - 1)).otherwise(bare)
    padded = F.rpad(full, (F.ceil(F.length(full) / 4) * 4).cast("int"), F.lit("="))
    return fallible(bare.rlike("^[A-Za-z0-9+/]*$"), F.try_to_binary(padded, F.lit("base64")).cast("string"), "decode_base64: bad character")


def encode_percent(c: Column) -> Column:
    """All but letters, digits, hyphen, underscore, full stop and tilde."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def decode_percent(c: Column) -> Column:
    """Bad escapes stay, and so does plus."""
    kept = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(kept)


WORD = re.compile(r"=\?[^?]*\?([A-Za-z])\?([^?]*)\?=")


@F.pandas_udf(T.StringType())
def decode_mime_q(values: pd.Series) -> pd.Series:
    """Every =?charset?Q or B?...?= in a text; bytes are read as UTF-8. Of malformed base64 the whole groups count."""

    def word(m: re.Match) -> str:
        if m[1] in "bB":
            sixes = re.sub("[^A-Za-z0-9+/]", "", m[2])
            sixes = sixes[:-1] if len(sixes) % 4 == 1 else sixes  # one sign alone holds no byte
            raw = base64.b64decode(sixes + "=" * (-len(sixes) % 4))
        else:
            raw = quopri.decodestring(m[2].encode("utf-8", "surrogatepass"), header=True)
        return raw.decode("utf-8", "replace")

    return values.map(lambda v: None if v is None else WORD.sub(word, v))


def _labels(use):
    def one(v):
        try:
            return None if v is None else ".".join(use(x) for x in v.split("."))
        except UnicodeError:
            return None

    return one


@F.pandas_udf(T.StringType())
def encode_punycode(values: pd.Series) -> pd.Series:
    """Each label on its own; ASCII labels stay."""
    return values.map(_labels(lambda x: x if x.isascii() else "xn--" + x.encode("punycode").decode()))


@F.pandas_udf(T.StringType())
def _decode_punycode(values: pd.Series) -> pd.Series:
    return values.map(_labels(lambda x: x[4:].encode().decode("punycode") if x[:4].lower() == "xn--" else x))


def decode_punycode(c: Column) -> Fallible:
    out = _decode_punycode(c)
    return fallible(out.isNotNull(), out, "decode_punycode: invalid label")


def encode_csv(c: Column, delimiter: str = ",") -> Column:
    """An array of strings as one record; a field is quoted if it has the delimiter, a quote or a line end."""
    delimiter = delimiter if len(delimiter) == 1 else ","
    special = lambda x: F.contains(x, F.lit(delimiter)) | x.rlike('["\r\n]')
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.array_join(F.transform(c, lambda x: F.when(special(x), quoted(x)).otherwise(x)), delimiter, "")


def encode_key_value(c: Column, key_value_delimiter: str = "=", field_delimiter: str = " ") -> Column:
    """A map of strings; a value is quoted if it is empty or has a space, a quote or an equals sign."""
    quoted = lambda v: F.concat(F.lit('"'), F.regexp_replace(v, '(["\\\\])', r"\\$1"), F.lit('"'))
    shown = lambda v: F.when(v.rlike('[ "=]') | (v == ""), quoted(v)).otherwise(v)
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(key_value_delimiter), shown(F.coalesce(e["value"], F.lit("null"))))), field_delimiter)


def encode_logfmt(c: Column) -> Column:
    return encode_key_value(c)


def encode_json(c: Column) -> Column:
    """Compact JSON with nulls kept and fields in their order."""
    return F.to_json(c, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})
