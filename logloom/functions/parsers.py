"""Parsers of log lines and other text into structs, maps and arrays. Timestamps stay as they are written."""

from __future__ import annotations

import csv
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coerce import FACILITIES, SEVERITIES, SPACE, _saturated
from .fallible import Fallible, fallible, java_regex

# The fields of well-known line formats, and the patterns that find them.
COMMON = r'^(?<host>\S+)\s+(?<identity>\S+)\s+(?<user>\S+)\s+\[(?<timestamp>[^\]]+)\]\s+"(?<method>\S+)\s+(?<path>\S+)\s+(?<protocol>[^"]+)"\s+(?<status>\d+)\s+(?<size>\d+|-)'
APACHE = {
    "common": COMMON,
    "combined": COMMON + r'\s+"(?<referrer>[^"]*)"\s+"(?<agent>[^"]*)"',
    "error": r"^\[(?<timestamp>[^\]]+)\]\s+\[(?<module>[^\]]*)\]?\s*\[?(?<severity>[^\]]*)\]?\s*(?:\[client (?<client>[^\]]+)\]\s+)?(?<message>.*)$",
}
NGINX = {
    "combined": r'^(?<client>\S+)\s+(?<identity>\S+)\s+(?<user>\S+)\s+\[(?<timestamp>[^\]]+)\]\s+"(?<method>\S+)\s+(?<path>\S+)\s+(?<protocol>[^"]+)"\s+(?<status>\d+)\s+(?<size>\d+)\s+"(?<referer>[^"]*)"\s+"(?<agent>[^"]*)"',
    "error": r"^(?<timestamp>\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})\s+\[(?<severity>\w+)\]\s+(?<pid>\d+)#(?<tid>\d+):\s+(?<message>.*)$",
}
GLOG = r"^(?<level>[IWEF])(?<timestamp>\d{8}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+(?<id>\d+)\s+(?<file>[^:]+):(?<line>\d+)\]\s+(?<message>.*)$"
KLOG = GLOG.replace(r"\d{8}", r"\d{4}")
SYSLOG_OLD = r"^(?<timestamp>[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(?<hostname>\S+)\s+(?<appname>[^\[:\s]+)(?:\[(?<procid>\d+)\])?:?\s*(?<message>.*)$"
SYSLOG_NEW = r"^(?<timestamp>\S+)\s+(?<hostname>\S+)\s+(?<appname>\S+)\s+(?<procid>\S+)\s+(?<msgid>\S+)\s+(?:-|\[.*?\])\s*(?<message>.*)$"
VPC_FLOW = ("version", "account_id", "interface_id", "srcaddr", "dstaddr", "srcport", "dstport", "protocol", "packets", "bytes", "start", "end", "action", "log_status")
VPC_NUMBERS = {"version", "srcport", "dstport", "protocol", "packets", "bytes", "start", "end"}
ALB = (
    "type", "timestamp", "elb", "client_host", "target_host", "request_processing_time", "target_processing_time", "response_processing_time",
    "elb_status_code", "target_status_code", "received_bytes", "sent_bytes", "request", "user_agent", "ssl_cipher", "ssl_protocol", "target_group_arn",
    "trace_id", "domain_name", "chosen_cert_arn", "matched_rule_priority", "request_creation_time", "actions_executed", "redirect_url", "error_reason",
    "target_list", "target_status_code_list", "classification", "classification_reason",
)
ALB_NUMBERS = {"elb_status_code", "target_status_code", "received_bytes", "sent_bytes", "matched_rule_priority"}
CEF = ("cefVersion", "deviceVendor", "deviceProduct", "deviceVersion", "deviceEventClassId", "name", "severity")
NUMBERS = {"status", "size", "body_bytes_size", "bytes", "content_length", "request_length", "port", "srcport", "dstport", "packets"}
GROK = {
    "USERNAME": "[a-zA-Z0-9._-]+",
    "USER": "%{USERNAME}",
    "INT": "(?:[+-]?(?:[0-9]+))",
    "BASE10NUM": r"(?:[+-]?(?:[0-9]+(?:\.[0-9]+)?)|\.[0-9]+)",
    "NUMBER": "%{BASE10NUM}",
    "POSINT": r"\b(?:[1-9][0-9]*)\b",
    "NONNEGINT": r"\b(?:[0-9]+)\b",
    "WORD": r"\b\w+\b",
    "NOTSPACE": r"\S+",
    "SPACE": r"\s*",
    "DATA": ".*?",
    "GREEDYDATA": ".*",
    "QUOTEDSTRING": r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')""",
    "UUID": "[A-Fa-f0-9]{8}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{12}",
    "IPV4": r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)",
    "IPV6": "(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}",
    "IP": "(?:%{IPV6}|%{IPV4})",
    "HOSTNAME": r"\b(?:[0-9A-Za-z][0-9A-Za-z-]{0,62})(?:\.(?:[0-9A-Za-z][0-9A-Za-z-]{0,62}))*\b",
    "IPORHOST": "(?:%{IP}|%{HOSTNAME})",
    "MONTH": r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\b",
    "MONTHNUM": "(?:0?[1-9]|1[0-2])",
    "MONTHDAY": "(?:(?:0[1-9])|(?:[12][0-9])|(?:3[01])|[1-9])",
    "YEAR": r"(?:\d\d){1,2}",
    "HOUR": "(?:2[0123]|[01]?[0-9])",
    "MINUTE": "(?:[0-5][0-9])",
    "SECOND": "(?:(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?)",
    "TIME": "%{HOUR}:%{MINUTE}:%{SECOND}",
    "TIMESTAMP_ISO8601": "%{YEAR}-%{MONTHNUM}-%{MONTHDAY}[T ]%{HOUR}:%{MINUTE}:%{SECOND}(?:Z|[+-]%{HOUR}:?%{MINUTE})?",
    "HTTPDATE": "%{MONTHDAY}/%{MONTH}/%{YEAR}:%{TIME} %{INT}",
    "LOGLEVEL": "(?:[Aa]lert|ALERT|[Tt]race|TRACE|[Dd]ebug|DEBUG|[Nn]otice|NOTICE|[Ii]nfo|INFO|[Ww]arn(?:ing)?|WARN(?:ING)?|[Ee]rr(?:or)?|ERR(?:OR)?|[Cc]rit(?:ical)?|CRIT(?:ICAL)?|[Ff]atal|FATAL|[Ee]merg(?:ency)?|EMERG(?:ENCY)?)",
    "URIPATH": r"(?:/[A-Za-z0-9$.+!*'(){},~:;=@#%&_\-]*)+",
    "URIPARAM": r"\?[A-Za-z0-9$.+!*'|(){},~@#%&/=:;_?\-\[\]<>]*",
}
BYTE_UNITS = ("b", "kb", "mb", "gb", "tb", "pb")
DURATIONS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}


def _group(c: Column, pattern: str, number: int) -> Column:
    """A group of the first match, null if the group took no part in it (an empty group counts as none if it can't match nothing)."""
    return F.regexp_extract(c, pattern, number)


def named_groups(c: Column, pattern: str, numbers: set[str] = frozenset(), optional: set[str] = frozenset()) -> Fallible:
    """A struct of a pattern's named groups in the order of their names; those in `numbers` as bigint where they are digits."""
    java, names = java_regex(pattern)
    fields = []
    for name in sorted(names):
        found = _group(c, java, names[name])
        found = F.nullif(found, F.lit("")) if name in optional else found
        fields.append((found.try_cast("bigint") if name in numbers else found).alias(name))
    return fallible(c.rlike(java), F.struct(*fields), "no match")


def parse_json(c: Column, schema: T.DataType | str) -> Fallible:
    """A JSON object or array of a known schema, whole: what follows it is an error."""
    from .types import is_json

    value = F.from_json(c, schema)
    return fallible(is_json(c), value, "parse_json: invalid JSON")


def parse_regex(c: Column, pattern: str) -> Fallible:
    """The first match as a struct of numbered groups, then named ones."""
    java, names = java_regex(pattern)
    count = re.compile(java.removeprefix("(?d)")).groups
    fields = [_group(c, java, i).alias(str(i)) for i in range(count + 1)] + [_group(c, java, i).alias(n) for n, i in sorted(names.items())]
    return fallible(c.rlike(java), F.struct(*fields), "parse_regex: no match")


def parse_regex_all(c: Column, pattern: str) -> Column:
    """Every match, as an array of such structs; none give an empty array."""
    java, names = java_regex(pattern)
    count = re.compile(java.removeprefix("(?d)")).groups
    columns = [F.regexp_extract_all(c, F.lit(java), F.lit(i)).alias(str(i)) for i in range(count + 1)]
    columns += [F.regexp_extract_all(c, F.lit(java), F.lit(i)).alias(n) for n, i in sorted(names.items())]
    return F.arrays_zip(*columns)


#: A text of so many bytes is no number.
LONGEST_NUMBER = 128


def parse_int(c: Column, base: int = 10) -> Fallible:
    """Leading digits. Base 10 finds out: 0x is 16, a leading 0 is 8. Numbers beyond a long become the nearest one; texts of 128 bytes or more are an error."""
    sign = F.when(F.regexp_extract(c, SPACE + "([+-]?)", 1) == "-", -1).otherwise(1)

    def read(lead: str, digits: str, of: int) -> Column:
        found = F.regexp_extract(c, f"(?i){SPACE}[+-]?{lead}0*([{digits}]{{1,70}})", 1)
        # all but the last digit of a number with no more digits than 2**63 fit in a long, so conv can't overflow; longer ones are beyond it
        longest = next(n for n in range(1, 65) if of**n >= 2**63)
        wide = lambda text: F.coalesce(F.conv(text, of, 10).cast("decimal(38,0)"), F.lit(0))
        lead = F.substring(found, 1, F.least(F.length(found), F.lit(longest)) - 1)
        whole = wide(F.when(lead != "", lead)) * of + wide(F.right(found, F.lit(1)))
        return F.when(found != "", F.when(F.length(found) > longest, F.lit(str(2**63)).cast("decimal(38,0)")).otherwise(whole))

    plain = "".join("0123456789abcdefghijklmnopqrstuvwxyz"[:base])
    digits = F.coalesce(read("0x", "0-9a-f", 16), read("0(?=[0-7])", "0-7", 8), read("", "0-9", 10)) if base == 10 else read("0x" if base == 16 else "(?=)", plain, base) if base != 16 else F.coalesce(read("0x", plain, 16), read("", plain, 16))
    low, high = (F.lit(str(x)).cast("decimal(38,0)") for x in (-(2**63), 2**63 - 1))
    value = F.greatest(low, F.least(high, digits.cast("decimal(38,0)") * sign)).cast("bigint")
    return fallible(digits.isNotNull() & (F.octet_length(c) < LONGEST_NUMBER), value, "parse_int: no digits, or too long")


def parse_bytes(c: Column, unit: str = "B", base: str = "2") -> Fallible:
    """A size such as `1.5 MiB` in the unit; k is 1024, or 1000 with base 10."""
    k = 1000.0 if base == "10" else 1024.0
    factors = {u[:1] + i + u[1:] if u != "b" else u: k**n for n, u in enumerate(BYTE_UNITS) for i in ("", "i")}
    table = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$"
    found = F.lower(F.regexp_extract(c, pattern, 2))
    factor = F.when(found == "", 1.0).otherwise(F.try_element_at(table, found))
    value = F.regexp_extract(c, pattern, 1).try_cast("double") * factor / factors.get(unit.lower(), 1.0)
    return fallible(value.isNotNull(), value, "parse_bytes: bad size")


def parse_duration(c: Column, unit: str) -> Fallible:
    """A duration such as `1h30m` in the unit: ns, us, ms, s, m, h or d."""
    table = F.create_map(*[F.lit(x) for pair in DURATIONS.items() for x in pair])
    part = r"([0-9]+(?:\.[0-9]+)?)\s*(ns|us|ms|s|m|h|d)"
    sizes, units = (F.regexp_extract_all(c, F.lit(part), F.lit(i)) for i in (1, 2))
    total = F.aggregate(F.zip_with(sizes, units, lambda n, u: n.cast("double") * F.element_at(table, u)), F.lit(0.0), lambda s, x: s + x)
    return fallible(c.rlike(rf"^\s*(?:{part}\s*)+$"), total / DURATIONS[unit], "parse_duration: bad duration")


def _pairs(c: Column, kv: str, field: str) -> Column:
    k, f = re.escape(kv[0]), re.escape(field[0])
    token = rf'((?:[^{k}{f}"]|"(?:[^"\\]|\\.)*")+)(?:{k}("(?:[^"\\]|\\.)*"|[^{f}]*))?'
    names, found = (F.regexp_extract_all(c, F.lit(token), F.lit(i)) for i in (1, 2))
    bare = lambda v: F.when(v.startswith('"') & v.endswith('"') & (F.length(v) > 1), F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).otherwise(v)
    return F.filter(F.zip_with(names, found, lambda n, v: F.struct(bare(F.btrim(n, F.lit(" \t\n"))).alias("key"), bare(F.coalesce(v, F.lit(""))).alias("value"))), lambda e: e["key"] != "")


def parse_key_value(c: Column, key_value_delimiter: str = "=", field_delimiter: str = " ") -> Column:
    """A map of strings; quoted values may hold delimiters, a bare key has an empty value, the last of equal keys wins."""
    from .collections import _last_wins

    return _last_wins(_pairs(c, key_value_delimiter, field_delimiter))


def parse_logfmt(c: Column) -> Column:
    return parse_key_value(c)


def parse_query_string(c: Column) -> Column:
    """A map from each key to the array of its values, decoded, in order."""
    from .codecs import decode_percent

    decoded = lambda x: decode_percent(F.replace(x, F.lit("+"), F.lit(" ")))
    parts = F.filter(F.split(F.regexp_replace(c, r"^\?", ""), "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), decoded(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda e: e["k"]))
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.transform(F.filter(pairs, lambda e: e["k"] == k), lambda e: e["v"]))))


def parse_csv(c: Column, delimiter: str = ",") -> Column:
    """One record as an array of strings; an empty string is one empty field."""

    @F.pandas_udf("array<string>")
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else next(csv.reader([v], delimiter=delimiter, strict=False), [""]) or [""])

    return read(c)


def parse_tokens(c: Column) -> Column:
    """White space parts; quotes and brackets keep what they hold together."""
    found = F.regexp_extract_all(c, F.lit(r'("[^"]*"?|\[[^\]]*\]?|\S+)'), F.lit(1))
    return F.transform(found, lambda t: F.when(t.rlike(r'^["\[]'), F.regexp_replace(t, r'^["\[]|["\]]$', "")).otherwise(t))


def parse_common_log(c: Column) -> Fallible:
    return named_groups(c, COMMON, NUMBERS)


def parse_apache_log(c: Column, format: str = "common") -> Fallible:
    """common, combined or error."""
    return named_groups(c, APACHE.get(format, COMMON), NUMBERS, {"client"})


def parse_nginx_log(c: Column, format: str = "combined") -> Fallible:
    """combined or error."""
    return named_groups(c, NGINX.get(format, NGINX["combined"]), NUMBERS)


def parse_glog(c: Column) -> Fallible:
    return named_groups(c, GLOG, {"id", "line"})


def parse_klog(c: Column) -> Fallible:
    return named_groups(c, KLOG, {"id", "line"})


def parse_syslog(c: Column) -> Column:
    """Both kinds of syslog line in one struct, null where a kind has no such field; a line of neither is all message."""
    head = r"^<(\d{1,3})>"
    code = F.regexp_extract(c, head, 1).try_cast("int")
    rest = F.regexp_replace(c, head, "")
    version = F.when(code.isNotNull(), F.regexp_extract(rest, r"^(\d)\s", 1).try_cast("bigint"))
    body = F.when(version.isNotNull(), F.regexp_replace(rest, r"^\d\s+", "")).otherwise(rest)
    new, old = named_groups(body, SYSLOG_NEW), named_groups(body, SYSLOG_OLD, optional={"procid"})
    names = lambda table, at: F.get(F.array(*map(F.lit, table)), at)
    of = lambda name: F.when(version.isNotNull(), new.value[name]).otherwise(old.value[name])
    message = F.when(version.isNotNull(), new.value["message"]).otherwise(F.coalesce(old.value["message"], rest))
    return F.struct(
        F.when(code < 192, names(FACILITIES, F.shiftright(code, 3))).alias("facility"),
        F.when(code < 192, names(SEVERITIES, code % 8)).alias("severity"),
        version.alias("version"),
        *[of(n).alias(n) for n in ("timestamp", "hostname", "appname", "procid")],
        F.when(version.isNotNull(), new.value["msgid"]).alias("msgid"),
        message.alias("message"),
    )


def parse_linux_authorization(c: Column) -> Column:
    return parse_syslog(c)


def parse_cef(c: Column) -> Fallible:
    """Seven fields, and the extension's keys as a map of strings."""
    parts = F.split(F.regexp_replace(c, "^CEF:", ""), r"\|", 8)
    fields = [F.get(parts, i).alias(n) for i, n in enumerate(CEF)]
    return fallible(c.startswith("CEF:") & (F.size(parts) >= 7), F.struct(*fields, parse_key_value(F.coalesce(F.get(parts, 7), F.lit(""))).alias("extension")), "parse_cef: no match")


def _positional(parts: Column, names: tuple[str, ...], numbers: set[str]) -> Column:
    at = lambda i: F.nullif(F.get(parts, i), F.lit("-"))
    return F.struct(*[(at(i).try_cast("bigint") if n in numbers else at(i)).alias(n) for i, n in enumerate(names)])


def parse_aws_vpc_flow_log(c: Column) -> Column:
    return _positional(F.split(F.trim(c), " +"), VPC_FLOW, VPC_NUMBERS)


def parse_aws_alb_log(c: Column) -> Column:
    quoted = F.regexp_extract_all(c, F.lit(r'("[^"]*"|\S+)'), F.lit(1))
    return _positional(F.transform(quoted, lambda t: F.regexp_replace(t, '^"|"$', "")), ALB, ALB_NUMBERS)


def parse_aws_cloudwatch_log_subscription_message(c: Column) -> Fallible:
    return parse_json(c, "owner string, messageType string, logGroup string, logStream string, subscriptionFilters array<string>, logEvents array<struct<id:string,timestamp:bigint,message:string>>")


def parse_ruby_hash(c: Column) -> Fallible:
    """A Ruby hash literal as JSON text: symbols, => and nil are put in JSON's terms outside of strings."""

    @F.pandas_udf("string")
    def rewrite(values: pd.Series) -> pd.Series:
        token = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|=>|\bnil\b|:?[A-Za-z_]\w*(?:\s*:(?!:))?|.', re.S)

        def put(m: re.Match) -> str:
            t = m.group()
            if t[0] == "'":
                return json.dumps(t[1:-1])
            if t in ("true", "false"):
                return t
            if re.fullmatch(r"[A-Za-z_]\w*\s*:", t):
                return json.dumps(t[:-1].strip()) + ":"
            return {"=>": ":", "nil": "null"}.get(t) or (json.dumps(t.lstrip(":")) if re.fullmatch(r":?[A-Za-z_]\w*", t) else t)

        def one(v):
            try:
                return None if v is None or not v.lstrip().startswith("{") else json.dumps(json.loads(token.sub(put, v)), separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return values.map(one)

    out = rewrite(c)
    return fallible(out.isNotNull(), out, "parse_ruby_hash: invalid hash")


def parse_influxdb(c: Column) -> Column:
    """Each line as measurement, tags, fields (both maps of strings) and timestamp, in an array."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    shape = r'^((?:[^ ",]|"[^"]*")+)(,(?:[^ "]|"[^"]*")*)? ((?:[^ "]|"[^"]*")+)(?: (-?\d+))?\s*$'
    integer = lambda m: F.transform_values(m, lambda _, v: F.regexp_replace(v, r"^(-?\d+)i$", "$1"))

    def line(x: Column) -> Column:
        tags, fields = F.regexp_replace(F.regexp_extract(x, shape, 2), "^,", ""), F.regexp_extract(x, shape, 3)
        return F.struct(
            F.regexp_extract(x, shape, 1).alias("measurement"),
            parse_key_value(tags, "=", ",").alias("tags"),
            integer(parse_key_value(fields, "=", ",")).alias("fields"),
            F.regexp_extract(x, shape, 4).try_cast("bigint").alias("timestamp"),
        )

    return F.transform(F.filter(lines, lambda x: x.rlike(shape)), line)


def parse_url(c: Column) -> Column:
    """Never fails: what is missing is empty, a missing port or fragment is null."""
    shape = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?(?:([^/?#]*)@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    part = lambda i: F.regexp_extract(c, shape, i)
    return F.struct(
        part(1).alias("scheme"),
        F.substring_index(part(2), ":", 1).alias("username"),
        F.when(F.contains(part(2), F.lit(":")), F.regexp_replace(part(2), "^[^:]*:", "")).otherwise("").alias("password"),
        part(3).alias("host"),
        part(4).try_cast("bigint").alias("port"),
        part(5).alias("path"),
        parse_query_string(part(6)).alias("query"),
        F.when(F.contains(c, F.lit("#")), part(7)).alias("fragment"),
    )


def grok_pattern(pattern: str) -> str:
    """%{NAME} and %{NAME:field} in plain notation; an unknown name stays as it is."""

    def put(m: re.Match) -> str:
        if m[1] not in GROK:
            return m[0]
        return f"(?<{m[2]}>{GROK[m[1]]})" if m[2] else f"(?:{GROK[m[1]]})"

    for _ in range(20):
        wider = re.sub(r"%\{(\w+)(?::(\w+))?\}", put, pattern)
        if wider == pattern:
            break
        pattern = wider
    return pattern


def parse_grok(c: Column, pattern: str) -> Fallible:
    return named_groups(c, grok_pattern(pattern))


def parse_groks(c: Column, patterns: list[str]) -> Fallible:
    """The first pattern that matches; the struct has the fields of all of them."""
    found = [named_groups(c, grok_pattern(p)) for p in patterns]
    fields = [sorted(java_regex(grok_pattern(p))[1]) for p in patterns]
    every = sorted({n for names in fields for n in names})
    value = F.coalesce(*[F.when(~f.failed(), F.struct(*[(f.value[n] if n in names else F.lit(None).cast("string")).alias(n) for n in every])) for f, names in zip(found, fields)])
    return fallible(value.isNotNull(), value, "parse_groks: no match")
