"""Registered queries: the package's functions and operators over the driver's tables, and the same rows in SQL where it can say them.

Log lines are made from the tables' columns, so the work grows with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codecs, coerce, collections, crypto, ip, numbers, parsers, paths, strings, system, types
from ..operators import Remap, assemble, unnest_rows
from ..sources import from_lines, to_json_lines

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows dealt out to all cores: a file of one row group would be one task's, however much work its rows make."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def dotted(c: Column) -> Column:
    return ip.ip_ntoa(c)


IP_SQL = "concat_ws('.', ({0} >> 24) & 255, ({0} >> 16) & 255, ({0} >> 8) & 255, {0} & 255)"


@query("""
SELECT json_extract_string(props, '$.k')::BIGINT AS k, event_id, event_type, 'app' AS source_type,
       CASE WHEN event_type = 'error' THEN 'high' ELSE 'low' END AS severity, value * 2 AS doubled
FROM events WHERE event_type <> 'view'
""")
def remap_events(spark, sf_dir):
    """The flagship: parse a JSON field, abort some events, set fields by condition, drop others."""
    events = Remap(table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props"))
    out = (
        events.abort_if(F.col("event_type") == "view")
        .assign_must("parsed", parsers.parse_json(F.col("props"), "k bigint"))
        .assign("k", paths.get(F.col("parsed"), ["k"]))
        .branch(F.col("event_type") == "error", "severity", F.lit("high"), F.lit("low"))
        .assign("doubled", F.col("value") * 2)
        .assign("source_type", F.lit("app"))
        .drop("parsed").drop("props").drop("value")
    )
    return out.events


@query("""
SELECT event_type, count(*) AS events, sum(CASE WHEN json_extract_string(props, '$.k')::BIGINT > 50 THEN 1 ELSE 0 END)::BIGINT AS large,
       count(DISTINCT user_id) AS users
FROM events GROUP BY event_type
""")
def event_rollup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    k = parsers.parse_json(F.col("props"), "k bigint").value["k"]
    return events.withColumn("k", k).groupBy("event_type").agg(F.count("*").alias("events"), F.sum(F.when(F.col("k") > 50, 1).otherwise(0)).alias("large"), F.countDistinct("user_id").alias("users"))


@query("""
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS down, contains(p_name, 'ring') AS has_ring, starts_with(p_type, 'S') AS s_type, ends_with(p_name, 'bolt') AS bolt,
       contains(p_name, 'red') AND contains(p_name, 'gear') AS red_gear, replace(p_name, ' ', '_') AS snake, upper(replace(p_name, ' ', '_')) AS screaming,
       replace(p_name, ' ', '-') AS kebab, length(p_name) AS chars,
       CASE WHEN length(p_name) > 6 THEN left(p_name, 6) || '...' ELSE p_name END AS cut, strpos(p_name, ' ') - 1 AS space_at,
       regexp_matches(p_brand, '#1[0-9]*$') AS ones, replace(p_name, 'e', 'E') AS shown, regexp_replace(p_brand, '[0-9]', 'N', 'g') AS masked,
       split_part(p_name, ' ', 1) AS first_word, substr(p_name, 2, greatest(length(p_name) - 2, 0)) AS inner_part, trim(p_name) AS bare
FROM part
""")
def fn_strings(spark, sf_dir):
    c, brand = F.col("p_name"), F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", strings.upcase(c).alias("up"), strings.downcase(brand).alias("down"), strings.contains(c, "ring").alias("has_ring"), strings.starts_with(F.col("p_type"), "S").alias("s_type"),
        strings.ends_with(c, "bolt").alias("bolt"), strings.contains_all(c, ["red", "gear"]).alias("red_gear"), strings.snakecase(c).alias("snake"), strings.screamingsnakecase(c).alias("screaming"),
        strings.kebabcase(c).alias("kebab"), strings.strlen(c).cast("bigint").alias("chars"), strings.truncate(c, 6, True).alias("cut"), strings.find(c, " ").cast("bigint").alias("space_at"),
        strings.match(brand, "#1[0-9]*$").alias("ones"), strings.replace(c, "e", "E").alias("shown"), strings.redact(brand, [r"[0-9]"], "N").alias("masked"),
        strings.split(c, " ")[0].alias("first_word"), strings.slice_(c, 1, -1).alias("inner_part"), strings.strip_whitespace(c).alias("bare"),
    )


@query("""
SELECT p_partkey, split_part(p_name, ' ', 1) || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS camel,
       upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS pascal,
       p_type || '.txt' AS base, '/srv/' || p_brand AS dir, 'srv|' || p_brand || '|' || p_type || '.txt' AS steps, p_name AS plain,
       regexp_replace(p_brand, '[^0-9]', '', 'g') AS kept, regexp_replace(p_brand, '([0-9]+)', '<\\1>', 'g') AS wrapped, contains(p_name, 'blue') OR regexp_matches(p_name, 'ring$') AS any_hit
FROM part
""")
def fn_strings_more(spark, sf_dir):
    c, brand = F.col("p_name"), F.col("p_brand")
    path = text_of("/srv/", brand, "/", F.col("p_type"), ".txt")
    return table(spark, sf_dir, "part").select(
        "p_partkey", strings.camelcase(c).alias("camel"), strings.pascalcase(c).alias("pascal"), strings.basename(path).alias("base"), strings.dirname(path).alias("dir"),
        strings.join(strings.split_path(path), "|").must().alias("steps"), strings.strip_ansi_escape_codes(text_of("\x1b[1m", c, "\x1b[0m")).alias("plain"), strings.sieve(brand, "[0-9]").alias("kept"),
        strings.replace_with(brand, "[0-9]+", lambda m: F.concat(F.lit("<"), m, F.lit(">"))).alias("wrapped"), strings.match_any(c, ["blue", "ring$"]).alias("any_hit"),
    )


@query("""
SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal)::DOUBLE AS f, ceil(c_acctbal)::DOUBLE AS c, (c_custkey % 7)::BIGINT AS m, format('{:x}', c_custkey) AS hex, format('{:b}', c_custkey) AS bin,
       CASE WHEN c_nationkey = 0 THEN NULL ELSE c_custkey / c_nationkey END AS ratio, round(2 * 6371.0 * asin(sqrt(power(sin(radians(c_nationkey) / 2), 2))), 3) AS km
FROM customer
""")
def fn_numbers(spark, sf_dir):
    c = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", numbers.abs_(c).alias("a"), numbers.floor(c).alias("f"), numbers.ceil(c).alias("c"), numbers.mod(F.col("c_custkey"), F.lit(7)).must().cast("bigint").alias("m"),
        numbers.format_int(F.col("c_custkey"), 16).alias("hex"), numbers.format_int(F.col("c_custkey"), 2).alias("bin"), numbers.divide(F.col("c_custkey"), F.col("c_nationkey")).value.alias("ratio"),
        F.round(numbers.haversine(F.lit(0.0), F.lit(0.0), F.col("c_nationkey").cast("double"), F.lit(0.0)), 3).alias("km"),
    )


@query("""
SELECT s_suppkey, format('{:,.2f}', s_acctbal) AS grouped, round(s_acctbal)::DOUBLE AS rounded FROM supplier
""")
def fn_format_number(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", numbers.format_number(F.col("s_acctbal"), 2).alias("grouped"), numbers.round_(F.col("s_acctbal")).alias("rounded"))


@query("""
SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s256, lower(hex(c_name)) AS b16, replace(to_base64(encode(c_name)), chr(10), '') AS b64, url_encode(c_name || ' ~*') AS pct
FROM customer
""")
def fn_digests(spark, sf_dir):
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", crypto.md5(c).alias("m"), crypto.sha1(c).alias("s1"), crypto.sha2(c, "SHA-256").alias("s256"), codecs.encode_base16(c).alias("b16"), codecs.encode_base64(c).alias("b64"),
        codecs.encode_percent(text_of(c, " ~*")).alias("pct"),
    )


@query("""
SELECT c_custkey, c_name AS b64, c_name AS b16, c_name || ' %' AS pct, c_name AS cbc, c_name AS cfb, c_name AS ofb, c_name AS ctr, c_mktsegment AS puny, true AS crc_ok FROM customer
""")
def fn_round_trips(spark, sf_dir):
    """What is encoded comes back."""
    c, iv = F.col("c_name"), F.lit("0123456789abcdef")
    there = lambda name, n: crypto.decrypt(crypto.encrypt(c, name, F.lit("k" * n), iv), name, F.lit("k" * n), iv).cast("string")
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")).select(
        "c_custkey", codecs.decode_base64(codecs.encode_base64(c, "url_safe", False)).must().alias("b64"), codecs.decode_base16(codecs.encode_base16(c)).must().alias("b16"),
        codecs.decode_percent(codecs.encode_percent(text_of(c, " %"))).alias("pct"), there("AES-128-CBC-PKCS7", 16).alias("cbc"), there("AES-256-CFB", 32).alias("cfb"), there("AES-192-OFB", 24).alias("ofb"),
        there("AES-128-CTR", 16).alias("ctr"), codecs.decode_punycode(codecs.encode_punycode(F.col("c_mktsegment"))).must().alias("puny"), (crypto.crc(c) == F.crc32(c.cast("binary")).cast("string")).alias("crc_ok"),
    )


@query()
def fn_hashes(spark, sf_dir):
    """Hashes that SQL lacks: tests hold them against published vectors and other libraries."""
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", crypto.crc(c).alias("crc"), crypto.xxhash(c).alias("xx"), crypto.seahash(c).alias("sea"), crypto.sha2(c).alias("sha512_256"), crypto.sha3(c).alias("sha3"),
        codecs.encode_base16(crypto.hmac(c, F.lit("key"))).alias("mac"), strings.shannon_entropy(c).alias("entropy"),
    )


@query(f"""
WITH t AS (SELECT c_custkey, 3232235520 + c_custkey * 37 AS n FROM customer)
SELECT c_custkey, n AS aton, {IP_SQL.format('n')} AS ntoa, true AS v4, false AS v6, n BETWEEN 3232235520 AND 3232240639 AS inside, {IP_SQL.format('(n & 4294967040)')} AS net,
       '::ffff:' || {IP_SQL.format('n')} AS mapped, {IP_SQL.format('n')} AS back, {IP_SQL.format('n')} AS packed
FROM t
""")
def fn_ip(spark, sf_dir):
    c = dotted(F.lit(3232235520) + F.col("c_custkey") * 37)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", ip.ip_aton(c).must().alias("aton"), c.alias("ntoa"), ip.is_ipv4(c).alias("v4"), ip.is_ipv6(c).alias("v6"), (ip.ip_cidr_contains("192.168.0.0/20", c) | ip.ip_cidr_contains("192.168.16.0/22", c)).alias("inside"),
        ip.ip_subnet(c, "/24").must().alias("net"), ip.ip_to_ipv6(c).must().alias("mapped"), ip.ipv6_to_ipv4(ip.ip_to_ipv6(c).must()).must().alias("back"), ip.ip_ntop(ip.ip_pton(c)).alias("packed"),
    )


@query()
def fn_ip_ciphers(spark, sf_dir):
    """Address encryption comes back, and flows have one id from either end."""
    a, b = dotted(F.lit(167772160) + F.col("c_custkey")), dotted(F.lit(3232235520) + F.col("c_nationkey"))
    there = crypto.encrypt_ip(a, F.lit("sixteen byte key"))
    flow = lambda x, y, p, q: crypto.community_id(x, y, F.lit(6), p, q)
    one = flow(a, b, F.lit(80), F.col("c_custkey") % 1000 + 1024)
    return table(spark, sf_dir, "customer").select("c_custkey", a.alias("ip"), there.alias("encrypted"), crypto.decrypt_ip(there, F.lit("sixteen byte key")).alias("decrypted"), one.alias("flow"), (one == flow(b, a, F.col("c_custkey") % 1000 + 1024, F.lit(80))).alias("same"))


@query("""
SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds, epoch_ms(o_orderdate)::BIGINT AS millis, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS shown, strftime(o_orderdate, '%d/%m/%y') AS short,
       epoch(o_orderdate)::BIGINT AS parsed, epoch(o_orderdate)::BIGINT AS formatted, epoch(o_orderdate)::BIGINT AS numbered
FROM orders
""")
def fn_timestamps(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    iso = coerce.format_timestamp(at)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", coerce.to_unix_timestamp(at).alias("seconds"), coerce.to_unix_timestamp(at, "milliseconds").alias("millis"), iso.alias("shown"), coerce.format_timestamp(at, "%d/%m/%y").alias("short"),
        F.unix_seconds(coerce.parse_timestamp(iso).must()).alias("parsed"), F.unix_seconds(coerce.parse_timestamp(coerce.format_timestamp(at, "%d %b %Y"), "%d %b %Y").must()).alias("formatted"),
        F.unix_seconds(coerce.from_unix_timestamp(coerce.to_unix_timestamp(at))).alias("numbered"),
    )


@query("""
SELECT o_orderkey, left(o_orderpriority, 1)::BIGINT AS n, o_orderstatus = 'O' AS open, list_element(['emergency','alert','critical','error','warning','notice','informational','debug'], (o_orderkey % 8 + 1)::INT) AS level,
       (o_orderkey % 8)::INT AS severity, (o_orderkey % 24)::INT AS facility, trunc(o_totalprice)::BIGINT AS whole, left(o_orderpriority, 1)::DOUBLE AS f, o_orderkey::VARCHAR AS s
FROM orders
""")
def fn_coerce(spark, sf_dir):
    k = F.col("o_orderkey")
    level = coerce.to_syslog_level(k % 8).must()
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", coerce.to_int(F.col("o_orderpriority")).must().alias("n"), coerce.to_bool(F.when(F.col("o_orderstatus") == "O", "YES").otherwise("f")).must().alias("open"), level.alias("level"),
        coerce.to_syslog_severity(F.upper(level)).must().alias("severity"), coerce.to_syslog_facility_code(coerce.to_syslog_facility(k % 24).must()).must().alias("facility"),
        coerce.to_int(F.col("o_totalprice")).must().alias("whole"), coerce.to_float(F.regexp_extract("o_orderpriority", "^[0-9]", 0)).must().alias("f"), coerce.to_string(k).alias("s"),
    )


@query("""
SELECT o_orderkey, false AS nullish, true AS integer, false AS text, true AS floating, true AS stamp, 'integer' AS kind, 'expected string, got integer' AS wrong, false AS empty, true AS json, false AS bad_json,
       o_orderkey % 2 = 0 AS even FROM orders
""")
def fn_types(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", types.is_nullish(F.col("o_orderstatus")).alias("nullish"), types.is_integer(k).alias("integer"), types.is_string(k).alias("text"), types.is_float(F.col("o_totalprice")).alias("floating"),
        types.is_timestamp(F.col("o_orderdate")).alias("stamp"), types.type_def(k)["type"].alias("kind"), types.string(k).error.alias("wrong"), types.is_empty(F.col("o_orderstatus")).must().alias("empty"),
        types.is_json(text_of('{"k": ', k, "}")).alias("json"), types.is_json(text_of('{"k": ', k, "")).alias("bad_json"), types.assert_eq(k % 2, F.lit(0).cast("bigint")).or_else(F.lit(False)).alias("even"),
    )


@query("""
SELECT o_custkey, count(*) AS n, list_distinct(list(o_orderstatus)).len()::INT AS kinds, count(*) FILTER (o_orderstatus = 'O')::INT AS open, bool_or(o_orderstatus = 'P') AS has_p,
       ceil(count(*) / 3.0)::INT AS triples, (count(*) - 1)::INT AS popped, (count(*) + 1)::INT AS pushed, bool_and(o_orderstatus IN ('O', 'F')) AS all_of
FROM orders GROUP BY o_custkey
""")
def fn_arrays(spark, sf_dir):
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_list("o_orderstatus").alias("a"))
    a = F.col("a")
    counted = F.coalesce(F.try_element_at(collections.tally(a), F.lit("O")), F.lit(0))
    return grouped.select(
        "o_custkey", "n", F.size(collections.unique(a)).alias("kinds"), counted.alias("open"), collections.includes(a, F.lit("P")).alias("has_p"), F.size(collections.chunks(a, 3)).alias("triples"),
        F.size(collections.pop(a)).alias("popped"), F.size(collections.push(a, F.lit("X"))).alias("pushed"), collections.match_array(a, "^[OF]$", True).alias("all_of"),
    )


@query("""
SELECT event_id, 'k' AS names, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS merged, event_type AS added, json_extract_string(props, '$.k') AS renamed,
       'k=' || json_extract_string(props, '$.k') AS kept, 'k=' || json_extract_string(props, '$.k') || ' t=' || event_type AS line
FROM events
""")
def fn_objects(spark, sf_dir):
    o = F.from_json("props", "map<string,string>")
    more = F.create_map(F.lit("t"), F.col("event_type"))
    merged = collections.merge(o, more)
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(collections.keys(o), ",").alias("names"), F.array_join(collections.values(o), ",").alias("k"), merged["k"].alias("merged"), merged["t"].alias("added"),
        collections.map_keys(o, F.upper)["K"].alias("renamed"), codecs.encode_key_value(collections.filter_(merged, lambda k, v: k == "k", T.MapType(T.StringType(), T.StringType()))).alias("kept"),
        codecs.encode_logfmt(collections.from_entries(collections.to_entries(merged)).must()).alias("line"),
    )


@query("""
SELECT event_id, event_type IN ('error', 'click') AND value > 10 AS hit, NOT event_type = 'view' AS other, value BETWEEN 2 AND 5 AS between_, starts_with(event_type, 'p') AS wild FROM events
""")
def fn_search(spark, sf_dir):
    fields = {"type": F.col("event_type"), "value": F.col("value")}
    found = {"hit": "(type:error OR type:click) AND value:>10", "other": "-type:view", "between_": "value:[2 TO 5]", "wild": "type:p*"}
    return table(spark, sf_dir, "events").select("event_id", *[collections.match_datadog_query(fields, q).alias(n) for n, q in found.items()])


ACCESS_SQL = "'10.0.0.' || (o_custkey % 250) || ' - user' || o_custkey || ' [' || strftime(o_orderdate, '%d/%m/%Y') || '] \"GET /order/' || o_orderkey || ' HTTP/1.1\" ' || (200 + o_orderkey % 5) || ' ' || o_custkey"


def access_line() -> Column:
    day = coerce.format_timestamp(F.col("o_orderdate").cast("timestamp"), "%d/%m/%Y")
    return text_of("10.0.0.", F.col("o_custkey") % 250, " - user", F.col("o_custkey"), " [", day, '] "GET /order/', F.col("o_orderkey"), ' HTTP/1.1" ', F.col("o_orderkey") % 5 + 200, " ", F.col("o_custkey"))


@query(f"""
WITH t AS (SELECT o_orderkey, {ACCESS_SQL} AS line, * EXCLUDE o_orderkey FROM orders)
SELECT o_orderkey, '10.0.0.' || (o_custkey % 250) AS host, 'user' || o_custkey AS "user", strftime(o_orderdate, '%d/%m/%Y') AS "timestamp", 'GET' AS method, '/order/' || o_orderkey AS path,
       'HTTP/1.1' AS protocol, 200 + o_orderkey % 5 AS status, o_custkey AS size, 'bot' AS agent, md5(line) AS digest
FROM t
""")
def parse_access_logs(spark, sf_dir):
    line = access_line()
    log = parsers.parse_apache_log(text_of(line, ' "-" "bot"'), "combined").must()
    rows = table(spark, sf_dir, "orders").select("o_orderkey", log.alias("log"), crypto.md5(line).alias("digest"))
    return rows.select("o_orderkey", *[F.col(f"log.{n}").alias(n) for n in ("host", "user", "timestamp", "method", "path", "protocol", "status", "size", "agent")], "digest")


@query("""
SELECT '/order/' || (o_orderkey % 10) AS path, 200 + o_orderkey % 5 AS status, count(*) AS hits, sum(o_custkey)::BIGINT AS bytes FROM orders GROUP BY ALL
""")
def access_log_report(spark, sf_dir):
    """Lines to a report: parse, fail over to a default, group."""
    line = strings.replace(access_line(), re.compile(r"/order/\d*(\d) "), "/order/_ ")
    short = F.concat(F.lit("/order/"), (F.col("o_orderkey") % 10).cast("string"))
    log = parsers.parse_common_log(line).must()
    return table(spark, sf_dir, "orders").select(short.alias("path"), log["status"].alias("status"), log["size"].alias("size")).groupBy("path", "status").agg(F.count("*").alias("hits"), F.sum("size").alias("bytes"))


@query("""
SELECT event_id, 'warning' AS severity, 'auth' AS facility, 'host' || user_id AS hostname, event_type AS appname, user_id::VARCHAR AS procid, 'value ' || event_id AS message FROM events
""")
def parse_syslogs(spark, sf_dir):
    line = text_of("<36>Oct 11 22:14:15 host", F.col("user_id"), " ", F.col("event_type"), "[", F.col("user_id"), "]: value ", F.col("event_id"))
    rows = table(spark, sf_dir, "events").select("event_id", parsers.parse_syslog(line).alias("s"))
    return rows.select("event_id", *[F.col(f"s.{n}").alias(n) for n in ("severity", "facility", "hostname", "appname", "procid", "message")])


@query("""
SELECT event_id, user_id::VARCHAR AS "user", event_type AS type, json_extract_string(props, '$.k') AS k, event_type || '|' || user_id AS row_, event_type || ',' || user_id AS fields, user_id AS n, (user_id * 60)::DOUBLE AS seconds,
       (user_id * 1024)::DOUBLE AS size FROM events
""")
def parse_pairs_and_numbers(spark, sf_dir):
    user, kind = F.col("user_id"), F.col("event_type")
    pairs = parsers.parse_key_value(text_of("user=", user, ' type="', kind, '" bare'))
    grok = parsers.parse_grok(text_of(kind, " ", user), "%{WORD:kind} %{INT:who}").must()
    return table(spark, sf_dir, "events").select(
        "event_id", pairs["user"].alias("user"), pairs["type"].alias("type"), parsers.parse_query_string(text_of("?k=", F.get_json_object("props", "$.k"), "&z=1"))["k"][0].alias("k"),
        text_of(grok["kind"], "|", grok["who"]).alias("row_"), F.array_join(parsers.parse_csv(text_of('"', kind, '",', user)), ",").alias("fields"), parsers.parse_int(text_of("0x", F.lower(F.hex(user)))).must().alias("n"),
        parsers.parse_duration(text_of(user, "m"), "s").must().alias("seconds"), parsers.parse_bytes(text_of(user, "KiB")).must().alias("size"),
    )


@query("""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#:]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
       CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS fragment, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page
FROM pages
""")
def parse_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", parsers.parse_url(F.col("url")).alias("u"))
    return rows.select("page_id", "u.scheme", "u.host", "u.path", "u.fragment", F.coalesce(F.try_element_at("u.query", F.lit("page"))[0], F.lit("")).alias("page"))


@query("""
SELECT c_custkey, '10.1.0.' || (c_custkey % 200) AS src, c_custkey AS packets, 'ACCEPT' AS action, c_name AS cef_name, c_mktsegment AS segment, 'cpu' AS measurement, c_custkey::VARCHAR AS v, 'I' AS level, 'run ' || c_custkey AS message FROM customer
""")
def parse_cloud_lines(spark, sf_dir):
    k = F.col("c_custkey")
    flow = parsers.parse_aws_vpc_flow_log(text_of("2 acct eni 10.1.0.", k % 200, " 10.2.0.1 80 443 6 ", k, " 840 1 2 ACCEPT OK"))
    cef = parsers.parse_cef(text_of("CEF:0|Vendor|Product|1.0|100|", F.col("c_name"), "|5|seg=", F.col("c_mktsegment"))).must()
    flux = parsers.parse_influxdb(text_of("cpu,host=a value=", k, "i 12"))[0]
    klog = parsers.parse_klog(text_of("I0505 17:59:40.692994   28133 run.go:70] run ", k)).must()
    return table(spark, sf_dir, "customer").select(
        "c_custkey", flow["srcaddr"].alias("src"), flow["packets"].alias("packets"), flow["action"].alias("action"), cef["name"].alias("cef_name"), cef["extension"]["seg"].alias("segment"),
        flux["measurement"].alias("measurement"), flux["fields"]["value"].alias("v"), klog["level"].alias("level"), klog["message"].alias("message"),
    )


@query("""
WITH marked AS (SELECT conv_id, turn, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS grp, role FROM conversations),
records AS (SELECT conv_id, grp, string_agg('[' || role || '] ' || replace(text, chr(10), ' '), chr(10) ORDER BY turn, '[' || role || '] ' || replace(text, chr(10), ' ')) AS record FROM marked GROUP BY ALL)
SELECT conv_id::VARCHAR AS stream_id, (row_number() OVER (PARTITION BY conv_id ORDER BY grp) - 1)::BIGINT AS record_no, record FROM records
""")
def multiline_records(spark, sf_dir):
    """Turns as lines; a user's turn starts a record."""
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), text_of("[", F.col("role"), "] ", F.replace("text", F.lit("\n"), F.lit(" "))).alias("line"))
    return assemble(lines, r"^\[user\]", "halt_before")


@query("""
SELECT doc_id::VARCHAR AS stream_id, count(*) AS records FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1
""")
def multiline_lines(spark, sf_dir):
    """Every line ends a record: as many records as lines."""
    parts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stream_id"), F.posexplode(strings.split(F.col("text"), "\n")).alias("seq", "line"))
    return assemble(parts, "", "halt_with").groupBy("stream_id").agg(F.count("*").alias("records"))


@query("""
SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')) AS token FROM documents) GROUP BY ALL
""")
def unnest_addresses(spark, sf_dir):
    found = F.transform(parsers.parse_regex_all(F.col("text"), r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"), lambda m: m["0"])
    return unnest_rows(table(spark, sf_dir, "documents").select("doc_id", found.alias("token")), "token").groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("""
SELECT '{"message":"' || event_type || '","source_type":"app"}' AS json, count(*) AS n FROM events GROUP BY event_type
""")
def events_as_json(spark, sf_dir):
    return to_json_lines(from_lines(table(spark, sf_dir, "events"), "event_type", "app")).groupBy("json").agg(F.count("*").alias("n"))


@query("""
SELECT event_id, event_type AS old, 'new' AS made, user_id AS moved FROM events
""")
def paths_in_events(spark, sf_dir):
    """Set, get and remove by path, with objects made on the way."""
    program = Remap(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")).assign("meta.kind.old", F.col("event_type")).assign("meta.kind.made", F.lit("new")).assign("meta.user", F.col("user_id"))
    program = program.drop("meta.kind.none").drop("event_type").drop("user_id")
    return program.events.select("event_id", paths.get(F.col("meta"), ["kind", "old"]).alias("old"), F.col("meta.kind.made").alias("made"), F.col("meta.user").alias("moved")).where(program.exists("meta.kind.made"))


@query()
def random_columns(spark, sf_dir):
    """Random and surrounding values: tests hold their ranges and forms."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", system.random_bool().alias("flag"), system.random_int(5, 9).alias("whole"), system.random_float(1.0, 2.0).alias("part"), system.uuid_v4().alias("v4"), system.uuid_v7().alias("v7"),
        F.octet_length(system.random_bytes(12)).alias("bytes"), system.uuid_from_friendly_id(F.col("c_custkey").cast("string")).must().alias("friendly"), system.get_timezone_name().alias("zone"),
    )
