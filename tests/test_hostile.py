"""Values at and beyond the limits: each row has a result, none ends its query."""

from pyspark.sql import functions as F

from logloom.functions import codecs, collections, parsers

TOP, LOW = 2**63 - 1, -(2**63)


def test_parse_int_saturates(spark):
    want = {
        "99999999999999999999": TOP, "-99999999999999999999": LOW, "9223372036854775807": TOP, "9223372036854775808": TOP,
        "-9223372036854775808": LOW, "0xffffffffffffffff": TOP, "0x7fffffffffffffff": TOP, "0777777777777777777777": TOP,
        "01000000000000000000000": TOP, "0": 0, "00": 0, "-017": -15, "0000000000000000000000000000000000000000000000000000000000000000000000000000000012": 10,
        "9" * 127: TOP, "9" * 128: None, "": None, "x": None, None: None, " 12ab": 12,
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.v for r in rows.select("t", parsers.parse_int(F.col("t")).value.alias("v")).collect()} == want
    assert rows.select(parsers.parse_int(F.lit("z" * 13), 36).value, parsers.parse_int(F.lit("zz"), 36).value, parsers.parse_int(F.lit("1" * 64), 2).value).first()[:] == (TOP, 1295, TOP)


def test_objects_from_short_and_empty_arrays(spark):
    rows = spark.createDataFrame([([], []), ([1], []), ([1, 2, 3], ["a", "b"]), ([1, 2], ["a", "a"]), (None, ["a"])], "v array<int>, k array<string>")
    assert [r[0] for r in rows.select(collections.object_from_array(F.col("v"), F.col("k"))).collect()] == [{}, {}, {"a": 1, "b": 2}, {"a": 2}, None]


def test_malformed_mime_words(spark):
    rows = ["=?utf-8?B?abcde?=", "=?utf-8?B?YQ==?=", "=?x?B?a?=", "=?x?B?é=?=", "=?x?Q?=zz?=", "=?x?B??=", "", None, "=?utf-8?Q?a_b=C3=A9?="]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(codecs.decode_mime_q("t")).collect()]
    assert got[1] == "a" and got[2] == "" and got[6:] == ["", None, "a bé"] and len(got) == len(rows)
