import json

from pyspark.sql import functions as F

from tallybrook.functions import payload as P, scalars, time as T
from tallybrook.session import configure


def one(df):
    return df.collect()[0][0]


def values(spark, kind, items, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_category(spark):
    names = ["page_view", "CLICK", "hover", "Purchase", "checkout", "login", "password_reset",
             "search", "sort", "error", "timeout", "view", "", None]
    assert values(spark, "string", names, scalars.category) == [
        "engagement", "engagement", "engagement", "commerce", "commerce", "auth", "auth",
        "discovery", "discovery", "error", "error", "other", "other", None]


def test_severity_edges(spark):
    assert values(spark, "double", [5.0, 5.1, 3.0, 3.1, 0.0], scalars.severity) == [
        "MEDIUM", "HIGH", "LOW", "MEDIUM", "LOW"]


def test_client_ip(spark):
    df = spark.createDataFrame(
        [(0, "client, proxy1, proxy2", "r"), (1, " a ", "r"), (2, "", "r"), (3, ",", "r"),
         (4, None, "r")], "i int, x string, r string")
    got = [r[0] for r in df.orderBy("i").select(scalars.client_ip("x", "r")).collect()]
    assert got == ["client", "a", "r", "r", "r"]


def test_not_blank(spark):
    assert values(spark, "string", ["a", " a ", "", "  ", "\t\n", "\x00", None, "é"],
                  scalars.not_blank) == [True, True, False, False, False, False, False, True]


def test_violations(spark):
    df = spark.createDataFrame(
        [(0, "click", "u", "{}"), (1, "click", None, None), (2, " " * 51, "x" * 101, "{}"),
         (3, "x" * 50, "y" * 100, "{}")],
        "i int, event_type string, user_id string, payload string")
    got = df.orderBy("i").select(scalars.violations().alias("v"), scalars.is_valid().alias("ok"))
    rows = got.collect()
    assert [r.v for r in rows] == [
        [], ["userId: userId is required", "payload: payload is required"],
        ["eventType: eventType is required",
         "eventType: eventType must be under 50 characters",
         "userId: userId must be under 100 characters"], []]
    assert [r.ok for r in rows] == [True, False, False, True]


def test_payload_merge_keeps_types_and_replaces_keys(spark):
    configure(spark)
    text = '{"a":1,"b":{"c":[1,2.5,null]},"d":"x","e":true,"_enriched":"no"}'
    df = spark.createDataFrame([(text,)], "payload string")
    merged = json.loads(one(df.select(P.merge(P.open_object("payload"), {
        "_enriched": F.lit(True), "_n": F.lit(3), "_s": F.lit('q"q')}))))
    assert merged == {"a": 1, "b": {"c": [1, 2.5, None]}, "d": "x", "e": True,
                      "_enriched": True, "_n": 3, "_s": 'q"q'}


def test_payload_size_and_shape(spark):
    texts = ['{"a":1,"b":{"x":1,"y":2}}', "{}", '{"a":1,"a":2}']
    assert values(spark, "string", texts, lambda c: P.size(P.open_object(c))) == [
        2, 0, 1]
    assert values(spark, "string", ['{"a":1}', "[1]", "{bad", "1", None], P.is_object) == [
        True, False, False, False, False]
    assert values(spark, "string", ["{bad", "[1]"], lambda c: F.size(P.parse(c))) == [0, 0]


def test_buckets(spark):
    df = spark.sql("SELECT timestamp'2024-01-02 23:59:59.9' AS t")
    row = df.select(T.day_bucket("t"), T.hour_bucket("t"),
                    T.window_start("t").cast("string")).collect()[0]
    assert tuple(row) == ("2024-01-02", "2024-01-02-23", "2024-01-02 23:59:00")


def test_clamp(spark):
    assert [T.clamp(v, 1, 100, 7) for v in (150, -5, 50, None)] == [100, 1, 50, 7]
    assert values(spark, "int", [150, -5, 50, None],
                  lambda c: T.clamp_column(c, 1, 100, 7)) == [100, 1, 50, 7]


def test_threshold_status(spark):
    assert values(spark, "long", [0, 1, 9, 10],
                  lambda c: scalars.threshold_status(c, 1, 10)) == [
        "green", "yellow", "yellow", "red"]
