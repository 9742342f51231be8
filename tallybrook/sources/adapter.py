"""The supplied ``events`` table in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EVENTS_DDL = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string")


def events_path(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/events.parquet"


def events_glob(sf_dir: str) -> str:
    """The same, for a stream: its file source takes a glob but no path of one file."""
    return f"{sf_dir.rstrip('/')}/{{events}}.parquet"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_DDL).parquet(events_path(sf_dir))


def as_events(raw: DataFrame) -> DataFrame:
    """Rows of the event table: id, event_type, user_id, timestamp, payload, ..."""
    return raw.select(
        F.col("event_id").alias("id"),
        "event_type",
        "user_id",
        F.col("ts").alias("timestamp"),
        F.col("props").alias("payload"),
        F.lit(None).cast("string").alias("source_ip"),
        F.lit(None).cast("timestamp").alias("processed_at"),
    )


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(raw_events(spark, sf_dir))


def _every(n: int) -> Column:
    return F.col("event_id") % n == 0


def as_requests(raw: DataFrame) -> DataFrame:
    """Client requests derived from the events, some of them made invalid.

    Whether and how a request is broken depends on its id alone.
    """
    r = F.col("event_id") % 1000
    thousand = F.floor(F.col("event_id") / 1000)
    return raw.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        (F.when(_every(17), "")
          .when(_every(19), F.repeat(F.lit("x"), 51))
          .when(_every(23), F.lit(None))
          .when(_every(43), F.repeat(F.lit(" "), 60))
          .otherwise(F.col("event_type"))).alias("event_type"),
        (F.when(_every(29), "  \t")
          .when(_every(31), F.repeat(F.lit("u"), 101))
          .otherwise(F.col("user_id").cast("string"))).alias("user_id"),
        F.when(~_every(37), F.col("props")).alias("payload"),
        F.col("user_id").cast("string").alias("api_key"),
        (F.when(_every(5), "")
          .when(_every(7), ",10.9.9.9")
          .when(~_every(3), F.concat(F.lit(" 203.0.113."),
                                     (F.col("event_id") % 250).cast("string"),
                                     F.lit(" , 10.0.0.1")))).alias("x_forwarded_for"),
        F.concat(F.lit("192.0.2."), (F.col("user_id") % 250).cast("string"))
         .alias("remote_addr"),
        # batches of three, and one of 150 in every thousand
        (thousand * 1000 + F.when(r < 150, 0).otherwise(F.floor((r - 150) / 3) + 1))
        .cast("bigint").alias("batch_id"),
    )


def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, segment, nation)`` of the customers in credit; other users have no profile."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return (customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"),
                    F.col("n_name").alias("nation")))


def as_request_arrays(requests: DataFrame) -> DataFrame:
    """Batch calls, each with the array of its requests in id order; some arrays are empty or null."""
    one = F.struct("id", "event_type", "user_id", "payload")
    sent = requests.groupBy("batch_id").agg(F.sort_array(F.collect_list(one)).alias("events"))
    number = F.col("batch_id")
    return sent.withColumn("events", F.when(number % 7 == 0, F.filter("events", lambda e: F.lit(False)))
                           .when(number % 11 != 0, F.col("events")))


def as_raw_messages(raw: DataFrame) -> DataFrame:
    """Stream messages (key, value = envelope JSON), some of them damaged."""
    envelope = F.to_json(F.struct(
        F.when(~_every(71), F.col("event_id").cast("string")).alias("id"),
        F.when(~_every(47), F.col("event_type")).alias("eventType"),
        F.when(~_every(53), F.col("user_id").cast("string")).alias("userId"),
        F.when(~_every(59), F.col("ts").cast("timestamp")).alias("timestamp"),
        F.when(~_every(61), F.from_json("props", "map<string,variant>")).alias("payload"),
        F.lit("web").alias("source"),
    ), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    broken = F.concat(F.lit('{"id":"'), F.col("event_id").cast("string"), F.lit('", bad'))
    listed = F.concat(F.lit('{"id":"'), F.col("event_id").cast("string"),
                      F.lit('","eventType":"click","userId":"1",'
                            '"timestamp":"2024-01-01T00:00:00Z","payload":[1]}'))
    return raw.select(
        F.col("user_id").cast("string").alias("key"),
        (F.when(_every(41), broken).when(_every(67), listed)
          .otherwise(envelope)).alias("value"),
    )
