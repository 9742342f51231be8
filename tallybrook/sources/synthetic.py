"""Load-test events drawn from row numbers, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the load generator.
EVENT_TYPES = ["page_view", "click", "purchase", "search", "login", "scroll",
               "add_to_cart", "signup", "error", "logout"]
PAGES = ["/home", "/products", "/cart", "/checkout", "/profile", "/settings",
         "/search", "/about"]
USERS = 100
MAX_DURATION = 300

_MODULUS = 2147483647


def _draw(n: str, stream: int, sides: int) -> Column:
    """A number in ``0..sides-1`` that depends on the row number and the stream."""
    x = (F.col(n) + F.lit(1 + 7919 * stream)) % _MODULUS
    for factor in (48271, 69621, 16807):
        x = (x * F.lit(factor).cast("bigint") + F.lit(12345 + stream)) % _MODULUS
    return x % sides


def _pick(choices: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (at + 1).cast("int"))


def load_events(numbers: DataFrame, n: str = "id") -> DataFrame:
    """One synthetic request per row number."""
    return numbers.select(
        F.col(n).alias("id"),
        _pick(EVENT_TYPES, _draw(n, 1, len(EVENT_TYPES))).alias("event_type"),
        F.format_string("user-%03d", _draw(n, 2, USERS)).alias("user_id"),
        _pick(PAGES, _draw(n, 3, len(PAGES))).alias("page"),
        _draw(n, 4, MAX_DURATION).cast("int").alias("duration"),
        F.concat(F.lit("sess-"), _draw(n, 5, 32768).cast("string")).alias("session_id"),
    )


def with_payload(drawn: DataFrame) -> DataFrame:
    """The drawn fields as a JSON payload."""
    body = F.struct("page", "duration", F.col("session_id").alias("sessionId"),
                    F.lit("Chrome").alias("browser"), F.lit("web").alias("platform"))
    return (drawn.withColumn("payload", F.to_json(body))
            .drop("page", "duration", "session_id"))


def batch_source(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    return with_payload(load_events(spark.range(0, n, 1, partitions)))


def stream_source(spark: SparkSession, rows_per_second: int) -> DataFrame:
    rate = (spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load())
    drawn = with_payload(load_events(rate.withColumnRenamed("value", "id").drop("timestamp")))
    return drawn.withColumn("timestamp", F.current_timestamp())
