"""How document filters overlap: what each removes in every order they may be applied.

Four filters look at a document alone. The fifth, copies, is an existential self-join: a
left-semi join on the text's hash, the exact text and a smaller id. Its ids are united
with the ids that fail the others, which gives each failing document a set of failed
filters as bits. Only those sets are counted; every order of the filters follows from
the counts.

Documents that fail nothing never leave their map task: they are the difference between a
part's rows and its failing rows. Texts are shuffled only where their hash occurs twice.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from .store import Folder

SPACE = r"[\x20\x09-\x0D]+"


def rules(text: str = "text", words: str = "words") -> dict[str, Column]:
    """The filters that need one document only: whether it fails, by letter.

    ``words`` holds all words of ``text``. Lengths are code points.
    """
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * upper > 2 * F.length(text),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


COPIES = "E"


def copies(docs: DataFrame, hashes: DataFrame, folder: Folder, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, hash, *keep)`` of each document whose exact text has a smaller id too.

    ``docs`` has ``doc_id``, ``text`` without nulls and ``hash``, the text's 64-bit hash;
    ``hashes`` has the same hashes without the texts.
    Of a group of copies only the smallest id meets the others, so a row is compared once,
    however large its group.
    A null id is smaller than nothing and nothing is smaller than it. Rows of one id are
    no copies of each other.
    """
    repeated = folder.cut(hashes.groupBy("hash").count().where("count > 1").select("hash"),
                          "repeated")
    some = folder.cut(docs.select("doc_id", "hash", "text", *keep)
                      .join(repeated, "hash", "left_semi"), "candidates")
    # written, so that Spark can split the rows of a large group over tasks of the join
    least = folder.cut(some.groupBy("hash", "text").agg(F.min("doc_id").alias("least")), "least")
    return (some.join(least.withColumnsRenamed({"hash": "_h", "text": "_t"}),
                      (F.col("hash") == F.col("_h")) & (F.col("text") == F.col("_t"))
                      & (F.col("least") < F.col("doc_id")), "left_semi")
            .select("doc_id", "hash", *keep))


def failures(docs: DataFrame, folder: Folder) -> tuple[DataFrame, DataFrame]:
    """``(part, n)`` of all documents, and ``(doc_id, part, bits, n)`` of failing ones.

    ``docs`` has ``doc_id``, ``part`` and ``text``; null parts and texts are empty. Bit i of
    ``bits`` stands for the i-th filter in ``letters()``. ``n`` counts equal rows.
    """
    opened = docs.select("doc_id", F.coalesce("part", F.lit("")).alias("part"),
                         F.coalesce("text", F.lit("")).alias("text"))
    opened = opened.withColumn("hash", F.xxhash64("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    judged = opened.withColumn("words", words)
    bits = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(rules().values())),
               F.lit(0))
    # written: the texts are read once for the rules, everything later needs these rows only
    judged = folder.cut(judged.select("doc_id", "part", "hash", bits.alias("bits")), "judged")
    found = copies(opened, judged, folder, ("part",))
    one = judged.where("bits > 0").withColumn("n", F.lit(1))
    two = found.select("doc_id", "part", "hash", F.lit(1 << len(rules())).alias("bits"),
                       F.lit(0).alias("n"))
    key = ["doc_id", "part", "hash"]
    united = (one.unionByName(two).groupBy(*key)
              .agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"),
                   F.count_if(F.col("n") == 0).alias("copies")))
    # copies that fail nothing else are in one half of the union only
    united = united.withColumn("n", F.greatest("n", "copies"))
    total = judged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return total, united.select("doc_id", "part", "bits", "n")


def letters() -> str:
    return "".join(rules()) + COPIES


def combinations(failing: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, bits, n, good, toxic)``: failing documents by the set of filters they fail.

    Labels that contradict each other count as each; null ids have none.
    """
    known = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("bigint")).alias("good"),
        F.max((F.col("toxic") == 1).cast("bigint")).alias("toxic"))
    return (failing.join(known, "doc_id", "left").groupBy("part", "bits")
            .agg(F.sum("n").alias("n"),
                 *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))))


def audit(docs: DataFrame, labels: DataFrame, folder: Folder) -> DataFrame:
    """One row per part, order of the filters and step of the order.

    ``kept`` documents are left after the step, ``removed`` went in it, ``redundant`` fail
    its filter but went before, ``unique_fails`` fail it alone; ``good_lost`` and
    ``toxic_lost`` are labelled ones among the removed. ``shapley`` is what the filter
    removes summed over all orders: a document that fails c filters is removed by each of
    them in one order of c.

    A table without documents gives no rows. A part has at most 31 sets of failed filters,
    which become one array; the orders are made from that, so no document is met again.
    """
    total, failing = failures(docs, folder)
    held = combinations(failing, labels).groupBy("part").agg(
        F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("sets"))
    parts = total.join(held, "part", "left")
    names = letters()
    orders = ",".join(map("".join, itertools.permutations(names)))
    n_orders = len(orders.split(","))
    rows = (parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
            .withColumn("_steps", F.transform(
                F.split("filter_order", ""), lambda c: F.call_function(
                    "shiftleft", F.lit(1), F.instr(F.lit(names), c) - 1)))
            .select("*", F.posexplode("_steps").alias("_at", "_bit"))
            .withColumn("_prior", F.aggregate(F.slice("_steps", F.lit(1), F.col("_at")),
                                              F.lit(0), lambda m, b: m.bitwiseOR(b))))

    def summed(weight, when):
        sets = F.coalesce("sets", F.array().cast(parts.schema["sets"].dataType))
        return F.aggregate(F.filter(sets, when), F.lit(0).cast("bigint"),
                           lambda total, s: total + weight(s))

    def fails(s):
        return s["bits"].bitwiseAND(F.col("_bit")) != 0

    def gone(s):
        return s["bits"].bitwiseAND(F.col("_prior")) != 0

    def here(s):
        return fails(s) & ~gone(s)

    def share(s):
        return s["n"] * (F.lit(n_orders) / F.bit_count(s["bits"])).cast("bigint")

    return rows.select(
        "part", "filter_order", (F.col("_at") + 1).cast("int").alias("step"),
        (F.col("n") - summed(lambda s: s["n"], lambda s: fails(s) | gone(s))).alias("kept"),
        summed(lambda s: s["n"], here).alias("removed"),
        summed(lambda s: s["n"], lambda s: fails(s) & gone(s)).alias("redundant"),
        summed(lambda s: s["n"], lambda s: s["bits"] == F.col("_bit")).alias("unique_fails"),
        summed(lambda s: s["good"], here).alias("good_lost"),
        summed(lambda s: s["toxic"], here).alias("toxic_lost"),
        summed(share, fails).alias("shapley"))
