"""URL filter: host and path rules first, boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRAIN_ROWS = 50_000      # labelled URLs a model is fitted on, at most about as many
FEATURES = ("url_chars", "host_chars", "path_chars", "depth", "labels", "digit_ratio",
            "host_digit_ratio", "mark_ratio", "hyphens", "host_entropy", "path_entropy",
            "params", "fragment", "https", "suffix_urls", "suffix_hosts", "suffix_path_chars")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest rule that fits, else nulls.

    ``rules`` is a short list (one expression each). Equally long rules: the first listed.
    """
    named = verdict = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = (((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host))
                & F.col("path").startswith(rule.path))
        named = F.when(fits, rule.name).otherwise(named)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return urls.withColumn("rule", named).withColumn("rule_verdict", verdict)


def entropy(text: Column) -> Column:
    """Shannon entropy (bits) of the characters of a text; 0 for an empty one."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    counts = F.transform(F.array_distinct(chars), lambda c: n - F.size(F.array_remove(chars, c)))
    return F.aggregate(counts, F.lit(0.0), lambda total, c: total - c / n * F.log2(c / n))


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_statistics(urls: DataFrame) -> DataFrame:
    """URLs, hosts and mean path length of each host suffix, over all rows."""
    return (urls.groupBy(suffix(F.col("host")).alias("suffix"))
            .agg(F.log1p(F.count("*")).alias("suffix_urls"),
                 F.log1p(F.approx_count_distinct("host")).alias("suffix_hosts"),
                 F.avg(F.length("path")).alias("suffix_path_chars")))


def with_features(urls: DataFrame, folder: store.Folder) -> DataFrame:
    """Adds the columns of ``FEATURES`` to ``(url, host, path)`` rows."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")

    def share(pattern: str, text: Column) -> Column:
        kept = F.length(F.regexp_replace(text, pattern, ""))
        return F.coalesce(F.try_divide(F.length(text) - kept, F.length(text)), F.lit(0.0))

    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    rows = urls.select(
        "*", F.length(url).cast("double").alias("url_chars"),
        F.length(host).cast("double").alias("host_chars"),
        F.length(path).cast("double").alias("path_chars"),
        F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double").alias("depth"),
        F.size(F.split(host, r"\.")).cast("double").alias("labels"),
        share("[0-9]", url).alias("digit_ratio"), share("[0-9]", host).alias("host_digit_ratio"),
        share(r"[^A-Za-z0-9]", url).alias("mark_ratio"),
        (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        entropy(host).alias("host_entropy"), entropy(path).alias("path_entropy"),
        F.size(F.filter(F.split(query, "&"), lambda s: s != "")).cast("double").alias("params"),
        F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        F.startswith(url, F.lit("https")).cast("double").alias("https"),
        suffix(host).alias("suffix"))
    known = store.small_or_shuffled(folder.cut(suffix_statistics(urls), "suffixes"))
    return rows.join(known, "suffix", "left").drop("suffix")


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features",
                           handleInvalid="keep").transform(rows)


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, rounds: int = 20, depth: int = 4,
        seed: int = 17):
    """Boosted trees for ``label`` (1: block). None if only one label occurs, or none.

    Fitted on a bounded sample: about ``rows`` labelled URLs, chosen by their hash. Repeats
    of a URL count once, so a crowded page does not outweigh the rest.
    """
    from pyspark.ml.classification import GBTClassifier
    labelled = labelled.dropDuplicates(["url", "label"])
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    share = min(1.0, rows / sum(n.values()))
    sample = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(share * (1 << 20)))
    model = GBTClassifier(labelCol="label", featuresCol="_features", maxIter=rounds, maxDepth=depth, seed=seed)
    return model.fit(_vectors(sample.withColumn("label", F.col("label").cast("double"))))


def judge(pages: DataFrame, rules: Sequence[Rule], folder: store.Folder, keep: Sequence[str] = ("page_id",),
          labelled: DataFrame | None = None) -> DataFrame:
    """``(*keep, host, path, rule, verdict, score)`` of every row with a ``url``.

    The verdict is that of the longest rule, else that of trees trained on ``labelled``
    ``(url, label)``; without such rows, the URLs that rules decide are the labelled ones.
    ``score`` is the trees' probability of a block, null where no model could be fitted;
    then, and for a null URL or one without a host, URLs outside all rules are allowed.
    Rows are judged one by one: repeated rows get the same verdict.
    """
    from pyspark.ml.functions import vector_to_array

    def split(df: DataFrame, *more: str) -> DataFrame:
        host, path = parts(F.col("url"))
        return df.select(*more, "url", host.alias("host"), path.alias("path"))

    rows = folder.cut(with_features(ruled(split(pages, *keep), rules), folder), "features")
    if labelled is None:
        known = rows.where("rule_verdict is not null").withColumn(
            "label", (F.col("rule_verdict") == "block").cast("int"))
    else:
        known = with_features(split(labelled, "label"), folder)
    model = fit(known)
    if model is None:
        scored = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.transform(_vectors(rows)).withColumn(
            "score", vector_to_array("probability")[1])
    own = F.when((F.col("host") != "") & (F.col("score") >= 0.5), "block").otherwise("allow")
    return scored.select(*keep, "host", "path", "rule",
                         F.coalesce("rule_verdict", own).alias("verdict"), "score")
