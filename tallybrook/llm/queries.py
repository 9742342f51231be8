"""Registered queries of this package, and SQL where SQL can express them."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (bpe, chat, decontam, embed_dedup, filter_audit, fingerprint, ngram_join,
               ranked, secret_scan, stages, store, token_output, toxicity, url_filter, warc)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, written as addressable codes and read back."""
    manifest = token_output.write(_table(spark, sf_dir, "documents"), store.Folder(spark, "op1"),
                                  public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read(manifest, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()),
                             "bigint").withColumnRenamed("ids", "ids_crc32")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids by the rank file, and the bytes they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = bpe.encode(_table(spark, sf_dir, "documents"), path, pattern, decoded=True)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text, base kinds and windows of high entropy."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def n(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"),
                        n("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


# A conversation that speaks in another template's control strings.
ODD_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations replayed from their event log, rendered, written and read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(ODD_CONVERSATION, turns.schema))
    rendered = chat.render(chat.fold(chat.log_of(turns)))
    back = chat.parse(store.Folder(spark, "op4").cut(rendered, "formatted"))
    each = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                       F.sha2(each, 256).alias("turns_sha256"),
                       F.length(learned).cast("bigint").alias("loss_chars"),
                       F.sha2(learned, 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and salvaged from them."""
    records = _table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload"))
    found = warc.read(warc.write(warc.with_revisits(records), store.Folder(spark, "op8")), payloads=False)
    number = "try_cast(regexp_extract({}, '^<urn:record:(.*)>$', 1) as bigint)"
    gap = F.concat(F.lit("gap in "), "path", F.lit(" at "), F.col("start").cast("string"))
    whole = F.when(F.col("status") == "record", True).otherwise(F.raise_error(gap).cast("boolean"))
    return found.where(whole).select(       # just written: a gap is an error here
        F.expr(number.format("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.expr(number.format("refers_to")).alias("refers_to"))


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with a cosine of 0.93 or more, and their components."""
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), store.Folder(spark, "op5"), 0.93)


def toxic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's toxicity by a classifier fitted on two thirds of the labels."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, stages.training_labels(_table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score",
        (F.col("score") >= stages.REJECT_TOXIC).cast("int").alias("predicted"))


def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, a row per document and item."""
    return decontam.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts whose 3-word shingles agree to 90 per cent."""
    return ngram_join.components(_table(spark, sf_dir, "documents"), store.Folder(spark, "op9"), 3, (90, 100))


# The rules of the URL query.
RULES = (
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules, else by trees trained on what the rules decide."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES, store.Folder(spark, "op10"))


def edited_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's fingerprint beside those of its edited text and of the next document."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return fingerprint.compare_edited(_table(spark, sf_dir, "documents"), parts)


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"),
                         store.Folder(spark, "op12"), 10)


def filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of each source in every order."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("part"), "text")
    return filter_audit.audit(docs, _table(spark, sf_dir, "labels"), store.Folder(spark, "op13"))


QUERIES = {
    "op1_token_ids": token_ids,
    "op2_secrets": secrets,
    "op3_byte_bpe": byte_bpe,
    "op4_chat": chats,
    "op5_near_vectors": near_vectors,
    "op6_toxicity": toxic_texts,
    "op7_decontamination": contaminated,
    "op8_warc": archives,
    "op9_similar_texts": similar_texts,
    "op10_urls": urls,
    "op11_fingerprints": edited_fingerprints,
    "op12_ranked_search": ranked_search,
    "op13_filter_audit": filter_interaction,
}


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(8 + length(role) + 1 + 8 + length(regexp_replace(text,
           '([<\[])(\\*)(\|turn\|>|\|end\|>|s>|/s>|INST\]|/INST\])', '\1\2\\\3', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

WARC_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (
  SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= 100
"""


VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

SIMILAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3
    THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) ON a = doc_id
"""


RANKED_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM d),
w AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, total GROUP BY term, big_n),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
s AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (doc_id), total GROUP BY 1, 2)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""

AUDIT_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
d AS (
  SELECT doc_id, part, len(words) < 200 AS a,
         100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e FROM w),
l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
x AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END ||
         CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END ||
         CASE WHEN e THEN 'E' ELSE '' END AS fails, coalesce(good, false) AS good,
         coalesce(toxic, false) AS toxic FROM d LEFT JOIN l USING (doc_id)),
f(letter) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o(filter_order) AS (
  SELECT '' UNION ALL
  SELECT filter_order || letter FROM o, f WHERE NOT contains(filter_order, letter)),
s AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter,
         left(filter_order, step - 1) AS prior
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5)),
c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM x GROUP BY 1, 2),
r AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails = letter AS alone,
         contains(fails, letter) AS failing, prior <> '' AND regexp_matches(fails, '[' || prior || '-]') AS gone
  FROM c, s),
g AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (failing AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (failing AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g
"""


def sql() -> dict[str, str]:
    return {"op4_chat": CHAT_SQL, "op5_near_vectors": VECTOR_SQL, "op8_warc": WARC_SQL,
            "op9_similar_texts": SIMILAR_SQL, "op12_ranked_search": RANKED_SQL,
            "op13_filter_audit": AUDIT_SQL}
