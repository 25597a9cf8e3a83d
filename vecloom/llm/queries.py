"""The opN queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, cws, langid, line_spread, mixing, sentencepiece_nbest, simhash, token_store, toxicity, warc
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepiece_nbest.encode(docs, tokenizer("piece_bpe_32k.model"), n_best=4, keep_ids=False)
    round_trip = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), sentencepiece_nbest.MARK, " ")
    loss = lambda k: F.try_element_at("losses", F.lit(k))
    return out.select("doc_id", "n_tokens", "ids_crc32", "score", "n_best", loss(2).alias("loss_2"), loss(3).alias("loss_3"), loss(4).alias("loss_4"), F.xxhash64("edits").alias("edits_hash"), round_trip.alias("round_trip"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.write(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))
    return token_store.read(spark, folder)


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
         embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.a = vec_id
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM s),
w AS (SELECT *, ([5.0, 2.0, 1.0])[((rn - 1) % 3 + 1)]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM o),
r AS (SELECT *, cap / w AS ratio FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () - (sum(cap) OVER b - cap))::DOUBLE / (sum(w) OVER () - (sum(w) OVER b - w)) AS level
  FROM r WINDOW b AS (ORDER BY ratio, rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT source, source_size, CASE WHEN level > ratio THEN cap ELSE max(level) OVER () * w END AS target FROM l),
c AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END::BIGINT AS whole,
         (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(round(target - whole * source_size)::BIGINT - before, size)))::BIGINT AS taken
FROM c
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, read = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
m AS (SELECT html, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN m USING (html)
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.training_rows(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~langid.training_rows(F.col("doc_id"))).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"))


def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_spread.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT r, source, line, pos, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l),
bad AS (SELECT t FROM k WHERE t <> '' GROUP BY t HAVING count(DISTINCT coalesce('s' || source, '')) >= 5),
f AS (
  SELECT r, count(b.t) AS n_bad,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (b.t IS NULL), '') AS clean
  FROM k LEFT JOIN bad b ON k.t = b.t GROUP BY r)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n_bad, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n_bad > 0 THEN clean ELSE text END) AS clean_sha256
FROM d LEFT JOIN f USING (r)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = toxicity.training_rows(F.col("doc_id"))
    lexicon = toxicity.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn).select("doc_id", "toxic"))
    out = toxicity.score(docs, lexicon)
    return out.select("doc_id", (~learn).alias("held_out"), F.col("tox_score").alias("score"), F.when(F.col("tox_score") >= 0.7, 1).otherwise(0).alias("predicted"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_store": op2_token_store,
    "op3_cover_tree": op3_cover_tree,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_language_id": op7_language_id,
    "op8_weighted_sampling": op8_weighted_sampling,
    "op9_line_spread": op9_line_spread,
    "op10_toxicity": op10_toxicity,
}

ORACLE = {"op3_cover_tree": OP3_SQL, "op5_mixing": OP5_SQL, "op6_warc": OP6_SQL, "op9_line_spread": OP9_SQL}
