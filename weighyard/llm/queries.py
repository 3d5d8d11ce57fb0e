"""The registered queries of the corpus operators and the SQL that must agree with them."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from weighyard.llm import (
    bpe_automaton,
    compression_quality,
    conversation_repair,
    exact_dedup,
    hilbert_ann,
    jaccard_join,
    langid,
    licenses,
    lm_scoring,
    packing,
    paragraph_dedup,
    pii,
    whitening,
)
from weighyard.llm.common import table

#: Folder of the public tokenizer files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def op1_pii(spark, sf):
    found = pii.find_personal_data(table(spark, sf, "documents"))
    return found.select("doc_id", *[f"n_{kind}" for kind in pii.BASE_PATTERNS],
                        F.sha2(F.expr(pii.spans_text("base")), 256).alias("base_sha256"),
                        F.expr(pii.spans_text("spans")).alias("spans"))


def op2_hilbert_ann(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return hilbert_ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op3_compression_quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn(
        "held_out", F.expr("crc32(CAST(doc_id AS STRING)) % 5 = 0"))
    labels = table(spark, sf, "labels").where("crc32(CAST(doc_id AS STRING)) % 5 <> 0")
    scored = compression_quality.score(docs, compression_quality.fit(docs, labels))
    return scored.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "score",
                         F.expr(f"CAST(score >= {compression_quality.THRESHOLD} AS INT)").alias("predicted"))


def op4_jaccard_join(spark, sf):
    return jaccard_join.jaccard_components(table(spark, sf, "documents"))


def op5_bpe_automaton(spark, sf):
    codec = bpe_automaton.Codec(spark, f"{TOKENIZERS}/byte_bpe_50k.json")
    encoded = codec.encode(table(spark, sf, "documents").select("doc_id", "text"))
    digests = encoded.select("doc_id", "ids", bpe_automaton.token_count().alias("n_tokens"),
                             F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    return codec.decode(digests).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_exact_dedup(spark, sf):
    return exact_dedup.copies(table(spark, sf, "documents"))


def op7_language_id(spark, sf):
    return langid.identify_documents(table(spark, sf, "documents"))


def page_languages(spark, sf):
    return langid.identify(langid.page_evidence(table(spark, sf, "pages")))


def op8_packing(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op9_license_scan(spark, sf):
    return licenses.licenses(table(spark, sf, "documents"))


def op10_paragraph_dedup(spark, sf):
    return paragraph_dedup.repeated_passages(table(spark, sf, "documents"))


def op11_conversation_repair(spark, sf):
    rows = conversation_repair.turns(table(spark, sf, "conversations"))
    return conversation_repair.repair_report(conversation_repair.damage(rows), rows)


def op12_whitening(spark, sf):
    whitened = whitening.whiten(table(spark, sf, "embeddings"))
    return whitened.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op13_lm_scoring(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn(
        "held_out", F.expr("coalesce(crc32(CAST(doc_id AS STRING)) % 5 = 1, false)"))
    return lm_scoring.score(docs, lm_scoring.train(docs.where("NOT held_out")), carry=["doc_id", "held_out"])


def queries():
    return {
        "op1_pii": op1_pii,
        "op2_hilbert_ann": op2_hilbert_ann,
        "op3_compression_quality": op3_compression_quality,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_bpe_automaton": op5_bpe_automaton,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_language_id": op7_language_id,
        "page_languages": page_languages,
        "op8_packing": op8_packing,
        "op9_license_scan": op9_license_scan,
        "op10_paragraph_dedup": op10_paragraph_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_whitening": op12_whitening,
        "op13_lm_scoring": op13_lm_scoring,
    }


OP6_SQL = """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM rows WINDOW same AS (PARTITION BY body)
"""


#: Shingle sets, pairs counted by common shingles, and the smallest id within reach.
OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')
    IF x <> ''] AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT sets.doc_id, len(sets.s) AS n_shingles, least_id.y AS component_id
FROM sets JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) least_id ON sets.doc_id = least_id.x
"""


def oracle_sql():
    return {"op4_jaccard_join": OP4_SQL, "op6_exact_dedup": OP6_SQL}
