"""The thin queries over the operators, as the result contracts fix them, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, html_extract, media, pii, quality, simhash, toxicity, url_filter, warc
from plumbline.llm.common import labelled_sample, table

RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
#: Labelled rows that the classifiers are fitted on, at most.
QUALITY_ROWS = 2048
TOXIC_ROWS = 4096


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    return quality.train(labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", 4, 2, QUALITY_ROWS))


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.detect(documents, pii.fit(documents))


def op2_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op3_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op7_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op8_wav_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.features(media.encode(table(spark, sf_dir, "documents")))
    return found.withColumn("feature", F.concat_ws(",", F.col("feature").cast("array<string>")))


def op9_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.train(html_extract.labelled_pages()))


def op10_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = toxicity.score(documents, toxicity.train(labelled_sample(documents, table(spark, sf_dir, "labels"), "toxic", 3, 1, TOXIC_ROWS)))
    places = F.transform("sentences", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("sentences").cast("long").alias("n_offending"), F.concat_ws(",", places).alias("offending"))


QUERIES = {f.__name__: f for f in (op1_skip_chain_pii, op2_bloom_cascade, op3_warc_dictionary, op4_subword_quality, op5_bpe_transducer, op6_prefix_decontamination, op7_vantage_simhash, op8_wav_fingerprint, op9_crf_main_text, op10_noisy_or_toxicity)}

#: Host and path are taken at the first ://; only A-Z are lower-cased.
_OP2_RULES = ", ".join(f"('{r}', '{v}')" for r, v in RULES.items())
ORACLES = {
    "op2_bloom_cascade": f"""
        WITH parts AS (
            SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
        ), split AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts
        ), rules(rule, verdict) AS (VALUES {_OP2_RULES}), fit AS (
            SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, position('/' IN rule) DESC) AS place
            FROM split JOIN rules ON ('.' || host) LIKE '%.' || split_part(rule, '/', 1) AND starts_with(path, substr(rule, position('/' IN rule)))
        )
        SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM split s LEFT JOIN fit f ON f.page_id = s.page_id AND f.place = 1
    """,
    "op6_prefix_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), bw AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)
        ), dw AS (
            SELECT doc_id, s, size, array_to_string(w[s : s + size - 1], ' ') AS win
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
        ), hit AS (SELECT dw.doc_id, dw.s, dw.size, bw.item_id FROM dw JOIN bw USING (size, win)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
}
