"""The registered queries of this package: name -> (query, SQL or None)."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from gymlake.llm import centroids, license_scan, quality, quality_rules, spelling, toxicity
from gymlake.llm.ann import nearest
from gymlake.llm.common import load
from gymlake.llm.exact_dedup import exact_dedup
from gymlake.llm.mixing import mix
from gymlake.llm.near_dup import near_duplicates
from gymlake.llm.packing import pack
from gymlake.llm.suffix_dedup import suffix_dedup
from gymlake.llm.token_store import token_store


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(load(spark, sf_dir, "documents")).drop("tag")


OP1_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
      FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op2_license_scan(spark, sf_dir):
    return license_scan.license_scan(load(spark, sf_dir, "documents")).drop("tag")


def op3_one_bit_neighbours(spark, sf_dir):
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_best_fit_packing(spark, sf_dir):
    return pack(load(spark, sf_dir, "documents"))


def op5_quality_nbsvm(spark, sf_dir):
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_pfair_mixing(spark, sf_dir):
    return mix(load(spark, sf_dir, "documents").select("doc_id", "source"), corpus_pipeline.SHARES)


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup(load(spark, sf_dir, "documents"))


def op8_toxicity_cnn(spark, sf_dir):
    return toxicity.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_ngram_jaccard_join(spark, sf_dir):
    return near_duplicates(load(spark, sf_dir, "documents")).drop("tag")


def op10_token_store(spark, sf_dir):
    return token_store(load(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark, sf_dir):
    return centroids.cluster(load(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(load(spark, sf_dir, "documents"), typo=spelling.TYPO)


def op13_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(load(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": (op1_exact_dedup, OP1_SQL),
    "op2_license_scan": (op2_license_scan, license_scan.oracle_sql()),
    "op3_one_bit_neighbours": (op3_one_bit_neighbours, None),
    "op4_best_fit_packing": (op4_best_fit_packing, None),
    "op5_quality_nbsvm": (op5_quality_nbsvm, None),
    "op6_pfair_mixing": (op6_pfair_mixing, None),
    "op7_suffix_dedup": (op7_suffix_dedup, None),
    "op8_toxicity_cnn": (op8_toxicity_cnn, None),
    "op9_ngram_jaccard_join": (op9_ngram_jaccard_join, None),
    "op10_token_store": (op10_token_store, None),
    "op11_centroid_clusters": (op11_centroid_clusters, centroids.oracle_sql()),
    "op12_spelling_variants": (op12_spelling_variants, None),
    "op13_quality_rules": (op13_quality_rules, quality_rules.oracle_sql()),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}


def queries():
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
