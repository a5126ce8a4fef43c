"""The opN_* queries: each operator with production parameters over its whole table, and the SQL for those that SQL can express."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, divergence, knn, licences, line_dedup, packing, quality, setsketch, spelling, toxicity, warc, word_bpe
from .common import table

TOKENIZER = tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")) + (public_tokenizers.PATTERN,)


def op1_warc(spark, sf_dir):
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark, sf_dir):
    docs, fold = table(spark, sf_dir, "documents"), quality.crc_fold(5)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    return toxicity.score_toxicity(docs, model).withColumn("held_out", F.coalesce(fold == 0, F.lit(False)))


def op3_best_two_fit(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True), neighbours=False))


def op5_prefix_bpe(spark, sf_dir):
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), TOKENIZER[1], TOKENIZER[2])


def op6_quality_classifier(spark, sf_dir):
    docs, fold = table(spark, sf_dir, "documents"), quality.crc_fold(4)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold != 2, neighbours=True)
    return quality.classify_quality(docs, model).withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op8_setsketch(spark, sf_dir):
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op9_voronoi_knn(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return knn.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


def op10_licences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return licences.scan_licences(docs, licences.fit(docs))


def op11_word_bpe(spark, sf_dir):
    return word_bpe.word_bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = (op1_warc, op2_toxicity, op3_best_two_fit, op4_quality_rules, op5_prefix_bpe, op6_quality_classifier, op7_line_dedup, op8_setsketch, op9_voronoi_knn, op10_licences, op11_word_bpe, op12_source_divergence, op13_spelling_variants, pipeline)


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    return {"op1_warc": warc.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op8_setsketch": setsketch.ORACLE, "op9_voronoi_knn": knn.ORACLE, "op12_source_divergence": divergence.ORACLE}
