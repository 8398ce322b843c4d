"""The registered queries of this subpackage: thin uses of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html_extract, lines, manifest, maxscore, mixing, neardup, packing, runs, shards, suffix, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "severity", "p_toxic", "grade", "is_toxic")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(rows, rows.filter("vec_id % 100 = 0"), 10)


def op4_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return maxscore.top_inner_products(rows, rows.filter("vec_id % 50 = 0"), 5)


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


SHARD_BYTES = 1 << 20


def op10_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.extendible_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summary(runs.periodic_runs(runs.planted(_table(spark, sf_dir, "documents"))))


def op12_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summary(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op13_slot_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest.document_manifest(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_cross_polytope": op3_cross_polytope,
    "op4_prefix_free_repeats": op4_prefix_free_repeats,
    "op5_line_templates": op5_line_templates,
    "op6_temperature_mix": op6_temperature_mix,
    "op7_host_consensus": op7_host_consensus,
    "op8_maxscore": op8_maxscore,
    "op9_dart_minhash": op9_dart_minhash,
    "op10_extendible_shards": op10_extendible_shards,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fm_index": op12_fm_index,
    "op13_slot_pivot": op13_slot_pivot,
}
ORACLE = {
    "op5_line_templates": lines.ORACLE,
    "op6_temperature_mix": mixing.ORACLE,
    "op8_maxscore": maxscore.ORACLE,
    "op10_extendible_shards": shards.ORACLE.format(limit=SHARD_BYTES),
    "op12_fm_index": decontaminate.ORACLE,
    "op13_slot_pivot": manifest.ORACLE,
}
