"""The queries of this package, each over its whole table with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, importance, license_scan, mixing, near_dedup, packing, sharding, substring_dedup, topk_search, toxicity, warc, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_bundles": lambda spark, sf: warc.archive_round_trip(spark, table(spark, sf, "pages")),
    "op2_toxicity": lambda spark, sf: toxicity.score_documents(spark, table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op3_exact_dedup": lambda spark, sf: exact_dedup.dedup_documents(spark, table(spark, sf, "documents")),
    "op4_source_mixing": lambda spark, sf: mixing.mix_report(spark, table(spark, sf, "documents")),
    "op5_best_fit_packing": lambda spark, sf: packing.pack_documents(spark, table(spark, sf, "documents")),
    "op6_license_scan": lambda spark, sf: license_scan.scan_licenses(spark, table(spark, sf, "documents")),
    "op7_jump_sharding": lambda spark, sf: sharding.shard_documents(spark, table(spark, sf, "documents")),
    "op8_maxscore_topk": lambda spark, sf: topk_search.search_embeddings(spark, table(spark, sf, "embeddings")),
    "op9_repeated_phrases": lambda spark, sf: substring_dedup.remove_repeats(spark, table(spark, sf, "documents")),
    "op10_setsketch_near_dedup": lambda spark, sf: near_dedup.near_duplicates(spark, table(spark, sf, "documents")),
    "op11_whitening": lambda spark, sf: whitening.whiten(spark, table(spark, sf, "embeddings")),
    "op12_importance_resampling": lambda spark, sf: importance.resample(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op13_forced_boundary_bpe": lambda spark, sf: bpe.encode_documents(spark, table(spark, sf, "documents")),
}

ORACLES: dict[str, str] = {
    "op1_warc_bundles": warc.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_source_mixing": mixing.ORACLE,
    "op6_license_scan": license_scan.oracle(),
    "op8_maxscore_topk": topk_search.ORACLE,
    "op9_repeated_phrases": substring_dedup.ORACLE,
    "op10_setsketch_near_dedup": near_dedup.ORACLE,
    "op12_importance_resampling": importance.ORACLE,
}
