"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .html_text import main_text
from .language import identify
from .license_scan import license_scan
from .mixing import mix_sources
from .ngram_join import ngram_join
from .packing import pack
from .quality import quality
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .vector_dedup import vector_dedup

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, operator: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        return out.select(*columns) if columns else out

    return query


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": _over("documents", substring_dedup),
    "op2_language": _over("documents", identify),
    "op3_mix_sources": _over("documents", mix_sources),
    "op4_license_scan": _over("documents", license_scan),
    "op5_quality": _over("documents", quality, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
    "op6_ngram_join": _over("documents", ngram_join),
    "op7_vector_dedup": _over("embeddings", vector_dedup),
    "op8_pack": _over("documents", pack),
    "op9_suffix_dedup": _over("documents", suffix_dedup),
    "op10_main_text": _over("pages", main_text),
}
