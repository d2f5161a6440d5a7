"""Resolution as joins: each question names the paths that could answer it; those that exist come back and decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of a C extension's first name part and suffix: `pkg/fast.cpython-311.so` is found as `pkg/fast.<ext>`.
EXTENSION_SUFFIX = ".<ext>"


def indexed(fs: DataFrame) -> DataFrame:
    """fs(path, is_dir) as probe (what may be asked for, folders with a slash at the end) and path."""
    plain = fs.select(F.when(F.col("is_dir"), F.concat("path", F.lit("/"))).otherwise(F.col("path")).alias("probe"), "path")
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.concat(F.substring("path", F.lit(1), F.length("path") - F.length(name)), F.element_at(F.split(name, "\\."), 1), F.lit(EXTENSION_SUFFIX))
    compiled = fs.where(~F.col("is_dir") & F.col("path").rlike(r"\.(so|pyd)$")).groupBy(stem.alias("probe")).agg(F.min("path").alias("path"))
    return plain.unionByName(compiled)


Probes = Callable[[str, str], list[str]]
Decide = Callable[[str, str, dict[str, str]], str | None]


def resolved(questions: DataFrame, fs: DataFrame, probes: Probes, decide: Decide) -> DataFrame:
    """questions(folder, specifier) to folder, specifier, resolved (null if nothing answers).

    A question has few probes (roots or ancestors times forms); what exists of them is one small map a question.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(set(probes(f, s))) for f, s in zip(batch.column("folder").to_pylist(), batch.column("specifier").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("folder"), batch.column("specifier"), pa.array(lists, pa.list_(pa.string()))], names=["folder", "specifier", "probes"])

    distinct = questions.select("folder", "specifier").distinct()
    asked = distinct.mapInArrow(ask, "folder string, specifier string, probes array<string>")
    there = asked.select("folder", "specifier", F.explode("probes").alias("probe")).join(indexed(fs), "probe")
    found = there.groupBy("folder", "specifier").agg(F.collect_list(F.struct("probe", "path")).alias("found"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decide(f, s, {x["probe"]: x["path"] for x in found or []}) for f, s, found in zip(*(batch.column(c).to_pylist() for c in ("folder", "specifier", "found")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("folder"), batch.column("specifier"), pa.array(out, pa.string())], names=["folder", "specifier", "resolved"])

    return distinct.join(found, ["folder", "specifier"], "left").mapInArrow(answer, "folder string, specifier string, resolved string")
