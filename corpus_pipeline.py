"""From raw documents to packed sequences: quality rules, near duplicates, repeated passages, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweight.llm.mixing import mixed_documents
from graphweight.llm.ngram_join import ngram_join
from graphweight.llm.packing import pack
from graphweight.llm.quality import good_documents
from graphweight.llm.storage import release, row_of, scratch, stored, written
from graphweight.llm.substring_dedup import substring_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null texts are rejected; repeated rows stay or go together; no rows give no rows."""
    return good_documents(docs)


def with_key(docs: DataFrame) -> DataFrame:
    """key, row (all columns of docs as a struct, so that no name can clash) and text. key: one number for each pair of doc_id and text, rising with doc_id (null first). That is doc_id itself where none is null or repeats."""
    rows = docs.select(row_of(docs).alias("row"), F.col("doc_id").cast("long").alias("key"), "text")
    again = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 or key is null")
    if again.isEmpty():
        return rows
    digest = F.struct(F.col("text").isNull().alias("no"), F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"))
    rows = rows.withColumnRenamed("key", "id").withColumn("digest", digest)
    ids = rows.select(F.col("id").alias("own"), F.col("digest").alias("of")).distinct().orderBy(F.asc_nulls_first("own"), "of")
    ids = written(ids.withColumn("key", F.monotonically_increasing_id()))
    return written(rows.join(ids, F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("of"))).select("row", "key", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, one of least doc_id; so does one of rows that repeat doc_id and text.

    Rows with a null doc_id or that of another row, but another text, are judged each by its own text. Texts
    without words, null ones as well, stay. Columns of any name pass; no rows give no rows.
    """
    rows = with_key(docs)
    kept = ngram_join(rows.select(F.col("key").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("key")).distinct()
    out = rows.join(kept, "key", "left_semi").dropDuplicates(["key"])
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has are cut out; documents that lose all their words go. n_chars is that of the text left.

    Rows with a null doc_id or that of another row, but another text, are documents of their own. Null and empty
    texts stay, as empty ones. Columns of any name pass; no rows give no rows.
    """
    rows = with_key(docs)
    cut = substring_dedup(rows.select(F.col("key").alias("doc_id"), "text"), with_text=True).where("n_removed < n_words or n_words = 0")
    cut = cut.select(F.col("doc_id").alias("key"), F.col("kept_text").alias("left")).dropDuplicates(["key"])
    rest = F.struct(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "text"])
    both = rows.select("key", rest.alias("rest")).join(cut, "key")
    new = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    return both.select(*[new[c].alias(c) if c in new else F.col("rest").getField(c).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut in part.

    Null texts and texts without words are not taken; a null source is a source; repeated rows are taken each for
    itself. Columns of any name pass; no rows give no rows.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as pack() gives them: a null or empty text is its end token, repeated rows are packed each for itself, no rows give no pieces."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("packing", packing),
]

#: Signatures, hash-random keys, learned references and token ids have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = []
    for _, stage in STAGES[:-1]:
        with scratch():  # what the stage's operator wrote goes with it
            out = stage(spark, docs, sf_dir)
            docs = stored(out)
        release(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
