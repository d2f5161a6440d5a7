"""Intermediate tables, and the stand-in for a null id."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweight.storage import release, scratch, shared_folder, stored, written

__all__ = ["NULL_ID", "release", "row_of", "scratch", "shared_folder", "stored", "written"]

NULL_ID = -(1 << 63)


def row_of(docs: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`").alias(c) for c in docs.columns])
