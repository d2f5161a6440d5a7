"""Imports of many files at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweight.functions.scalar import LANGUAGE_EXTENSIONS

from .ecmascript import ecmascript_imports
from .python_imports import Found, python_imports

OUT = "path string, imports array<struct<specifier:string,kind:string>>, unresolvable int, warning string"


def imports_of(path: str, content: bytes | None) -> Found:
    """Of one file, by its extension; unreadable content is a warning without imports."""
    if content is None:
        return [], 0, "cannot be read"
    try:
        source = content.decode("utf-8")
    except UnicodeDecodeError as error:
        return [], 0, f"not UTF-8: {error.reason} at {error.start}"
    return python_imports(source) if path.rsplit(".", 1)[-1] in LANGUAGE_EXTENSIONS["python"] else ecmascript_imports(source.removeprefix("\ufeff"))


def extract(files: DataFrame) -> DataFrame:
    """files(path, content) to path, imports (in source order), unresolvable, warning."""
    shape = pa.schema([("path", pa.string()), ("imports", pa.list_(pa.struct([("specifier", pa.string()), ("kind", pa.string())]))), ("unresolvable", pa.int32()), ("warning", pa.string())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found, unresolvable, warning = imports_of(path, content)
                rows.append({"path": path, "imports": [{"specifier": s, "kind": k} for s, k in found], "unresolvable": unresolvable, "warning": warning})
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return files.select("path", "content").mapInArrow(emit, OUT)


def as_rows(extracted: DataFrame) -> DataFrame:
    """path, ord, specifier, kind."""
    return extracted.select("path", F.posexplode("imports").alias("ord", "i")).select("path", F.col("ord").cast("long").alias("ord"), "i.specifier", "i.kind")
