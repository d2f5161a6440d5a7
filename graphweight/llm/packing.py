"""Packing by power-of-two decomposition."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .textscan import flat

MAX_TOKENS = 2048
END_ID = 1
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


@cache
def tokenizer(path: str, pattern: str | None):
    """The encoder of a vocabulary file, once a worker.

    .tiktoken: byte-level ranks with a splitting pattern; .json: the tokenizers library. Both give the same ids
    for one vocabulary where a text holds no added token; the former is several times as fast.
    """
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: own.encode(text, add_special_tokens=False).ids


def named_path(name: str) -> str:
    """Where this machine has a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(name: str):
    """The encoder of a file that is named alone, or given as a path.

    The ids are those of a .json file; where the folder has the same vocabulary as .tiktoken ranks, these are used
    for texts that hold none of the file's added tokens.
    """
    import json
    import os
    import re

    path = name if "/" in name else named_path(name)
    twin = path.removesuffix(".json") + ".tiktoken"
    if path.endswith(".json") and os.path.exists(twin):
        import public_tokenizers

        with open(path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        fast, whole = tokenizer(twin, public_tokenizers.PATTERN), tokenizer(path, None)
        if any(t["normalized"] for t in added):  # found in the normalized text, which the literal need not stand in
            return whole
        holds = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)").search
        return lambda text: whole(text) if holds(text) else fast(text)
    return tokenizer(path, None)


def binary_pieces(n: int, most: int) -> list[int]:
    """n as whole sequences of `most` and then the powers of two of the rest, falling."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Sequences of at most max_tokens (a power of two) tokens, none of which crosses documents.

    docs: doc_id, text. A document is its text's ids and end_id. It is cut into sequences of max_tokens and then into the
    powers of two of what is left, so that no sequence needs padding; `bucket` is the length's exponent, and a batch
    takes sequences of one bucket (buckets() lists them). Returns per piece, which is a sequence: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset (0), bucket and, with with_ids, ids.

    sequence_id is unique in a run: partition number and row. Nothing is shuffled. Null and empty texts are the
    end_id alone. Repeated rows and rows that repeat a doc_id are packed each for itself; a null doc_id is kept.
    An empty table gives an empty one. vocabulary: a file's path, or a name in the public tokenizers' folder of
    every worker.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = encoder(vocabulary), TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            raw = data.tobytes()
            rows, kept = [], []

            def block() -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(x, pa.int64()) for x in columns[:-1]] + [pa.array(columns[-1], pa.int32())]
                if with_ids:
                    arrays.append(pa.array(kept, pa.list_(pa.int32())))
                return pa.RecordBatch.from_arrays(arrays, names=NAMES + ["ids"] * with_ids)

            for doc_id, x, y in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = np.array([*encode(raw[x:y].decode()), end_id], dtype="<u4")
                start = 0
                for length in binary_pieces(len(ids), max_tokens):
                    own = ids[start : start + length]
                    rows.append((doc_id, start, length, zlib.crc32(own.tobytes()), len(ids), sequence, 0, length.bit_length() - 1))
                    if with_ids:
                        kept.append(own.astype(np.int32))
                    start, sequence = start + length, sequence + 1
                if len(rows) >= 20_000:
                    yield block()
                    rows, kept = [], []
            if rows:
                yield block()

    NAMES = [x.split()[0] for x in OUT.split(", ")]
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(emit, OUT + (", ids array<int>" if with_ids else ""))


def buckets(packed: DataFrame) -> DataFrame:
    """Sequences and tokens of each length."""
    return packed.groupBy("bucket").agg({"sequence_id": "count", "length": "sum"}).toDF("bucket", "n_sequences", "n_tokens")
