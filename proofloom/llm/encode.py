"""Token ids and token counts of a whole table of texts."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.llm.bpe import Vocabulary, encoder, tokenizer_path


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("_text").to_pylist()


def _run(shared, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for batch in batches:
            if enc is None:
                enc = encoder(shared.value)
            flat, ends = array("i"), [0]
            for text in _texts(batch):
                if text:
                    enc.encode_into(text, flat)
                ends.append(len(flat))
            rest = [batch.column(c) for c in batch.schema.names if c != "_text"]
            names = [c for c in batch.schema.names if c != "_text"]
            ends = np.array(ends, dtype=np.int64)
            if counts_only:
                made = pa.array(np.diff(ends))
            elif ends[-1] < 2**31 - 1:
                made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, np.int32)))
            else:
                raise OverflowError("lower spark.sql.execution.arrow.maxRecordsPerBatch")
            yield pa.RecordBatch.from_arrays([*rest, made], names=[*names, "_made"])

    return run


def _apply(df: DataFrame, text: str, out: str, kind: str, counts_only: bool, path: str | None) -> DataFrame:
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(path or tokenizer_path()))  # a fixed size, about a megabyte
    keep = [c for c in df.columns if c not in (text, out)]  # a column named ``out`` gives way
    renamed = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("_text"))
    schema = ", ".join(f"_{i} {renamed.schema[f'_{i}'].dataType.simpleString()}" for i in range(len(keep)))
    made = renamed.mapInArrow(_run(shared, counts_only), f"{schema}{', ' if keep else ''}_made {kind}")
    return made.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], F.col("_made").alias(out))


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text`` (array<int>, no special tokens) in place of it.

    Null and empty texts give an empty list; every row stays, repeated rows too. Texts are encoded whole, whatever their length. Strings that
    look like special tokens are ordinary text. One pass without a shuffle.
    """
    return _apply(df, text, out, "array<int>", False, path)


def token_counts(df: DataFrame, text: str = "text", out: str = "tokens", path: str | None = None) -> DataFrame:
    """As ``encode``, with the number of ids (bigint) only; 0 for null and empty texts."""
    return _apply(df, text, out, "bigint", True, path)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with the text of ``ids`` in place of it; a null list gives null, an empty one the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path or tokenizer_path()))

    @F.pandas_udf("string")
    def text_of(column):
        vocabulary = shared.value
        return column.map(lambda x: None if x is None else vocabulary.decode(x))

    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (ids, out)], text_of(F.col(f"`{ids}`")).alias(out))
