"""Token ids and token counts of a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.batches import parts
from sedimark.llm.bpe import Encoder
from sedimark.session import spread

@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids ARRAY<INT>): each text's token ids, without special tokens, in the order of the text.

    Every row of `df` gives one row. Null and empty texts give an empty list; blank texts are encoded like any other. Texts are
    encoded whole, whatever their length. Strings of special tokens are ordinary text. Other columns of `df` are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in parts(texts):
                offsets, ids = enc.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], [id_col, "ids"])

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens BIGINT): the length of each text's list of ids; null and empty texts count 0."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [enc.count(texts[a:b]) for a, b in parts(texts)]
            flat = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat, pa.int64())], [id_col, "n_tokens"])

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


def token_summary(df: DataFrame, by: str = "lang") -> DataFrame:
    """Per value of `by`: texts, tokens and the longest text, of the whole corpus; null is a group of its own."""
    counted = token_counts(df).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    return (
        df.select("doc_id", by)
        .join(counted, "doc_id")
        .groupBy(by)
        .agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("longest"))
    )
