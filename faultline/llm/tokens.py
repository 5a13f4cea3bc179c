"""The corpus in ids of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm import bpe_automaton

#: Folder of the public vocabulary files; the same path on every executor.
TOKENIZER_DIR = os.environ.get("FAULTLINE_TOKENIZERS", "/opt/tokenizers")


def vocabulary_path(name: str, folder: str = TOKENIZER_DIR) -> str:
    return f"{folder}/{name}.json"


def encode_texts(docs: DataFrame, tokenizer: str = "byte_bpe_50k", doc_id: str = "doc_id", text: str = "text",
                 folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids) of every row, special tokens' strings being ordinary text.

    Null and empty texts give an empty list; repeated rows give repeated results; an empty table gives none; other columns are
    ignored. A map over the scan: no shuffle, the automaton is compiled once per worker."""
    path = vocabulary_path(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = bpe_automaton.load(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # bounds the ids held at a time, whatever the batch
                part = b.slice(at, 256)
                lists = [automaton.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): the labels of the arcs, put together. Null lists give empty texts."""
    path = vocabulary_path(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = bpe_automaton.load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([automaton.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k", doc_id: str = "doc_id", text: str = "text",
                 folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, n_tokens) of every row; 0 for null and empty texts."""
    path = vocabulary_path(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = bpe_automaton.load(path)
        for b in batches:
            counts = [automaton.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")
