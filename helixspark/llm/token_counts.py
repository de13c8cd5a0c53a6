"""Token counts of whole texts, with overlap resynchronisation for huge ones (see tokenizing)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .tokenizing import CHUNK, OVERLAP, encode_all, load

SCHEMA = "n_bytes long, n_tokens long, over_limit boolean, n_splices int, n_widened int"


def count_tokens(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: id, bytes, tokens, whether there are more than ``limit`` tokens, splices, widened overlaps.

    tokenizer: a public tokenizer's file name or a path; its suffix chooses the library (.json, .tiktoken, .model).
    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows are counted one by one; other
    columns are left out, so their names can't clash; an empty table gives an empty table. Works batch by batch on the
    scan, without a shuffle.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [(len(ids), a, b) for ids, a, b in encode_all(encoder, texts, chunk, overlap)]
            n, splices, widened = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [])
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(splices, pa.int32()), pa.array(widened, pa.int32())], names=[id_col, "n_bytes", "n_tokens", "over_limit", "n_splices", "n_widened"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 50k byte-level vocabulary."""
    return count_tokens(table(spark, sf_dir))
