"""Problem 6: encode a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.bpe import default_path, worker_bpe

#: A vocabulary file beyond this size is refused for broadcast.
MAX_VOCAB_BYTES = 64 << 20
#: Texts are encoded in slices of at most this many characters held in Python at once.
_SLICE = 256


def _vocab(df: DataFrame, path: str | None):
    with open(path or default_path(), "rb") as f:
        data = f.read()
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"vocabulary of {len(data)} bytes is over the broadcast bound")
    return df.sparkSession.sparkContext.broadcast(data)


def encode_ids(df: DataFrame, id_col: str, text_col: str, vocab_path: str | None = None) -> DataFrame:
    """(id_col, ids): the token ids of every row's text, without special tokens.

    Null and empty texts give an empty list; white space only is text. Every input row gives one
    row, rows repeating an id too; other columns are not read. Narrow: no shuffle, the vocabulary
    (checked size) is the only thing broadcast. Very long texts are encoded whole, in linear time.
    """
    vocab = _vocab(df, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(vocab.value)
        for b in batches:
            for at in range(0, b.num_rows, _SLICE):
                s = b.slice(at, _SLICE)
                lists = [bpe.encode(t) for t in s.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([s.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["__id", "__ids"])

    src = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    return src.mapInArrow(run, f"__id {src.schema['__id'].dataType.simpleString()}, __ids array<int>").toDF(id_col, "ids")


def count_tokens(df: DataFrame, text_col: str, keep: list[str], vocab_path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """The columns keep of every row and its number of tokens (0 for null and empty texts)."""
    vocab = _vocab(df, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(vocab.value)
        for b in batches:
            # one text at a time becomes a Python string
            n = [len(bpe.encode(t)) for t in (x.as_py() for x in b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "__n"])

    src = df.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keep)), F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{schema}, __n bigint").toDF(*keep, out)
