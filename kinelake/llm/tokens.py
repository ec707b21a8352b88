"""Encoding of a corpus with a public tokenizer, and token counts.

A narrow Arrow stage without a shuffle: the text column and the id are all that
is read; the vocabulary file is shipped with the job; words are split once a batch and encoded once a worker process (see
``kinelake.llm.bpe``). Batches are cut into slices by bytes of text, so long
texts don't pile up.

Defined cases: null and empty texts give an empty list (count 0); blank texts
are ordinary text; the strings of special tokens are ordinary text; very long
texts are encoded whole; repeated rows give repeated rows; an empty table gives
no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from kinelake.llm import bpe

_SLICE_BYTES = 8 << 20


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most about 8 MB of text."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    part = np.cumsum(sizes) // _SLICE_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for lo, hi in zip(bounds, bounds[1:]):
        yield batch.slice(lo, hi - lo)


def _encode(batches: Iterator[pa.RecordBatch], text: str, path: str, schema: pa.Schema, lists: bool) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401

    enc = bpe.encoder(SparkFiles.get(os.path.basename(path)))
    for whole in batches:
        for batch in _slices(whole, text):
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            if lists:
                ids = enc.encode(texts)
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(i) for i in ids], out=offsets[1:])
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                out = pa.ListArray.from_arrays(pa.array(offsets), values)
            else:
                out = pa.array(enc.count(texts), pa.int64())
            columns = [*rest, out]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _run(df: DataFrame, keep: list[str], text: str, path: str, column: str, kind) -> DataFrame:
    src = df.select(*keep, text)
    out = StructType([*src.select(*keep).schema.fields, StructField(column, kind)])
    schema = to_arrow_schema(out)
    lists = isinstance(kind, ArrayType)
    df.sparkSession.sparkContext.addFile(path)
    return src.mapInArrow(lambda it: _encode(it, text, path, schema, lists), out)


def _vocabulary(df: DataFrame) -> str:
    """The vocabulary file in the folder that the session names in spark.kinelake.tokenizers, else in the default one."""
    return bpe.vocabulary_file(df.sparkSession.conf.get("spark.kinelake.tokenizers", bpe.DEFAULT_PATH))


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every row."""
    return _run(documents, [key], text, path or _vocabulary(documents), "ids", ArrayType(IntegerType()))


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """(keep..., n_tokens) of every row."""
    return _run(documents, keep, text, path or _vocabulary(documents), "n_tokens", LongType())
