"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.session import ship

#: Where the vocabulary files lie; every executor must find them there.
FOLDER = os.environ.get("FOLIO_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's tokenizer first divides text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict = {}


def tokenizer(path: str):
    """The tokenizer of a rank file, loaded once a process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding("folio", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_counts(documents: DataFrame, path: str | None = None, *keep: str) -> DataFrame:
    """(doc_id, tokens, *keep): the size of each document; null and empty texts have 0 tokens. Rows without an id are left out."""
    ship(documents.sparkSession)
    path = path or os.path.join(FOLDER, VOCABULARY)
    d = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), *keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1]) + ", tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            n = batch.num_columns - 1
            sizes = [len(t.encode_ordinary(x)) if x else 0 for x in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(sizes, pa.int32())], names=[*batch.schema.names[:n], "tokens"])

    return d.mapInArrow(run, schema)
