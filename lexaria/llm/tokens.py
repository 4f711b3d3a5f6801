"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Default vocabulary file; every operator takes another path.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How text is cut before merging, as published with byte-level vocabularies of this family (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = TOKENIZER):
    """The byte-level tokenizer of the rank file ``path``, loaded once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_lengths(path: str = TOKENIZER):
    """Bytes of each token id."""
    import numpy as np

    e = encoding(path)
    return np.array([len(e.decode_single_token_bytes(i)) for i in range(e.n_vocab)], dtype=np.int64)


def token_sizes(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens): a row for each row of ``df``; a NULL text has NULL tokens, an empty one 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        for b in batches:
            n = [None if t is None else len(e.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int32())], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(count, f"`{id_col}` {kind}, n_tokens int")
