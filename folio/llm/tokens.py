"""Token counts by a public byte-level tokenizer, loaded once a worker from a folder of vocabulary files."""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .util import spread

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def token_bytes(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Number of bytes of each token."""
    e = encoding(folder, vocabulary)
    out = np.ones(e.n_vocab, np.int64)
    for word, rank in e._mergeable_ranks.items():
        out[rank] = len(word)
    return out


def counted(docs: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of each row; NULL and empty texts have 0 tokens."""

    def run(batches):
        encode = encoding(folder, vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, tokens long")
