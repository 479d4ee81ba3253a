"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType

from ..session import shipped

#: A vocabulary as ranks, one "base64 rank" pair a line; the driver reads it and sends it to the executors (under 1 MB).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the splitting pattern that belongs to that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[int, object] = {}


def encoder(vocabulary: bytes):
    """The encoder of a vocabulary, built once in a worker."""
    key = hash(vocabulary)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[str | None]:
    """The strings of an Arrow column one at a time; bytes that are not UTF-8 become replacement characters."""
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in raw:
        b = value.as_py()
        yield None if b is None else b.decode("utf-8", "replace")


def token_counts(docs: DataFrame, ident: str, text: str, keep: Sequence[str] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """``ident``, the ``keep`` columns and ``n_tokens`` (long) of every row; 0 for a null or empty text.

    Whole texts are encoded; strings that look like special tokens are ordinary text. One Arrow pass, no shuffle.
    """
    with open(tokenizer, "rb") as file:
        vocabulary = shipped(docs.sparkSession).sparkContext.broadcast(file.read())
    if text in (ident, *keep):
        raise ValueError("the text itself is not kept")
    used = docs.select(ident, *keep, text)
    schema = used.drop(text).schema.add("n_tokens", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in texts(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return used.mapInArrow(run, schema)
