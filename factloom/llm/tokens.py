"""Sizes of texts in tokens of a public byte-level tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ranks of a byte-level vocabulary: a base64 token and its rank on each line
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# ---- fixed value: the pattern by which this public vocabulary's texts are parted ----
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# ---- end of fixed value ----
#: texts are encoded in stretches of so many characters, parted at line ends or else blanks
STRETCH = 100_000


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("factloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """A text in parts of bounded length; a part ends before a blank run where there is one in its second half."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind("\n", at + most // 2, at + most), text.rfind(" ", at + most // 2, at + most))
        end = end if end > at else at + most
        yield text[at:end]
        at = end
    yield text[at:]


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of a whole text; 0 for a null or empty one."""
    encode = encoding(vocabulary).encode_ordinary
    return sum(len(encode(part)) for part in stretches(text)) if text else 0


def sizes(documents: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns, ``n_tokens`` and a ``salt`` that numbers a split's rows; a narrow map that reads whole texts.

    The salt spreads rows with equal or null ids; it is the same on every run over the same splits.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*[f"`{c}`" for c in keep]).schema)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            n = [count_tokens(t, vocabulary) for t in batch.column(len(keep)).to_pylist()]
            salt = np.arange(seen, seen + len(n), dtype=np.int64)
            seen += len(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(salt)], names=[*keep, "n_tokens", "salt"])

    return documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`")).mapInArrow(convert, f"{schema}, n_tokens bigint, salt bigint")
