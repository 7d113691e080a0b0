"""Tokens by a rank file of a public tokenizer, or by characters where none is given."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern by which texts are cut before byte pairs are merged (as the 100k-token vocabulary of chat models has it).
PATTERN = r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str, pattern: str = PATTERN):
    """The tokenizer of a rank file (a line per token: base64, blank, id); loaded once in a Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(path: str, text: Column, pattern: str = PATTERN) -> Column:
    """The ids of a text's tokens; null stays null."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = encoding(path, pattern)
        return texts.map(lambda t: None if t is None else own.encode_ordinary(t))

    return ids(text)


def characters(text: Column) -> Column:
    """The characters of a text, as tokens where there is no tokenizer."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def token_counter(path: str, pattern: str = PATTERN):
    """A counter for the chunkers: the tokens of each paragraph of each block, by a rank file."""

    @F.pandas_udf("array<array<bigint>>")
    def counts(blocks: pd.Series) -> pd.Series:
        own = encoding(path, pattern)
        return blocks.map(lambda b: None if b is None else [[len(own.encode_ordinary(p)) for p in paragraphs] for paragraphs in b])

    return counts


def token_windows(path: str, pattern: str = PATTERN):
    """Windows for chunkers.fixed_window: the texts of `size` tokens, each window `step` tokens after the one before."""

    def windows(text: Column, size: int, step: int) -> Column:
        @F.pandas_udf("array<string>")
        def cut(texts: pd.Series) -> pd.Series:
            own = encoding(path, pattern)

            def one(t):
                ids = own.encode_ordinary(t or "")
                return [own.decode(ids[k : k + size], errors="replace") for k in range(0, len(ids), step)]

            return texts.map(one)

        return cut(text)

    return windows
