"""Byte-level BPE: each distinct pre-token of the corpus is encoded once, wherever its copies stand."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswell.llm._shared import digest, partitions, text_bytes, whole_text
from corpuswell.llm._textkernels import pretoken_starts, ragged_take, segment_hashes

#: Characters whose pre-tokens are found at once, and characters of a block.
CHUNK, BLOCK = 1 << 20, 4 << 20
#: Bytes of text for each share of the distinct pre-tokens, where partitions of a shuffle would get more; pre-tokens that a task remembers.
PER_SHARE, KNOWN = 64 << 20, 1 << 20


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a rank file (a line per token: base64, blank, id)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def word_encoder(path: str):
    """A function from a pre-token to its ids."""
    import tiktoken
    from public_tokenizers import PATTERN

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={}).encode_ordinary


@lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes joined by id, and where each starts."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    offsets = np.zeros(len(table) + 1, np.int64)
    np.cumsum([len(t) for t in table], out=offsets[1:])
    return np.frombuffer(b"".join(table), np.uint8), offsets


def squeeze(numbers: np.ndarray) -> bytes:
    """Compresses 32-bit numbers, byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 1)


def unsqueeze(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(planes).view("<u4").ravel()


class Block:
    """Some consecutive texts as their distinct pre-tokens and, per place, the pre-token's number.

    `added` are strings that are tokens of their own wherever they stand; the j-th becomes a pre-token of one character that no text
    can hold, chr(0xD800 + j), and no other match crosses it.
    """

    def __init__(self, texts: list[str], added: tuple[str, ...] = ()):
        find = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        number = {a: chr(0xD800 + j) for j, a in enumerate(added)}
        hashes, words, self.counts, chunk, size = [], [], [], [], 0
        self._spans: list[tuple[str, np.ndarray]] = []
        marks: list[int] = []
        for k, text in enumerate(texts):
            if find and find.search(text):
                text = find.sub(lambda m: number[m[0]], text)
                marks += [size + p for p, c in enumerate(text) if c in number.values()]
            chunk.append(text)
            size += len(text)
            if size >= CHUNK or k == len(texts) - 1:
                joined = "".join(chunk)
                firsts = np.cumsum([0, *map(len, chunk)])
                edges = np.unique(np.concatenate([firsts[:-1], np.array(marks, np.int64), np.array(marks, np.int64) + 1]))
                points, starts = pretoken_starts(joined, edges)
                ends = np.append(starts[1:], len(points))
                hashes.append(segment_hashes(points, starts, ends[: len(starts)]))
                self.counts.append(np.diff(np.searchsorted(starts, firsts)))
                self._spans.append((joined, starts))
                chunk, size, marks = [], 0, []
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.codes, self.hashes = pd.factorize(every)
        self.counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        seen = np.full(len(self.hashes), len(every), np.int64)
        np.minimum.at(seen, self.codes, np.arange(len(every)))
        self.mark = digest(self.codes.tobytes(), self.hashes.tobytes(), self.counts.tobytes())
        at, self.words = 0, []
        for joined, starts in self._spans:
            local = seen[(seen >= at) & (seen < at + len(starts))] - at  # ascending: codes count first uses
            ends = np.append(starts[1:], len(joined))
            self.words += [joined[s:e] for s, e in zip(starts[local].tolist(), ends[local].tolist())]
            at += len(starts)
        del self._spans


def text_blocks(batches: Iterator[pa.RecordBatch], block: int = BLOCK, added: tuple[str, ...] = ()) -> Iterator[tuple[int, pa.Array, Block]]:
    """(number, doc ids, block) over a task's rows of (doc_id, text)."""
    ids, texts, size, k = [], [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.slice(lo, 512)
            ids.append(part.column(0))
            rows = part.column(1).to_pylist()
            texts += rows
            size += sum(map(len, rows))
            if size >= block:
                yield k, pa.concat_arrays(ids), Block(texts, added)
                ids, texts, size, k = [], [], 0, k + 1
    if texts:
        yield k, pa.concat_arrays(ids), Block(texts, added)


PACKS = "block long, bucket int, payload binary, counts binary, doc_ids array<long>"


def _pack(block: int, bucket: int, payload: bytes, counts: bytes = b"", doc_ids: pa.Array | None = None) -> pa.RecordBatch:
    ids = pa.array([doc_ids.to_pylist() if doc_ids is not None else None], pa.list_(pa.int64()))
    return pa.record_batch([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([payload], pa.binary()), pa.array([counts], pa.binary()), ids], ["block", "bucket", "payload", "counts", "doc_ids"])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _distinct_words(buckets: int):
    """Per block and bucket of the hash: the block's distinct pre-tokens there, each once."""

    def run(batches):
        for number, _, block in text_blocks(batches):
            order = np.argsort(bucket := _bucket(block.hashes, buckets), kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                if ends[b] < ends[b + 1]:
                    words = [block.words[i].encode() for i in order[ends[b] : ends[b + 1]].tolist()]
                    yield _pack(number, b, zstandard.compress(b"".join(words), 3), squeeze(np.array([len(w) for w in words])), pa.array([block.mark]))

    return run


def _encode_words(path: str):
    """Packs of words to packs of ids; a word that came before is not encoded again, as long as KNOWN words are enough."""

    def run(batches):
        encode, known = word_encoder(path), {}
        for batch in batches:
            for row in batch.to_pylist():
                if len(known) > KNOWN:
                    known.clear()
                joined, lengths, ids = zstandard.decompress(row["payload"]), unsqueeze(row["counts"]), []
                ends = np.cumsum(lengths).tolist()
                for s, e in zip([0, *ends[:-1]], ends):
                    word = joined[s:e]
                    if (found := known.get(word)) is None:
                        found = known[word] = np.array(encode(word.decode()), "<u4").tobytes()
                    ids.append(found)
                yield _pack(row["block"], row["bucket"], squeeze(np.frombuffer(b"".join(ids), "<u4")), squeeze(np.array([len(x) // 4 for x in ids])), pa.array(row["doc_ids"]))

    return run


def _places(buckets: int):
    """Per block, in the bucket -1: by place the rank of its pre-token among the block's, by bucket; and its documents."""

    def run(batches):
        for number, ids, block in text_blocks(batches):
            rank = np.empty(len(block.hashes), np.int64)
            rank[np.argsort(_bucket(block.hashes, buckets), kind="stable")] = np.arange(len(rank))
            yield _pack(number, -1, squeeze(rank[block.codes]), squeeze(np.concatenate([[len(rank)], block.counts, np.array([block.mark], "<i8").view("<u4")])), ids)

    return run


def _reassemble(path: str):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        own, packs = rows[0], rows[1:]
        sizes = unsqueeze(own["counts"])
        n_words, *counts = sizes[:-2].tolist()
        mark = sizes[-2:].view("<i8").tolist()
        lengths = np.concatenate([np.zeros(0, np.int64), *[unsqueeze(r["counts"]) for r in packs]]).astype(np.int64)
        if own["bucket"] != -1 or len(lengths) != n_words or any(r["doc_ids"] != mark for r in packs):
            raise ValueError("the words of a block are not those of its texts: docs must give the same rows each time it is read")
        ids = np.concatenate([np.zeros(0, "<u4"), *[unsqueeze(r["payload"]) for r in packs]])
        tokens, ends = ragged_take(ids, np.append(0, np.cumsum(lengths)), unsqueeze(own["payload"]))
        doc_token = np.append(0, ends)[np.append(0, np.cumsum(counts)).astype(np.int64)]
        raw, token_ends = ragged_take(*token_bytes(path), tokens)
        doc_byte = np.append(0, token_ends)[doc_token]
        lists = pa.ListArray.from_arrays(pa.array(doc_token, pa.int32()), pa.array(tokens.astype(np.int32)))
        decoded = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(doc_byte.astype(np.int32)), pa.py_buffer(raw)])
        return pa.table([pa.array(own["doc_ids"], pa.int64()), lists, decoded], ["doc_id", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, ids (array of int) of the whole text and decoded (binary), the bytes of these ids.

    docs must give the same rows each time it is read (a table does; a digest of each block tells if it does not). Blocks of texts become distinct pre-tokens
    and places. The distinct ones are dealt by hash, so that a very common word comes once from each block;
    a task encodes each word of its share once. Ids go back to their blocks, where places become ids and,
    by the token-byte table, bytes again. Texts themselves are not shuffled.

    Null and empty texts have no ids; each repeated row gives a row; an empty table gives none; a null key stays null;
    other columns are not read. A text is held whole, so a task needs about 50 times its largest text's size.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    least = partitions(docs.sparkSession)
    buckets = max(least, -(-text_bytes(rows) // PER_SHARE))
    words = rows.mapInArrow(_distinct_words(buckets), PACKS)
    encoded = words.repartitionById(buckets, F.col("bucket")).mapInArrow(_encode_words(path), PACKS)
    blocks = rows.mapInArrow(_places(buckets), PACKS).unionAll(encoded)
    blocks = blocks.repartition(buckets, "block") if buckets > least else blocks
    return blocks.groupBy("block").applyInArrow(_reassemble(path), "doc_id long, ids array<int>, decoded binary")
