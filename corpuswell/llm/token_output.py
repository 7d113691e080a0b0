"""Token ids as compressed files: static range asymmetric numeral systems in interleaved, independent blocks.

A folder has two Parquet tables. `table` holds the shared frequencies (id, freq, cum), which sum to 2**SCALE.
`frames` holds rows of whole documents in order: part and seq (their place), doc_ids, doc_tokens, n_tokens, and
the coded ids. The ids of a frame run through blocks of BLOCK tokens. A block has LANES interleaved states; the
i-th token of a block belongs to lane i % LANES. Every SEGMENT steps it has a checkpoint: the states there and the
place in the stream, so that segments decode in parallel. Each block has a CRC-32 of its states and stream.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuswell.llm._shared import partitions, shared_dir, staged, whole_text
from corpuswell.llm._textkernels import ragged_take
from corpuswell.llm.bpe import squeeze, text_blocks, unsqueeze

SCALE, LANES, SEGMENT, SEGMENTS = 20, 32, 512, 4
BLOCK = LANES * SEGMENT * SEGMENTS
#: Characters of a frame's texts, or one text if that is longer.
FRAME = 3 << 20
_LOW = np.uint64(1 << 31)
_U = np.uint64


@lru_cache(1)
def added_tokens(path: str) -> dict[str, int]:
    """The strings that a tokenizer file adds to its model, and their ids. Raises ValueError for one that also takes blanks or whole words only."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path).get_added_tokens_decoder()
    if odd := [t.content for t in found.values() if t.lstrip or t.rstrip or t.single_word]:
        raise ValueError(f"added tokens that match by their surroundings: {odd}")
    return {t.content: i for i, t in sorted(found.items())}


@lru_cache(1)
def word_model(path: str):
    """A function from a pre-token to its ids by the model of a tokenizer file with byte-level pre-tokens."""
    from tokenizers import Tokenizer

    model, added = Tokenizer.from_file(path).model, list(added_tokens(path).values())
    # Bytes stand in the vocabulary as printable characters: printable Latin-1 as itself, others from 256 on.
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in printable]
    letters = {b: b for b in printable} | {b: 256 + k for k, b in enumerate(rest)}

    def ids(word: str) -> list[int]:
        if "\ud800" <= word[0] <= "\udfff":  # an added token, see bpe.Block
            return [added[ord(word[0]) - 0xD800]]
        return [t.id for t in model.tokenize(word.encode().decode("latin-1").translate(letters))]

    return ids


class WordCache:
    """Ids of pre-tokens by hash. It lives as long as a Python worker and starts anew above `most` entries."""

    def __init__(self, encode, most: int = 1 << 20):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self):
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.offsets = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def look_up(self, hashes: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids joined) of the words."""
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new) and len(self.keys) + len(new) > self.most and len(self.keys):
            self._clear()
            return self.look_up(hashes, words)
        if len(new):
            found = [self.encode(words[i]) for i in new.tolist()]
            lengths = np.array([len(x) for x in found], np.int64)
            entry = len(self.offsets) - 1 + np.arange(len(new))
            self.flat = np.concatenate([self.flat, np.array([i for x in found for i in x], "<u4")])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
            keys, entries = np.concatenate([self.keys, hashes[new]]), np.concatenate([self.entry, entry])
            order = np.argsort(keys, kind="stable")
            self.keys, self.entry = keys[order], entries[order]
            at = np.searchsorted(self.keys, hashes)
        entry = self.entry[at]
        ids, ends = ragged_take(self.flat, self.offsets, entry)
        return np.diff(ends, prepend=0), ids


@lru_cache(1)
def _cache(path: str) -> WordCache:
    return WordCache(word_model(path))


STAGED = "part int, seq int, doc_ids array<long>, doc_words binary, codes binary, word_tokens binary, word_ids binary"


def _tokenise(path: str, with_added: bool):
    def run(batches):
        part, cache = TaskContext.get().partitionId(), _cache(path)
        added = tuple(added_tokens(path)) if with_added else ()
        for seq, (_, doc_ids, block) in enumerate(text_blocks(batches, FRAME, added)):
            lengths, ids = cache.look_up(block.hashes, block.words)
            row = [part, seq, doc_ids.to_pylist(), squeeze(block.counts), squeeze(block.codes), squeeze(lengths), squeeze(ids)]
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, types)], [c.split()[0] for c in STAGED.split(", ")])

    return run


def _expand(row: dict, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of a staged block with end_id after each document, tokens of each document)."""
    lengths, doc_words = unsqueeze(row["word_tokens"]).astype(np.int64), unsqueeze(row["doc_words"]).astype(np.int64)
    ids, ends = ragged_take(unsqueeze(row["word_ids"]), np.append(0, np.cumsum(lengths)), unsqueeze(row["codes"]))
    doc_ends = np.append(0, ends)[np.cumsum(doc_words)]
    return np.insert(ids, doc_ends, end_id), np.diff(doc_ends, prepend=0) + 1


def _count_ids(end_id: int):
    """Counts of ids: a pre-token's ids count as often as it stands; end_id once for each document."""

    def run(batches):
        total = np.zeros(end_id + 1, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                lengths = unsqueeze(row["word_tokens"]).astype(np.int64)
                places = np.bincount(unsqueeze(row["codes"]), minlength=len(lengths))
                counts = np.bincount(unsqueeze(row["word_ids"]), np.repeat(places, lengths), minlength=len(total)).astype(np.int64)
                counts[: len(total)] += total
                total = counts
                total[end_id] += len(row["doc_ids"])
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return run


def scaled_frequencies(ids: list[int], counts: list[int]) -> np.ndarray:
    """Frequencies by id that sum to 2**SCALE, at least 1 for each id that occurs."""
    n = np.array(counts, np.float64)
    share = np.maximum(1, np.floor(n / n.sum() * (1 << SCALE))).astype(np.int64)
    over = int(share.sum()) - (1 << SCALE)
    for i in np.argsort(-share, kind="stable"):  # the most frequent ids bear the rounding
        step = min(over, int(share[i]) // 2) if over > 0 else over
        share[i] -= step
        over -= step
        if not over:
            break
    freq = np.zeros(max(ids) + 1, np.int64)
    freq[ids] = share
    return freq


def _grid(ids: np.ndarray) -> np.ndarray:
    """Ids as blocks x steps x lanes, the last block filled up with its last id."""
    blocks = -(-len(ids) // BLOCK)
    return np.pad(ids, (0, blocks * BLOCK - len(ids)), mode="edge").reshape(blocks, -1, LANES)


def encode_frame(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> dict:
    """The coded columns of a frame: words per segment, states at checkpoints, stream, checksum per block."""
    grid = _grid(ids)
    blocks, steps, _ = grid.shape
    x = np.full((blocks, LANES), _LOW, _U)
    states = np.empty((blocks, SEGMENTS, LANES), _U)
    emitted, owner = [], []
    f64, c64 = freq.astype(_U), cum.astype(_U)
    for t in range(steps - 1, -1, -1):
        f, c = f64[grid[:, t]], c64[grid[:, t]]
        full = x >= f << _U(63 - SCALE)
        who = np.flatnonzero(full.ravel())
        emitted.append((x.ravel()[who] & _U(0xFFFFFFFF)).astype("<u4"))
        owner.append((who // LANES).astype(np.int32))
        x[full] >>= _U(32)
        q = x // f
        x = (q << _U(SCALE)) + (x - q * f) + c
        if t % SEGMENT == 0:
            states[:, t // SEGMENT] = x
    words = np.concatenate(emitted[::-1])
    step = np.repeat(np.arange(steps), [len(e) for e in emitted[::-1]])
    place = np.concatenate(owner[::-1]).astype(np.int64) * SEGMENTS + step // SEGMENT
    order = np.argsort(place, kind="stable")
    sizes = np.bincount(place, minlength=blocks * SEGMENTS)
    stream, ends = words[order], np.cumsum(sizes)[SEGMENTS - 1 :: SEGMENTS]
    sums = [zlib.crc32(stream[a:b].tobytes(), zlib.crc32(s.tobytes())) for a, b, s in zip([0, *ends[:-1]], ends, states)]
    return {"sizes": sizes.astype("<u4"), "states": states.astype("<u8"), "stream": stream, "sums": sums}


def decode_frame(n: int, sizes: np.ndarray, states: np.ndarray, stream: np.ndarray, sums: list[int], freq: np.ndarray, cum: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The n ids of a frame; all its segments are decoded side by side. Raises ValueError where a checksum differs."""
    states = states.reshape(-1, SEGMENTS, LANES)
    ends = np.cumsum(sizes)
    block_ends = ends[SEGMENTS - 1 :: SEGMENTS]
    for k, (a, b) in enumerate(zip([0, *block_ends[:-1]], block_ends)):
        if zlib.crc32(stream[a:b].tobytes(), zlib.crc32(states[k].tobytes())) != sums[k]:
            raise ValueError(f"block {k} does not match its checksum")
    x = states.reshape(-1, LANES).astype(_U)
    at = (ends - sizes).astype(np.int64)
    out = np.empty((len(x), SEGMENT, LANES), np.uint32)
    f64, c64 = freq.astype(_U), cum.astype(_U)
    padded = np.append(stream, np.zeros(LANES, "<u4")).astype(_U)
    for t in range(SEGMENT):
        low = x & _U((1 << SCALE) - 1)
        ids = slots[low]
        out[:, t] = ids
        x = f64[ids] * (x >> _U(SCALE)) + low - c64[ids]
        need = x < _LOW
        rank = np.cumsum(need, axis=1)
        took = padded[(at[:, None] + rank - 1)[need]]
        x[need] = x[need] << _U(32) | took
        at += rank[:, -1]
    return out.ravel()[:n]


FRAMES = "part int, seq int, doc_ids array<long>, doc_tokens array<int>, n_tokens long, sizes binary, states binary, stream binary, sums array<long>"


def _tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return freq, np.cumsum(freq) - freq


def _write_frames(freq: np.ndarray, end_id: int):
    def run(batches):
        f, c = _tables(freq)
        for batch in batches:
            for row in batch.to_pylist():
                ids, doc_tokens = _expand(row, end_id)
                coded = encode_frame(ids, f, c)
                values = [row["part"], row["seq"], row["doc_ids"], doc_tokens.tolist(), len(ids), coded["sizes"].tobytes(), coded["states"].tobytes(), coded["stream"].tobytes(), coded["sums"]]
                types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64())]
                yield pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], [x.split()[0] for x in FRAMES.split(", ")])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, key: str = "doc_id", text: str = "text", with_added: bool = True) -> str:
    """Writes the ids of whole texts, each document ended by end_id, in ascending doc_id order; returns the folder.

    As in the tokenizer's library, a string that its file adds as a token (`<|endoftext|>`) is that token wherever a text holds it;
    with_added=False spells it out. Documents are dealt by ranges of doc_id (equal ones by how their texts begin, then in order of whole texts), tokenised once and staged as distinct pre-tokens
    and places; counts of ids over all documents make the shared table, which is at most the vocabulary; then
    frames are coded, each by itself. Null and empty texts are the end id alone; null keys come first;
    repeated rows are documents of their own; an empty table writes no frames; other columns are not read.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/corpuswell/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    tokens = staged(ordered.mapInArrow(_tokenise(tokenizer, with_added), STAGED), "tokenised")
    counts = tokens.mapInArrow(_count_ids(end_id), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = sorted((r["id"], r["n"]) for r in counts.collect())  # a row per id of the vocabulary at most
    freq = scaled_frequencies([i for i, _ in found], [n for _, n in found]) if found else np.array([1 << SCALE])
    cum = _tables(freq)[1]
    spark.createDataFrame([(int(i), int(freq[i]), int(cum[i])) for i in np.flatnonzero(freq)], "id int, freq long, cum long").coalesce(1).write.parquet(f"{path}/table")
    tokens.mapInArrow(_write_frames(freq, end_id), FRAMES).write.parquet(f"{path}/frames")
    return path


def _read_frames(freq: np.ndarray):
    def run(batches):
        f, c = _tables(freq)
        slots = np.repeat(np.arange(len(f), dtype=np.uint32), f)
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_frame(
                    row["n_tokens"], np.frombuffer(row["sizes"], "<u4").astype(np.int64), np.frombuffer(row["states"], "<u8"), np.frombuffer(row["stream"], "<u4"), row["sums"], f, c, slots
                )
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((np.append(0, ends) * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(ends - sizes + row["frame_start"], pa.int64()), pa.array(sizes, pa.int64()), raw], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_tokens(spark: SparkSession, path: str, broadcast_frames: int = 500_000) -> DataFrame:
    """Up to broadcast_frames frames (24 bytes each) their starts are broadcast; beyond, they are joined by a shuffle.
    Gives doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian unsigned 32 bit) of a folder."""
    table = spark.read.parquet(f"{path}/table").collect()
    freq = np.zeros(max(r["id"] for r in table) + 1, np.int64)
    freq[[r["id"] for r in table]] = [r["freq"] for r in table]
    frames = spark.read.schema(FRAMES).parquet(f"{path}/frames")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = frames.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per partition
    parts = sums.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("part_start"))
    inner = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    starts = frames.select("part", "seq", inner.alias("inner_start")).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("inner_start")).alias("frame_start"))
    if frames.count() <= broadcast_frames:
        starts = F.broadcast(starts)
    return frames.join(starts, ["part", "seq"]).mapInArrow(_read_frames(freq), "doc_id long, start long, n_tokens long, ids binary")
