"""Repeated byte strings across a corpus: candidate suffixes are sorted deep-shallow, later copies are removed.

A string of SPAN bytes is a window. Of the GRAM-byte grams in a window those with the least hash are its anchors,
so equal windows have equal anchors at equal places. Only anchors whose gram occurs twice are looked at
further: their contexts (up to SPAN - GRAM bytes before, SPAN bytes after) hold all windows that could repeat.
Contexts of a share of the anchors meet in a task, which sorts their suffixes, and their prefixes read backwards,
by multikey quicksort to a shallow depth and by blind tries beyond it. From both orders and their common
prefix lengths follows, for each window, whether an equal one starts earlier.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswell.llm._shared import digest, partitions, staged, text_bytes, whole_text
from corpuswell.llm._textkernels import _power_tables, mix
from corpuswell.llm.bpe import squeeze, unsqueeze

SPAN, GRAM = 100, 50
LEFT = SPAN - GRAM
CHUNK, BLOCK = 1 << 20, 3 << 20
#: Shares of the contexts for each partition of a shuffle: a share is sorted in memory, at about 1 KB a context.
SHARES = 4
#: Bytes of text for each bucket of grams and each partition of blocks, and for each share of contexts, where partitions of a shuffle would get more.
PER_BUCKET, PER_SHARE = 64 << 20, 8 << 20
#: How carried columns are written as JSON, so that times lose no digit.
CARRIED = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_U = np.uint64


def _sliding(op, values: np.ndarray, width: int) -> np.ndarray:
    """op over each `width` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(values) - width + 1], out[width - have : width - have + len(values) - width + 1])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of the texts data[start:end]; texts stand one after the other."""
    n = len(data)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _U(0xFF51AFD7ED558CCD) * up[:n], out=total[1:])
    h = mix((total[GRAM:] - total[:-GRAM]) * down[: n + 1 - GRAM])
    h |= _U(1)  # 0 marks windows that no text holds whole
    least = _sliding(np.minimum, h, LEFT + 1)
    inside = np.zeros(n + 1, np.int32)
    long = ends - starts >= SPAN
    inside[starts[long]] = 1
    inside[ends[long] - SPAN + 1] -= 1
    least[np.cumsum(inside)[: len(least)] == 0] = 0
    padded = np.zeros(len(least) + 2 * LEFT, _U)
    padded[LEFT : LEFT + len(least)] = least
    places = np.flatnonzero(_sliding(np.maximum, padded, LEFT + 1)[: len(h)] == h)
    return places, h[places]


class BlindTrie:
    """Orders byte strings of one length that share a prefix; inner nodes look at one byte only."""

    def __init__(self, rows: list[bytes]):
        self.rows, self.root = rows, None
        for k in range(len(rows)):
            self._insert(k)

    def _insert(self, k: int):
        row = self.rows[k]
        if self.root is None:
            self.root = [k]
            return
        node = self.root
        while isinstance(node, tuple):  # blind descent: skipped bytes are not compared
            node = node[1].get(row[node[0]]) or next(iter(node[1].values()))
        other = self.rows[node[0]]
        if other == row:
            node.append(k)
            return
        a, b = int.from_bytes(other), int.from_bytes(row)
        depth = len(row) - ((a ^ b).bit_length() + 7) // 8
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            parent, node = node, node[1][row[node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][row[depth]] = [k]
            return
        split = (depth, {other[depth]: node, row[depth]: [k]})
        if parent is None:
            self.root = split
        else:
            parent[1][row[parent[0]]] = split

    def in_order(self) -> tuple[list[int], list[int]]:
        """(numbers of the rows in order, common prefix of each with the one before it; the first has 0)."""
        order, common, todo = [], [], [(self.root, 0)]
        while todo:
            node, above = todo.pop()
            if isinstance(node, list):
                order += node
                common += [above, *[len(self.rows[0])] * (len(node) - 1)]
            else:
                children = [node[1][b] for b in sorted(node[1])]
                todo += [(c, node[0]) for c in reversed(children[1:])]
                todo.append((children[0], above))
        return order, common


def deep_shallow(rows: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows (n x length bytes) in order, and the prefix that each shares with the one before it.

    Multikey quicksort takes eight bytes as one character and goes on, to `shallow` bytes, only within groups that
    are equal so far. Larger groups that remain go to blind tries; pairs are compared at once.
    """
    n, length = rows.shape
    width = -(-length // 8) * 8
    keys = np.zeros((n, width), np.uint8)
    keys[:, :length] = rows
    keys = keys.view(">u8").astype(_U)
    order, common = np.arange(n), np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)  # by place in the order
    for k in range(min(shallow, width) // 8):
        places = np.arange(n) if k == 0 else np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(places):
            break
        found = np.lexsort((keys[order[places], k], group[places]))
        order[places] = order[places[found]]
        part, own = keys[order[places], k], group[places]
        fresh = np.ones(len(places), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (part[1:] != part[:-1])
        inner = np.flatnonzero(fresh[1:] & (own[1:] == own[:-1])) + 1
        common[places[inner]] = 8 * k + _equal_bytes(part[inner], part[inner - 1])
        starts = np.zeros(n, bool)
        starts[1:] = group[1:] != group[:-1]
        starts[places[fresh]] = True
        starts[0] = False
        group = np.cumsum(starts)
    sizes = np.bincount(group, minlength=1)
    first = np.cumsum(sizes) - sizes
    two = first[sizes == 2]
    if len(two):
        a, b = rows[order[two]], rows[order[two + 1]]
        differ = a != b
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        common[two + 1] = at
        some = np.flatnonzero(at < length)
        swap = two[some[a[some, at[some]] > b[some, at[some]]]]
        order[swap], order[swap + 1] = order[swap + 1], order[swap]
    for g in np.flatnonzero(sizes > 2).tolist():
        lo, hi = first[g], first[g] + sizes[g]
        members = order[lo:hi]
        ranks, shared = BlindTrie([r.tobytes() for r in rows[members]]).in_order()
        order[lo:hi] = members[ranks]
        common[lo + 1 : hi] = shared[1:]
    return order, np.minimum(common, length)


def _equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes in which unequal 64-bit keys agree."""
    differ = (a ^ b).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
    return differ.argmax(axis=1)


def covered_windows(contexts: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context (in order of occurrence) the least and the greatest number of bytes before the anchor
    at which a window starts that an earlier context holds too; least above greatest where there is none.

    contexts: LEFT bytes before and SPAN bytes from the anchor on, of which left and right are in the text.
    """
    n = len(contexts)
    least, most = np.full(n, 255), np.full(n, -1)
    if not n:
        return least, most
    suffixes, prefixes = contexts[:, LEFT:], contexts[:, LEFT - 1 :: -1]
    by_suffix, deep = deep_shallow(suffixes, 64)
    by_prefix, wide = deep_shallow(prefixes, 24)

    def runs(order, common, depth):
        """Rows with an equal number share `depth` bytes."""
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(common < depth)
        return out

    # Equal contexts: all but the first are covered whole; one of each goes on.
    whole = np.stack([runs(by_suffix, deep, SPAN), runs(by_prefix, wide, LEFT), left, right])
    alike = np.lexsort([np.arange(n), *whole])
    same = np.zeros(n, bool)
    same[1:] = (whole[:, alike[1:]] == whole[:, alike[:-1]]).all(axis=0)
    later = alike[same]
    full = later[left[later].astype(int) + right[later] >= SPAN]
    least[full], most[full] = np.maximum(0, SPAN - right[full].astype(int)), left[full]
    gram = runs(by_suffix, deep, GRAM)
    open_ = np.sort(alike[~same])
    open_ = open_[np.bincount(gram[open_])[gram[open_]] > 1]
    for o in range(LEFT + 1):
        rows = open_[(left[open_] >= o) & (right[open_] >= SPAN - o)]
        key = runs(by_suffix, deep, SPAN - o)[rows] * (n + 1) + runs(by_prefix, wide, o)[rows]
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(rows), bool)
        again[1:] = key[order[1:]] == key[order[:-1]]
        found = rows[order[again]]
        least[found] = np.minimum(least[found], o)
        most[found] = np.maximum(most[found], o)
    return least, most


PACKS = "block long, bucket int, payload binary, more binary, doc_ids array<long>, carried array<string>"
_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string())]
_NAMES = [c.split()[0] for c in PACKS.split(", ")]


def _row(*values) -> pa.RecordBatch:
    values = (*values, *[None] * (len(_TYPES) - len(values)))
    return pa.record_batch([pa.array([v], t) for v, t in zip(values, _TYPES)], _NAMES)


def _blocks(batches):
    """(number, doc ids, texts as bytes, carried columns as JSON) of a task's rows (doc_id, text, carried)."""
    ids, texts, carried, size, number = [], [], [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        for i, t, c in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
            t = t.as_py()
            ids.append(i)
            texts.append(t)
            carried.append(c)
            size += len(t)
            if size >= BLOCK:
                yield number, ids, texts, carried
                ids, texts, carried, size, number = [], [], [], 0, number + 1
    if ids:
        yield number, ids, texts, carried


def _block_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, places, hashes) of a block; texts are looked at in chunks, places count through the block."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    cuts = np.cumsum([0, *map(len, texts)])
    places, hashes, lo = [], [], 0
    while lo < len(texts):
        hi = min(len(texts), max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + CHUNK))))
        at, h = anchors(data[cuts[lo] : cuts[hi]], cuts[lo:hi] - cuts[lo], cuts[lo + 1 : hi + 1] - cuts[lo])
        places.append(at + cuts[lo])
        hashes.append(h)
        lo = hi
    return data, np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, _U), *hashes]) >> _U(16)


def _shares(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets end in sorted 48-bit hashes."""
    return np.searchsorted((hashes * _U(buckets)) >> _U(48), np.arange(buckets + 1))


def _digest_of(data: np.ndarray, lengths: np.ndarray) -> int:
    return digest(data.tobytes(), lengths.astype("<i8").tobytes())


def _send_grams(buckets: int):
    """Per block and bucket the distinct gram hashes, sorted, 6 bytes each."""

    def run(batches):
        for number, _, texts, _ in _blocks(batches):
            mark = [_digest_of(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))]
            grams = np.unique(_block_anchors(texts)[2])
            ends = _shares(grams, buckets)
            for b in range(buckets):
                own = grams[ends[b] : ends[b + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                yield _row(number, b, own.tobytes(), None, mark)

    return run


def _find_repeats(batches):
    """Per block and bucket a bit for each gram: whether another block has it."""
    packs = [r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)))]
    grams = []
    for _, _, p, _ in packs:
        wide = np.zeros((len(p) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(p, np.uint8).reshape(-1, 6)
        grams.append(wide.view("<u8").ravel())
    every = np.sort(np.concatenate([np.zeros(0, "<u8"), *grams]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    for (block, bucket, _, mark), own in zip(packs, grams):
        at = np.searchsorted(twice, own)
        bits = np.append(twice, 0)[at] == own if len(twice) else np.zeros(len(own), bool)
        yield _row(block, bucket, np.packbits(bits).tobytes(), np.array([len(own)], "<u4").tobytes(), mark)


def _send_texts(batches):
    """Per block, in the bucket -1, its documents and texts."""
    for number, ids, texts, carried in _blocks(batches):
        yield _row(number, -1, zstandard.compress(b"".join(texts), 9), squeeze(np.array([len(t) for t in texts])), ids, carried)


def _unpack_texts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.decompress(row["payload"]), np.uint8), np.append(0, np.cumsum(unsqueeze(row["more"]).astype(np.int64)))


def _send_contexts(buckets: int):
    """Per block: contexts of anchors that repeat, by bucket, each distinct context once; spans of the block's own copies."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        own = rows[0]
        data, cuts = _unpack_texts(own)
        mark = _digest_of(data, np.diff(cuts))
        data, places, hashes = _block_anchors([data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])])
        grams, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        bits = [np.unpackbits(np.frombuffer(r["payload"], np.uint8))[: np.frombuffer(r["more"], "<u4")[0]] for r in rows[1:]]
        repeats = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)
        if own["bucket"] != -1 or len(repeats) != len(grams) or any(r["doc_ids"] != [mark] for r in rows[1:]):
            raise ValueError("a block's grams are not those of its texts: docs must give the same rows each time it is read")
        kept = (repeats | (counts > 1))[inverse]
        at, gram = places[kept], hashes[kept]
        doc = np.searchsorted(cuts, at, side="right") - 1
        left, right = np.minimum(LEFT, at - cuts[doc]), np.minimum(SPAN, cuts[doc + 1] - at)
        # Occurrences in order: documents by id (then by place in the block), then place.
        doc_ids = np.array([-(1 << 63) if i is None else i for i in own["doc_ids"]], np.int64)
        order = np.lexsort((at, doc, doc_ids[doc]))
        at, gram, left, right, doc = at[order], gram[order], left[order], right[order], doc[order]
        padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(SPAN, np.uint8)])
        contexts = np.lib.stride_tricks.sliding_window_view(padded, LEFT + SPAN)[at] if len(at) else np.zeros((0, LEFT + SPAN), np.uint8)
        contexts = contexts.copy()
        column = np.arange(LEFT + SPAN)
        short = np.flatnonzero((left < LEFT) | (right < SPAN))
        contexts[short] *= (column >= LEFT - left[short, None]) & (column < LEFT + right[short, None])
        sized = np.concatenate([contexts, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1)
        _, first = np.unique(np.ascontiguousarray(sized).view(f"V{sized.shape[1]}").ravel(), return_index=True)
        alone = np.zeros(len(at), bool)
        alone[first] = True
        copies = np.flatnonzero(~alone & (left + right >= SPAN))
        out = [_row(own["block"], -1, squeeze(at[copies] - left[copies]), squeeze(at[copies] + right[copies]), None, [str(mark)])]
        rest = np.sort(first)
        rest = rest[np.argsort(gram[rest], kind="stable")]
        ends = _shares(gram[rest], buckets)
        for b in range(buckets):
            pick = rest[ends[b] : ends[b + 1]]
            if len(pick):
                body = np.concatenate([doc_ids[doc[pick]].astype("<i8").view(np.uint8), at[pick].astype("<i8").view(np.uint8), sized[pick].ravel()])
                out.append(_row(own["block"], b, zstandard.compress(body.tobytes(), 3), np.array([len(pick)], "<u4").tobytes(), None))
        return pa.Table.from_batches(out)

    return run


def _sort_contexts(batches):
    """Per bucket: spans of the blocks' texts that an earlier occurrence covers."""
    blocks, ids, at, sized = [], [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            n, body = np.frombuffer(row["more"], "<u4")[0], np.frombuffer(zstandard.decompress(row["payload"]), np.uint8)
            ids.append(body[: 8 * n].view("<i8"))
            at.append(body[8 * n : 16 * n].view("<i8"))
            sized.append(body[16 * n :].reshape(n, -1))
            blocks.append(np.full(n, row["block"]))
    if not blocks:
        return
    blocks, ids, at, sized = map(np.concatenate, (blocks, ids, at, sized))
    order = np.lexsort((at, blocks, ids))
    blocks, at, sized = blocks[order], at[order], sized[order]
    least, most = covered_windows(sized[:, : LEFT + SPAN], sized[:, -2], sized[:, -1])
    found = np.flatnonzero(most >= least)
    found = found[np.argsort(blocks[found], kind="stable")]
    numbers, first = np.unique(blocks[found], return_index=True)
    for number, own in zip(numbers.tolist(), np.split(found, first[1:])):
        yield _row(number, 0, squeeze(at[own] - most[own]), squeeze(at[own] + SPAN - least[own]), None)


def _remove(whole_characters: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["doc_ids"] is None)
        own = rows[0]
        data, cuts = _unpack_texts(own)
        marks = [r["carried"] for r in rows[1:] if r["carried"] is not None]
        if own["doc_ids"] is None or marks != [[str(_digest_of(data, np.diff(cuts)))]]:
            raise ValueError("a block's spans are not those of its texts: docs must give the same rows each time it is read")
        depth = np.zeros(len(data) + 1, np.int32)
        for r in rows[1:]:
            np.add.at(depth, unsqueeze(r["payload"]).astype(np.int64), 1)
            np.add.at(depth, unsqueeze(r["more"]).astype(np.int64), -1)
        gone = np.cumsum(depth)[:-1] > 0
        if whole_characters:  # a character goes if all its bytes go
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            if len(lead):
                gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(data))))
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = gone[1:] != gone[:-1]
        edge[cuts] = True
        marks = np.flatnonzero(edge)
        begin = marks[:-1][gone[marks[:-1]]] if len(data) else marks[:0]
        end = marks[np.searchsorted(marks, begin) + 1]
        per_doc = np.searchsorted(begin, cuts)
        origin = cuts[np.searchsorted(cuts, begin, side="right") - 1]
        spans = pa.StructArray.from_arrays([pa.array((begin - origin).astype(np.int64)), pa.array((end - origin).astype(np.int64))], ["begin", "end"])
        kept = data[~gone]
        kept_cuts = np.append(0, np.cumsum(~gone))[cuts].astype(np.int32)
        texts = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(kept_cuts), pa.py_buffer(kept)])
        sizes = pa.array(np.diff(cuts), pa.int64())
        return pa.table([pa.array(own["doc_ids"], pa.int64()), sizes, pa.ListArray.from_arrays(pa.array(per_doc.astype(np.int32)), spans), texts, pa.array(own["carried"], pa.string())], ["doc_id", "n_bytes", "spans", "kept", "carried"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", whole_characters: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, spans (array of begin, end: the maximal removed runs), kept (binary) and carried.

    A byte goes if a string of SPAN bytes that covers it also starts earlier: in a document with a smaller doc_id (null
    first), in a row stored before of the same doc_id, or earlier in the same text. Strings are judged on the input.
    whole_characters=True leaves characters that would lose only some bytes, so that kept is valid UTF-8.

    Shuffled are the grams of one anchor in about 25 bytes, compressed texts twice, and contexts of anchors that repeat. A
    block sends each gram and each context once, so a passage in a third of all documents comes once per block and
    equal contexts. docs must give the same rows each time it is read (a table does); a digest of each block's texts tells if it does not.

    Null and empty texts, and those under SPAN bytes, lose nothing; of repeated rows all but the first lose
    everything from SPAN bytes on; an empty table gives no rows. Columns named in carry come along as a JSON
    object in carried (else null), so that texts need not be joined with them; others are not read.
    """
    carried = F.to_json(F.struct(*carry), CARRIED) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"), carried.alias("carried"))
    least, total = partitions(docs.sparkSession), text_bytes(rows)
    buckets, shares = max(least, -(-total // PER_BUCKET)), max(SHARES * least, -(-total // PER_SHARE))
    # As many partitions as the data need, where the session's are too few.
    dealt = lambda df: df.repartition(buckets, "block") if buckets > least else df
    repeats = rows.mapInArrow(_send_grams(buckets), PACKS).repartitionById(buckets, F.col("bucket")).mapInArrow(_find_repeats, PACKS)
    texts = rows.mapInArrow(_send_texts, PACKS)
    contexts = staged(dealt(texts.unionAll(repeats)).groupBy("block").applyInArrow(_send_contexts(shares), PACKS), "contexts")
    sorted_ = contexts.where("bucket >= 0").repartitionById(shares, F.col("bucket")).mapInArrow(_sort_contexts, PACKS)
    spans = contexts.where("bucket < 0").unionAll(sorted_)
    return dealt(texts.unionAll(spans)).groupBy("block").applyInArrow(
        _remove(whole_characters), "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary, carried string"
    )
