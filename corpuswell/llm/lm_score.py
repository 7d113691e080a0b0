"""Language-model scores of documents: Katz backoff over Good-Turing discounted n-gram counts."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswell.llm._shared import digest, partitions, staged, text_bytes, whole_text
from corpuswell.llm._textkernels import mix, segment_hashes, space_words

#: Bytes of text of a block, and bytes of text for each share of the n-grams where partitions of a shuffle would get more.
BLOCK, PER_SHARE = 6 << 20, 32 << 20
#: Counts up to this are discounted.
DISCOUNTED = 5
_U = np.uint64
#: What stands before a document's first token and after its last word; words hash to 64 bits elsewhere.
START, END = _U(0x9D8F3A11C2B7E645), _U(0x5C1E88F0A37D2B9F)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of eight bytes each, compressed byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unplaned(packed: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_keys(ascending: np.ndarray) -> bytes:
    return _planes(np.diff(ascending, prepend=_U(0)))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(packed, "<u8"), dtype=_U)


def _shares(keys: np.ndarray, shares: int) -> np.ndarray:
    """Where the shares of ascending keys begin and end; a share is a range of hashes."""
    of = ((keys >> _U(32)) * _U(shares)) >> _U(32)
    return np.searchsorted(of, np.arange(shares + 1, dtype=_U))


@dataclass
class Level:
    """The distinct n-grams of a block, ascending by key: how often they stand in training texts here, the numbers of context and
    suffix among the (n-1)-grams, and by token the number of its n-gram, or -1. What the whole corpus knows of them comes later."""

    keys: np.ndarray
    here: np.ndarray
    context: np.ndarray
    suffix: np.ndarray
    token: np.ndarray
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    owned: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spare: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Block:
    """Some texts as their n-grams of 1 to `order` tokens. Tokens are lower-cased words and one end for each text."""

    def __init__(self, texts: list[bytes], training: np.ndarray, order: int):
        cuts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        data = b" ".join(texts).lower() + b" "
        starts, ends = space_words(data)
        words = mix(segment_hashes(np.frombuffer(data, np.uint8), starts, ends) + _U(1))
        n_words = np.diff(np.searchsorted(starts, cuts))
        self.first = np.append(0, np.cumsum(n_words + 1))
        last = np.zeros(self.first[-1], bool)
        last[self.first[1:] - 1] = True
        token = np.full(len(last), END, _U)
        token[~last] = words
        opening = np.zeros(len(last), bool)
        opening[self.first[:-1]] = True
        place = np.arange(len(token)) - np.repeat(self.first[:-1], n_words + 1)
        train = np.repeat(training, n_words + 1)
        # The start is a context like a word; it stands once in each training text, and is no token.
        keys, inverse = np.unique(np.append(token, START), return_inverse=True)
        here = np.bincount(inverse[:-1], weights=train, minlength=len(keys)).astype(np.int64)
        here[inverse[-1]] = training.sum()
        none = np.zeros(0, np.int64)
        self.levels = [Level(keys, here, none, none, inverse[:-1])]
        key, number, begin = token, inverse[:-1], inverse[-1]
        for n in range(2, order + 1):
            context = np.append(START, key[:-1])
            context_number = np.append(begin, number[:-1])
            context[opening], context_number[opening] = START, begin
            there = place >= n - 2
            key = np.where(there, mix(context * _U(0x9E3779B97F4A7C15) + token + _U(n)), _U(0))
            at = np.flatnonzero(there)
            keys, one, inverse = np.unique(key[at], return_index=True, return_inverse=True)
            here = np.bincount(inverse, weights=train[at], minlength=len(keys)).astype(np.int64)
            full = np.full(len(token), -1, np.int64)
            full[at] = inverse
            self.levels.append(Level(keys, here, context_number[at[one]], number[at[one]], full))
            number = full
        self.mark = digest(*[x.keys.tobytes() for x in self.levels], self.first.tobytes())


@dataclass(frozen=True)
class Discounts:
    """What the whole corpus says of the n-grams of one length: their number, the sum of their counts, factors by count."""

    types: int
    total: int
    factors: tuple[float, ...]

    @classmethod
    def of(cls, histogram: list[int], types: int, total: int) -> Discounts:
        """Good-Turing factors from how many n-grams have each count from 1 to DISCOUNTED + 1, as Katz scales them, so that none is needed above.

        Where the histogram gives no factor between 0 and 1, half an occurrence is taken off.
        """
        n = [0, *histogram]
        k, factors = DISCOUNTED, [0.0]
        top = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        for r in range(1, k + 1):
            turing = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top != 1 else 0.0
            factors.append(turing if 0 < turing < 1 else 1 - 0.5 / r)
        return cls(types, total, tuple(factors))

    def kept(self, count: np.ndarray) -> np.ndarray:
        """What is left of counts."""
        return count * np.append(self.factors, 1.0)[np.minimum(count, DISCOUNTED + 1)]


def _whole(total: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """What the counts after a context are divided by: where nothing was taken off them, one more, so that something is left for other words."""
    return total + np.where(spare > 0, 0, 1)


def unigrams(level: Level, known: Discounts, missing: float) -> np.ndarray:
    """Probabilities of a block's distinct tokens; missing is what was taken off all counts, which goes to unknown words."""
    whole = known.total + (missing <= 0)
    return np.where(level.count > 0, known.kept(level.count), max(missing, float(missing <= 0))) / whole


def probabilities(block: Block, known: list[Discounts], missing: float, upto: int) -> list[np.ndarray]:
    """For lengths 1 to `upto` the probability of the last token of each distinct n-gram of the block after the others, by backoff."""
    out = [unigrams(block.levels[0], known[0], missing)]
    for n in range(2, upto + 1):
        level, contexts = block.levels[n - 1], block.levels[n - 2]
        whole = _whole(contexts.count, contexts.spare)[level.context]
        out.append(np.where(level.count > 0, known[n - 1].kept(level.count) / np.maximum(whole, 1), contexts.weight[level.context] * out[-1][level.suffix]))
    return out


PACKS = "block long, kind string, level int, share int, mark long, a binary, b binary, c binary"
_NAMES = [c.split()[0] for c in PACKS.split(", ")]


def _pack(block: int, kind: str, level: int, share: int, mark: int, a: bytes, b: bytes = b"", c: bytes = b"") -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array([x], t) for x, t in zip((block, kind, level, share, mark, a, b, c), kinds)], _NAMES)


def _text_blocks(batches, most: int):
    """(number, ids, which are null, training, texts) of a task's rows (doc_id, training, text)."""
    ids, training, texts, size, k = [], [], [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        for i, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            ids.append(i)
            training.append(t)
            texts.append(x.as_py())
            size += len(texts[-1]) + 1
            if size >= most:
                yield k, ids, np.array(training, bool), texts
                ids, training, texts, size, k = [], [], [], 0, k + 1
    if texts:
        yield k, ids, np.array(training, bool), texts


def _grams(order: int, shares: int, most: int):
    """Of each block, level and share the distinct n-grams and how often they stand in training texts there."""

    def run(batches):
        for number, _, training, texts in _text_blocks(batches, most):
            block = Block(texts, training, order)
            for n, level in enumerate(block.levels, 1):
                ends = _shares(level.keys, shares).tolist()
                for s, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
                    if lo < hi:
                        yield _pack(number, "ask", n, s, block.mark, _pack_keys(level.keys[lo:hi]), _planes(level.here[lo:hi]))

    return run


def _by_level(batches):
    """The packs of a share by level, and for each level all keys in order, and of each pack where its keys are among them."""
    packs: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            packs.setdefault(row["level"], []).append(row)
    for n in sorted(packs):
        own = sorted(packs[n], key=lambda r: r["block"])
        keys = [_unpack_keys(r["a"]) for r in own]
        every = np.unique(np.concatenate(keys))
        yield n, own, every, [np.searchsorted(every, k) for k in keys]


def _count(batches):
    """A share's counts over all blocks: the table of the model (kind `counts`), a histogram (`histogram`), and what each block asked for (`count`),
    where an n-gram belongs to the first block that has it in a training text."""
    for n, own, every, places in _by_level(batches):
        here = [_unplaned(r["b"], "<i8") for r in own]
        count, owner = np.zeros(len(every), np.int64), np.full(len(every), -1)
        for k in range(len(own) - 1, -1, -1):
            count[places[k]] += here[k]
            owner[places[k][here[k] > 0]] = k
        kept = count > 0
        yield _pack(-1, "counts", n, own[0]["share"], 0, _pack_keys(every[kept]), _planes(count[kept]))
        real = count[kept & (every != START)] if n == 1 else count[kept]
        sizes = np.bincount(np.minimum(real, DISCOUNTED + 2), minlength=DISCOUNTED + 2)[1 : DISCOUNTED + 2]
        yield _pack(-1, "histogram", n, own[0]["share"], 0, np.array([*sizes, len(real), real.sum()], "<i8").tobytes())
        for k, row in enumerate(own):
            yield _pack(row["block"], "count", n, row["share"], row["mark"], _planes(count[places[k]]), np.packbits(owner[places[k]] == k).tobytes())


def _weigh(batches):
    """A share's contexts: what is left for words that did not follow, and by what the shorter n-grams' probabilities are multiplied then."""
    for n, own, every, places in _by_level(batches):
        total, spare, low = np.zeros(len(every), np.int64), np.zeros(len(every)), np.zeros(len(every))
        for row, at in zip(own, places):
            counted, (taken, covered) = _unplaned(row["c"], "<i8"), _unplaned(row["b"], "<f8").reshape(2, -1)
            total[at] = counted
            spare[at] += taken
            low[at] += covered
        left = np.where(spare > 0, spare, 1.0) / np.maximum(_whole(total, spare), 1)
        weight = np.where(total > 0, left / np.maximum(1 - low, 1e-300), 1.0)
        kept = total > 0
        yield _pack(-1, "weights", n, own[0]["share"], 0, _pack_keys(every[kept]), _planes(weight[kept]))
        for row, at in zip(own, places):
            yield _pack(row["block"], "weight", n, row["share"], row["mark"], _planes(weight[at]), np.packbits(spare[at] > 0).tobytes())


def _texts(most: int):
    """Blocks of texts, compressed, which meet what the shares answered."""

    def run(batches):
        for number, ids, training, texts in _text_blocks(batches, most):
            about = np.array([[i or 0, i is None, t, len(x)] for i, t, x in zip(ids, training, texts)], "<i8")
            yield _pack(number, "text", 0, -1, 0, zstandard.compress(b"".join(texts), 3), _planes(about.ravel()))

    return run


def _with_answers(order: int, use):
    """use(number, block, about) for a block of texts, filled with the answers."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["level"], r["share"]))
        own = [r for r in rows if r["kind"] == "text"]
        if len(own) != 1:
            raise ValueError("docs must give the same rows each time it is read")
        about = _unplaned(own[0]["b"], "<i8").reshape(-1, 4)
        ends = np.cumsum(about[:, 3]).tolist()
        joined = zstandard.decompress(own[0]["a"])
        block = Block([joined[a:b] for a, b in zip([0, *ends[:-1]], ends)], about[:, 2] > 0, order)
        if any(r["mark"] != block.mark for r in rows if r["kind"] != "text"):
            raise ValueError("docs must give the same rows each time it is read")
        for n, level in enumerate(block.levels, 1):
            for kind, first, kind_of, second in (("count", "count", "<i8", "owned"), ("weight", "weight", "<f8", "spare")):
                found = [r for r in rows if r["kind"] == kind and r["level"] == n]
                if not found:
                    continue
                parts = [_unplaned(r["a"], kind_of) for r in found]
                setattr(level, first, np.concatenate(parts))
                setattr(level, second, np.concatenate([np.unpackbits(np.frombuffer(r["b"], np.uint8), count=len(p)).astype(bool) for r, p in zip(found, parts)]))
                if len(getattr(level, first)) != len(level.keys):
                    raise ValueError("docs must give the same rows each time it is read")
        return use(own[0]["block"], block, about)

    return run


def _sums(order: int, shares: int, known: list[Discounts], missing: float, n: int):
    """For the contexts of a block's n-grams: what was taken off the counts of those that belong to the block, and the shorter n-grams' probabilities that they cover."""

    def use(number: int, block: Block, about: np.ndarray) -> pa.Table:
        level, contexts = block.levels[n - 1], block.levels[n - 2]
        low = probabilities(block, known, missing, n - 1)[-1]
        own = level.owned
        at, count = level.context[own], level.count[own]
        taken = np.bincount(at, weights=count - known[n - 1].kept(count), minlength=len(contexts.keys))
        covered = np.bincount(at, weights=low[level.suffix[own]], minlength=len(contexts.keys))
        ends = _shares(contexts.keys, shares).tolist()
        packs = [
            _pack(number, "sum", n - 1, s, block.mark, _pack_keys(contexts.keys[lo:hi]), _planes(np.concatenate([taken[lo:hi], covered[lo:hi]])), _planes(contexts.count[lo:hi]))
            for s, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])) if lo < hi
        ]
        return pa.Table.from_batches(packs)

    return _with_answers(order, use)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, known: list[Discounts], missing: float):
    def use(number: int, block: Block, about: np.ndarray) -> pa.Table:
        one = block.levels[0]
        likely = probabilities(block, known, missing, order)
        p = likely[0][one.token]
        for level, longer in zip(block.levels[1:], likely[1:]):
            p = np.where(level.token >= 0, longer[level.token], p)
        count = one.count[one.token]
        base = np.log10((count + 1) / (known[0].total + known[0].types + 1))
        summed = lambda x: np.add.reduceat(x, block.first[:-1])  # noqa: E731  each text has a token
        ids = pa.array(about[:, 0], mask=about[:, 1] > 0)
        columns = [ids, pa.array(about[:, 2] == 0), pa.array(np.diff(block.first)), pa.array(summed((count > 0).astype(np.int64))), pa.array(np.full(len(about), known[0].total)), pa.array(summed(base)), pa.array(summed(np.log10(p)))]
        return pa.table(columns, [c.split()[0] for c in SCORES.split(", ")])

    return _with_answers(order, use)


def in_training(key: str = "doc_id", parts: int = 7, held_out: int = 2) -> Column:
    """Whether a document is learned from: not where the CRC-32 of its id as text leaves held_out. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts != held_out


def katz_scores(docs: DataFrame, training: Column | None = None, order: int = 2, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(scores, model). scores has per row of docs: doc_id, held_out, n_tokens, n_known (tokens that training texts hold), train_tokens, base_score
    (add-one unigrams) and score, the log10 probability of the text. model holds the tables: by level and share of the n-gram hashes, `counts` (n-grams
    and their counts) and `weights` (contexts and their backoff weights), packed.

    Tokens are words without ASCII white space (A-Z lower-cased) and one end for each text; a start is the context of the first. An n-gram that training
    texts hold has its Good-Turing discounted share of its context's count; any other has the backoff weight of its context times the
    probability after the context without its first token, and so on to single tokens, where what was taken off counts goes to unknown words.
    A context's weight is what its discounts left, divided by one less the shorter n-grams' probabilities of the words that
    did follow it: so probabilities after each context sum to 1. Where no count after a context is small enough to be discounted, its
    total counts one more. After contexts that no training text holds the shorter context decides.

    Blocks of texts send their distinct n-grams, as 64-bit hashes, to shares of the hash range, where they are counted; so a very frequent n-gram comes
    once from each block. Counts go back to the blocks, one of which owns each n-gram and adds its part to the sums of its context; these go to shares again,
    and the weights go back. n-grams are never dropped: the tables grow with the training texts. docs must give the same rows each time it
    is read, as a table does; a digest tells if it does not.

    Null and empty texts have the end as their only token. Null ids stay null. Repeated rows are learned from and scored each; without
    training texts each token has probability 1 as an unknown word; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(in_training(key) if training is None else training, F.lit(False)).alias("training"), whole_text(text).alias("text"))
    least = partitions(docs.sparkSession)
    shares = max(least, -(-text_bytes(rows) // PER_SHARE))
    dealt = lambda packs: packs.repartitionById(shares, F.col("share"))
    found = staged(dealt(rows.mapInArrow(_grams(order, shares, BLOCK), PACKS)).mapInArrow(_count, PACKS), "ngrams")
    sizes: dict[int, np.ndarray] = {n: np.zeros(DISCOUNTED + 3, np.int64) for n in range(1, order + 1)}
    # A row of eight numbers for each share and level.
    for row in found.where("kind = 'histogram'").select("level", "a").toLocalIterator():
        sizes[row["level"]] += np.frombuffer(row["a"], "<i8")
    known = [Discounts.of(x[: DISCOUNTED + 1].tolist(), int(x[-2]), int(x[-1])) for _, x in sorted(sizes.items())]
    missing = float(sum(sizes[1][r - 1] * r * (1 - known[0].factors[r]) for r in range(1, DISCOUNTED + 1)))
    for n in range(2, order + 1):
        sums = _by_block(rows, found, shares, least).applyInArrow(_sums(order, shares, known, missing, n), PACKS)
        found = found.unionAll(staged(dealt(sums).mapInArrow(_weigh, PACKS), "weights"))
    scores = _by_block(rows, found, shares, least).applyInArrow(_score(order, known, missing), SCORES)
    return scores, found.where("block = -1 AND kind <> 'histogram'").select("kind", "level", "share", F.col("a").alias("keys"), F.col("b").alias("values"))


def _by_block(rows: DataFrame, found: DataFrame, shares: int, least: int):
    """Blocks of texts together with the answers to them."""
    both = rows.mapInArrow(_texts(BLOCK), PACKS).unionAll(found.where("block >= 0"))
    both = both.repartition(shares, "block") if shares > least else both
    return both.groupBy("block")
