"""Near-duplicate documents: HyperMinHash registers, banding, collision-corrected estimates, exact verification."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswell.llm._shared import dealt_join, partitions, staged, whole_text
from corpuswell.llm._textkernels import mix, segment_hashes, space_words

#: Registers of a sketch (a power of two), bits of a register's mantissa, registers of a band.
REGISTERS, MANTISSA, ROWS = 128, 10, 4
BANDS = REGISTERS // ROWS
_SHIFT = 64 - REGISTERS.bit_length() + 1
_U = np.uint64


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its runs of `size` words (A-Z lower-cased, words without
    ASCII white space); of fewer words, the whole sequence as one; of none, nothing."""
    cuts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    data = b" ".join(texts).lower() + b" "
    starts, ends = space_words(data)
    words = segment_hashes(np.frombuffer(data, np.uint8), starts, ends)
    place = np.searchsorted(starts, cuts)
    n = len(words)
    rolled = np.zeros(n, _U)
    for k in range(size):
        rolled[: n - k] = mix(rolled[: n - k] + words[k:] + _U(0x9E3779B97F4A7C15))
    out = []
    for a, b in zip(place[:-1].tolist(), place[1:].tolist()):
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            h = np.full(1, b - a, _U)
            for k in range(a, b):
                h = mix(h + words[k] + _U(0xA24BAED4963EE407))
            out.append(h)
        else:
            out.append(words[:0])
    return out


@lru_cache(1)
def _probes() -> np.ndarray:
    """For each attempt and register the register that an empty one looks at."""
    h = mix(np.arange(1, 8 * REGISTERS * REGISTERS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return (h % _U(REGISTERS)).astype(np.int64).reshape(-1, REGISTERS)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers (sets x REGISTERS, 16 bits) of non-empty sets.

    The top bits of a shingle's hash choose the register. Of the least remainder there it holds the count of
    leading zeros and the MANTISSA bits that follow the first one. Registers without a shingle take over another's,
    by the same sequence of attempts in every set, so that they agree as often as the sets do.
    """
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    filled = np.zeros((len(sets), REGISTERS), bool)
    for k, s in enumerate(sets):
        where = (s >> _U(_SHIFT)).astype(np.int64)
        first = np.append(True, where[1:] != where[:-1])  # s is sorted: the first of each register is its least
        filled[k, where[first]] = True
        least = (s[first] << _U(64 - _SHIFT)) | _U(1)
        # log2 is off by one next to powers of two; the shifted value tells.
        zeros = 63 - np.floor(np.log2(least.astype(np.float64))).astype(np.int64)
        zeros = np.maximum(zeros, 0)
        top = (least << zeros.astype(_U)) >> _U(63) == 0
        zeros += top
        bits = ((least << zeros.astype(_U)) << _U(1)) >> _U(64 - MANTISSA)
        out[k, where[first]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | bits.astype(np.uint16)
    todo = np.argwhere(~filled)
    for probe in _probes():
        if not len(todo):
            break
        to = probe[todo[:, 1]]
        hit = filled[todo[:, 0], to]
        out[todo[hit, 0], todo[hit, 1]] = out[todo[hit, 0], to[hit]]
        todo = todo[~hit]
    for k, r in todo.tolist():  # very few: the next filled one
        steps = (np.flatnonzero(filled[k]) - r) % REGISTERS
        out[k, r] = out[k, (r + steps.min()) % REGISTERS]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """sets x BANDS: a 64-bit key of each ROWS registers, different for different bands."""
    packed = np.ascontiguousarray(regs).view(_U).reshape(len(regs), BANDS, -1)[:, :, 0] if ROWS == 4 else None
    return mix(packed ^ (np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of sketches: the share of equal registers less what chance collisions add."""
    share = (a == b).mean(axis=1)
    level = 2.0 ** -np.arange(50)
    at = lambda n: np.exp(-np.outer(n / REGISTERS, level / 2)) - np.exp(-np.outer(n / REGISTERS, level))  # noqa: E731  P(leading zeros = level)
    chance = (at(na) * at(nb)).sum(axis=1) / (1 << MANTISSA)
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _sketch(size: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                sets = shingle_sets([t.as_py() for t in part.column(1).cast(pa.binary())], size)
                full = [s for s in sets if len(s)]
                regs = registers(full)
                keys, rows = iter(band_keys(regs).tolist()), iter(regs)
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["node", "n", "digest", "bands", "regs"],
                )

    return run


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """rows: node, text. Gives node, n (size of the shingle set), digest of the set, bands and regs (null for an empty set)."""
    return rows.mapInArrow(_sketch(size), "node long, n long, digest binary, bands array<long>, regs binary")


def _plausible(cut: float):
    def run(batches):
        for batch in batches:
            if len(batch):
                regs = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5)]
                n = [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3)]
                yield batch.filter(pa.array(estimate(*regs, *n) >= cut)).select([0, 1])

    return run


def plausible(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose estimate is not six deviations below it."""
    num, den = similarity
    one = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    j = num / den
    cut = j - 6 * (j * (1 - j) / REGISTERS) ** 0.5
    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_plausible(cut), "a long, b long")


def _compare(size: int, num: int, den: int, detail: bool):
    """linked, and with detail also what the star step needs: see compared."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 128):
                part = batch.slice(lo, 128)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                texts: dict = {}
                for column, ids in ((2, a), (3, b)):
                    for k, i in enumerate(ids):
                        texts.setdefault((column, i), part.column(column)[k].as_py().encode())
                sets = dict(zip(texts, shingle_sets(list(texts.values()), size)))
                linked, shared, enough, extra = [], [], [], []
                for i, j in zip(a, b):
                    x, y = sets[2, i], sets[3, j]
                    held = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                    both = int(held.sum())
                    linked.append(den * both >= num * (len(x) + len(y) - both))
                    shared.append(both)
                    if detail:
                        # z with |y & z| >= num/den |y| shares more than these with y outside x if |y & z & x| is not enough.
                        own = y[~held]
                        enough.append(max(0, len(own) + 1 - max(1, -(-num * len(y) // den) - both)))
                        extra.append(own.view(np.int64))
                if detail:
                    n = [pa.array([len(sets[c, i]) for i in ids], pa.int64()) for c, ids in ((2, a), (3, b))]
                    yield pa.record_batch([part.column(0), part.column(1), *n, pa.array(shared, pa.int64()), pa.array(linked), pa.array(enough, pa.int64()), pa.array(extra, pa.list_(pa.int64()))], ["a", "b", "na", "nb", "shared", "linked", "enough", "extra"])
                else:
                    yield part.filter(pa.array(linked, pa.bool_())).select([0, 1])

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "ta", "tb")


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity; texts: node, text."""
    return _with_texts(pairs, texts).mapInArrow(_compare(size, *similarity, False), "a long, b long")


def compared(pairs: DataFrame, texts: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """Each pair with the sizes of both full sets, what they share, whether they are linked, and extra: the shingles of
    b that a lacks. A third set linked with b holds one of any `enough` of them, unless both lie close to a."""
    return _with_texts(pairs, texts).mapInArrow(_compare(size, *similarity, True), "a long, b long, na long, nb long, shared long, linked boolean, enough long, extra array<long>")


#: Distinct links whose components are found in one task; more go by rounds of joins.
SETTLED_AT_ONCE = 1 << 20


def _settle(table: pa.Table) -> pa.Table:
    """u, v of links as u, the smallest node that it reaches, of all nodes."""
    nodes, at = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
    a, b = at[: len(table)], at[len(table) :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(label, label[end], low)
        while (label[label] != label).any():
            label = label[label]
    return pa.table([pa.array(nodes), pa.array(nodes[label])], ["u", "v"])


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label: the smallest node that links (a, b) reach from it.

    Up to SETTLED_AT_ONCE links, by count, are settled in one task. Of more, large-star and small-star steps alternate until no link changes; each is aggregates and joins on narrow rows,
    written to the shared folder, and their number grows as the logarithm of the longest chain. A node with
    very many links is pre-aggregated, and its links are dealt to several tasks.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = staged(edges, "edges")
    before, few = None, edges.count() <= SETTLED_AT_ONCE
    if few:
        edges = edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_settle, "u long, v long")
    for _ in range(0 if few else most_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = 2 * edges.count()
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c")), "low")
        large = dealt_join(both.where("v > u"), low.select("u", "m"), ["u"], low, total)
        large = staged(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = staged(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), "small")
        kept = dealt_join(large, small.select("u", "m"), ["u"], small, total)
        edges = staged(kept.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(kept.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        if not few:
            raise RuntimeError("links did not settle")
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("label"))


#: Where the stand-ins of null ids begin.
STAND_INS = 1 << 62
#: A group is compared pair by pair if that makes no more than this many pairs a member.
DIRECT = 16
#: A group of up to this many shingles in all its sets is joined in one task.
IN_TASK = 1 << 21


def _join_group(size: int, num: int, den: int):
    """Links of a bounded group: an exact join by prefix and length filters over full sets; pairs that are connected
    already (by label or by the links found here) are not looked at."""

    def run(table: pa.Table) -> pa.Table:
        nodes, labels = table["node"].to_pylist(), table["label"].to_pylist()
        sets = shingle_sets([t.encode() for t in table["text"].to_pylist()], size)
        root: dict = {}

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        tokens, count = np.unique(np.concatenate(sets), return_counts=True)
        rarity = np.argsort(np.lexsort((tokens, count)), kind="stable")
        index: dict = {}
        a, b = [], []
        for k in sorted(range(len(sets)), key=lambda k: len(sets[k])):
            own, n = sets[k], len(sets[k])
            prefix = np.sort(rarity[np.searchsorted(tokens, own)])[: n - -(-num * n // den) + 1].tolist()
            near = {j for t in prefix for j in index.get(t, ())}
            for t in prefix:
                index.setdefault(t, []).append(k)
            for j in sorted(near):
                x, y = find(labels[j]), find(labels[k])
                if x != y and den * len(sets[j]) >= num * n:
                    both = len(np.intersect1d(own, sets[j], assume_unique=True))
                    if den * both >= num * (n + len(sets[j]) - both):
                        root[x] = y
                        a.append(nodes[j])
                        b.append(nodes[k])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _meet(table: pa.Table) -> pa.Table:
    """(key, node) of one leader's company: see _regroup. Pairs that are both linked with the leader are connected already, so a shingle counts only if
    one of those that hold it is not."""
    linked, extra = table["linked"].to_numpy(), table["extra"].combine_chunks()
    sizes = np.diff(extra.offsets.to_numpy())
    owner, s = np.repeat(np.arange(len(sizes)), sizes), extra.flatten().to_numpy()
    nothing = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], ["key", "node"])
    if linked.all() or not len(s):
        return nothing
    _, code, count = np.unique(s, return_inverse=True, return_counts=True)
    order = np.lexsort((s, count[code], owner))
    first = np.append(0, np.cumsum(sizes))[:-1]
    rank = np.arange(len(s)) - np.repeat(first, sizes)
    order = order[(rank < np.repeat(table["enough"].to_numpy(), sizes)) & (count[code[order]] > 1)]
    held = np.bincount(code[order], minlength=len(count))
    free = np.bincount(code[order], weights=~linked[owner[order]], minlength=len(count))
    order = order[(held[code[order]] > 1) & (free[code[order]] > 0)]
    key = mix(s[order].view(_U) + mix(table["a"].to_numpy()[:1].view(_U)))
    return pa.table([pa.array(key.view(np.int64)), table["b"].combine_chunks().take(pa.array(owner[order]))], ["key", "node"])


def _regroup(seen: DataFrame) -> DataFrame:
    """(key, node): nodes compared with leader a meet by a shingle that a lacks. Of each node's such shingles the `enough`
    rarest among the leader's company will do: an exact prefix filter, ordered by frequency. Company with up to IN_TASK such shingles meets
    in one task; of larger company each shingle is a row."""
    sizes = staged(seen.groupBy("a").agg(F.sum(F.size("extra").cast("long")).alias("n")), "company-sizes")
    large = sizes.where(F.col("n") > IN_TASK).select("a")
    columns = seen.select("a", "b", "linked", "enough", "extra")
    if large.isEmpty():
        return columns.groupBy("a").applyInArrow(_meet, "key long, node long")
    met = columns.join(large, "a", "left_anti").groupBy("a").applyInArrow(_meet, "key long, node long")
    extra = columns.join(large, "a", "left_semi").repartition("a", "b").select("a", "b", "enough", F.explode("extra").alias("s"))
    counts = staged(extra.groupBy("a", "s").agg(F.count("*").alias("c")).where("c > 1"), "company")
    total = counts.agg(F.sum("c")).first()[0] or 0
    counted = dealt_join(extra, counts.select("a", "s", F.col("c").alias("f")), ["a", "s"], counts, total, "left")
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.coalesce("f", F.lit(1)), "s"))
    rarest = counted.withColumn("rank", rank).where("rank <= enough AND f > 1")
    return met.unionAll(rarest.select(F.xxhash64("a", "s").alias("key"), F.col("b").alias("node")))


def similar_links(sets: DataFrame, texts: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """node, label of sets (node, bands, n, regs): nodes with one label are joined by verified links.

    Groups start as the band buckets; those whose nodes are connected already are left. Where pairs of different
    components are few for the group's size, they are estimated and verified. In other groups each node is compared with
    a leader, the node with most company; a pair of the rest can be linked only if (1) both hold a shingle that the leader
    lacks, so that they meet again by such a shingle, or (2) both share so much with the leader that
    |y| + |z| <= (1 + den/num) min(shared). What meets again is mostly small enough to be joined in one
    task; else it goes by another leader. So the work follows the members of a group, not its pairs. Rows of a large group
    are dealt to several tasks wherever they are joined with what is known of the group.
    """
    num, den = similarity
    groups = staged(sets.select(F.explode("bands").alias("key"), "node"), "bands")
    labels = sets.select("node", F.col("node").alias("label"))
    links, n_links, again = None, 0, False

    def joined(*found: DataFrame):
        nonlocal links, labels, n_links
        for more in found:
            more = staged(more, "links")
            links = more if links is None else links.unionAll(more)
        if (n := links.count()) > n_links:
            n_links, labels = n, staged(components(sets.select("node"), links), "labels")

    while True:
        labelled = staged(groups.join(labels, "node").join(sets.select("node", "n"), "node"), "labelled")
        total = labelled.count()
        parts = labelled.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("n")).groupBy("key")
        spread = parts.agg(F.sum("m").alias("c"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.sum("n").alias("n"), F.count("*").alias("k"), F.max_by("label", F.struct("m", "label")).alias("main"))
        way = F.when(F.col("c") * F.col("c") - F.col("squares") <= 2 * DIRECT * F.col("c"), "pairs").when(F.lit(again) & (F.col("n") <= IN_TASK), "task").otherwise("leader")
        spread = staged(spread.where("k > 1").select("key", "c", "main", way.alias("way")), "spread")
        members = staged(dealt_join(labelled.drop("n"), spread, ["key"], spread, total), "members")
        # Pairs of different labels have a member outside the group's largest label; few are, so a large label is not paired with itself.
        few = members.where("way = 'pairs'").select("key", "node", "label", "main")
        other = few.where("label <> main").select("key", F.col("node").alias("b"), F.col("label").alias("lb"))
        met = dealt_join(few, other, ["key"], spread.where("way = 'pairs'"), total)
        direct = met.where("label <> lb AND (label = main OR node < b)").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
        found = [verified(plausible(direct.distinct(), sets, similarity), texts, size, similarity)]
        if again:
            bounded = members.where("way = 'task'").select("key", "node", "label").join(texts, "node")
            found.append(bounded.groupBy("key").applyInArrow(_join_group(size, num, den), "a long, b long"))
        many = members.where("way = 'leader'")
        company = many.groupBy("node").agg(F.sum("c").alias("company"))
        ranked = many.join(company, "node").select("key", "node", F.struct("company", (-F.col("node")).alias("k")).alias("r"))
        leaders = ranked.groupBy("key").agg(F.max("r").alias("r")).select("key", (-F.col("r.k")).alias("a"))
        star = dealt_join(many.select("key", "node"), leaders, ["key"], spread.where("way = 'leader'"), total).where("node <> a").select("a", F.col("node").alias("b")).distinct()
        seen = staged(compared(star, texts, size, similarity), "stars")
        joined(*found, seen.where("linked").select("a", "b"))
        if seen.isEmpty():
            return labels
        close = seen.where(den * F.col("shared") >= num * F.col("nb")).join(labels.withColumnRenamed("node", "b"), "b").select("a", "b", "nb", "shared", "linked", "label")
        partner = close.select("a", F.col("b").alias("c"), F.col("nb").alias("nc"), F.col("shared").alias("sc"), F.col("label").alias("lc"))
        pairs = close.where("NOT linked").join(partner, "a").where((F.col("label") != F.col("lc")) & (num * (F.col("nb") + F.col("nc")) <= (num + den) * F.least("shared", "sc")))
        pairs = pairs.select(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b")).distinct()
        joined(verified(plausible(pairs, sets, similarity), texts, size, similarity))
        groups, again = staged(_regroup(seen), "groups"), True


def document_node(key: str = "doc_id", text: str = "text") -> Column:
    """What identifies a document: its doc_id, or a stand-in from the text, at STAND_INS or above, where that is null."""
    return F.coalesce(F.col(key).cast("long"), F.lit(STAND_INS) + F.shiftrightunsigned(F.xxhash64(whole_text(text)), 2))


def numbered(rows: DataFrame) -> DataFrame:
    """id, number of the distinct ids of rows (id), which are not null: numbers below STAND_INS in the order of the ids."""
    ids = rows.select("id").distinct()
    # Partitions of a range come in order, and so do the rows that are sorted in each.
    return staged(ids.repartitionByRange(partitions(rows.sparkSession), "id").sortWithinPartitions("id").withColumn("number", F.monotonically_increasing_id()), "numbers")


def near_duplicates(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (80, 100), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles (size of its shingle set), component_id, kept and node (document_node, or a number in the order of the doc_ids).

    Two documents are linked if their sets of `size`-word shingles reach the Jaccard similarity; component_id is the smallest
    doc_id that links reach, and kept marks the rows with doc_id = component_id. Equal sets are one node from the
    start, so exact copies are never compared. Banding finds a pair at 0.85 but for 1e-10, at 0.80 but for 1e-7.

    Null and empty texts have no shingles and no links. Rows of equal doc_id count as one document. Null doc_ids
    take part and come last: their component_id is null if only such are linked, and kept is false then unless
    the row is alone. doc_ids may be any long: where some are at STAND_INS or above and others null, nodes are
    numbers in the order of the ids. Repeated rows give a row each; an empty table gives none; other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), document_node(key, text).alias("node"), whole_text(text).alias("text"))
    about = rows.agg(F.max("id").alias("most"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    numbers = None
    if about["nulls"] and (about["most"] or 0) >= STAND_INS:
        numbers = numbered(rows.where("id IS NOT NULL"))
        rows = rows.join(numbers, "id", "left").select("id", F.coalesce("number", "node").alias("node"), "text")
    rows = rows.drop("id")
    every = staged(sketches(rows, size), "sketches")
    sets = every.where("n > 0").groupBy("digest").agg(F.min("node").alias("own"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("regs").alias("regs"))
    sets = staged(sets.withColumnRenamed("own", "node"), "sets")
    crowded = staged(sets.select("node", F.explode("bands").alias("key")), "keys")
    shared = crowded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    busy = staged(crowded.join(shared, "key").select("node").distinct(), "busy")
    texts = staged(rows.join(busy, "node", "left_semi"), "texts")
    labels = similar_links(sets.join(busy, "node", "left_semi"), texts, size, similarity)
    by_set = sets.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    marked = every.select("node", "n", "digest").join(by_set, "digest", "left")
    component = F.coalesce("label", "node")
    kept = marked.select("node", F.col("n").alias("n_shingles"), component.alias("component"), (F.col("node") == component).alias("kept"))
    if numbers is not None:
        named = lambda c: numbers.select(F.col("number").alias(c), F.col("id").alias(f"{c}_id"))
        both = kept.join(named("node"), "node", "left").join(named("component"), "component", "left")
        return both.select(F.col("node_id").alias("doc_id"), "n_shingles", F.col("component_id"), "kept", "node")
    real = lambda c: F.when(F.col(c) < STAND_INS, F.col(c)) if about["nulls"] else F.col(c)
    return kept.select(real("node").alias("doc_id"), "n_shingles", real("component").alias("component_id"), "kept", "node")
