"""Mixing to target weights: domain posteriors from a labelled table, document rates by projected gradient."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswell.llm._shared import staged, whole_text
from corpuswell.llm.license_scan import Words

#: Slots that words are hashed to, words that a classifier keeps at most, and its other features.
SLOT_BITS, KEPT, DENSE = 18, 1024, 4
#: Share of the words chosen for a domain that may be there by chance.
FALSE_WORDS = 0.2
#: Weight of the pull of weights to 0, against the sum of errors over the labelled documents.
PRIOR = 1.0
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot) of each distinct word slot of each text, words of each text, and its DENSE numbers."""
    words = Words(texts)
    n = np.diff(words.texts)
    owner = np.repeat(np.arange(len(texts)), n)
    slot = (words.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    pairs = np.unique((owner << SLOT_BITS) | slot)
    again = np.zeros(len(owner), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    symbols = np.array([int(_SYMBOLS[np.frombuffer(t, np.uint8)].sum()) for t in texts])
    letters = np.bincount(owner, words.ends - words.starts, minlength=len(texts))
    some = np.maximum(n, 1)
    dense = np.stack([np.log1p(n), letters / some, np.minimum(symbols / some, 10), np.bincount(owner, again, minlength=len(texts)) / some], axis=1)
    return pairs >> SLOT_BITS, pairs & ((1 << SLOT_BITS) - 1), n, dense


@dataclass
class Classifier:
    """A softmax regression over the presence of chosen words and a few numbers."""

    index: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(words, posteriors) of texts."""
        owner, slot, n, dense = _features(texts)
        kept = self.index[slot]
        owner, kept = owner[kept >= 0], kept[kept >= 0]
        logits = (dense - self.centre) / self.scale @ self.weights[-DENSE:] + self.bias
        for k in range(logits.shape[1]):
            logits[:, k] += np.bincount(owner, self.weights[kept, k], minlength=len(texts))
        return n, _softmax(logits)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _slot_counts(domains: int):
    """Of a task's rows (domain, text): in how many documents of each domain each word slot stands."""

    def run(batches):
        seen = np.zeros((domains, 1 << SLOT_BITS), np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                owner, slot, _, _ = _features([t.as_py() for t in part.column(1).cast(pa.binary())])
                np.add.at(seen, (part.column(0).to_numpy()[owner], slot), 1)
        domain, slot = np.nonzero(seen)
        yield pa.record_batch([pa.array(slot, pa.int32()), pa.array(domain, pa.int32()), pa.array(seen[domain, slot])], ["slot", "domain", "n"])

    return run


def _sample_features(index: np.ndarray):
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                owner, slot, _, dense = _features([t.as_py() for t in part.column(1).cast(pa.binary())])
                owner, kept = owner[index[slot] >= 0], index[slot][index[slot] >= 0]
                cuts = np.searchsorted(owner, np.arange(len(part) + 1))
                words = [kept[a:b].astype("<u2").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.record_batch([part.column(0), pa.array(words, pa.binary()), pa.array(dense.tolist(), pa.list_(pa.float64()))], ["domain", "words", "dense"])

    return run


def _chance(total: np.ndarray, seen: np.ndarray, rows: int, own: int) -> tuple[np.ndarray, float]:
    """(log p of each word, the log p up to which words are chosen) for a domain with `own` of `rows` documents.

    p is the hypergeometric chance that of a word's documents so many or more are the domain's. By the same law, counts of
    documents being what they are, so many words would have a p up to a bound by chance; the bound
    is the largest by which they are no more than FALSE_WORDS of the words that have it.
    """
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, rows + 1)))])
    p, steps, weights = np.zeros(len(total)), [], []
    by_total = np.argsort(total, kind="stable")
    counts, starts = np.unique(total[by_total], return_index=True)
    for t, words in zip(counts, np.split(by_total, starts[1:])):
        s = np.arange(max(0, t + own - rows), min(t, own) + 1)
        pmf = logs[own] - logs[s] - logs[own - s] + logs[rows - own] - logs[t - s] - logs[rows - own - t + s] - logs[rows] + logs[t] + logs[rows - t]
        tail = np.minimum(np.logaddexp.accumulate(pmf[::-1])[::-1], 0)
        p[words] = tail[seen[words] - s[0]]
        rare = (tail < -2) & (tail > -40)
        steps.append(tail[rare])
        weights.append(len(words) * np.exp(pmf[rare]))
    steps, weights = np.concatenate(steps), np.concatenate(weights)
    order = np.argsort(steps, kind="stable")
    by_chance = np.concatenate([[0.0], np.cumsum(weights[order])])
    found = np.sort(p[p < -2])
    so_far = np.searchsorted(found, found, side="right")
    good = by_chance[np.searchsorted(steps[order], found, side="right")] <= FALSE_WORDS * so_far
    return p, found[good].max() if good.any() else -np.inf


def train(sample: DataFrame, domains: int, row_steps: int = 4_000_000, ridge: float = 1e-4) -> Classifier:
    """Fits a Classifier on a bounded sample (domain int, text). Words count that stand in more documents of a domain
    than chance explains for the numbers of labels and of words there are, at most KEPT. Domains without a row get a low prior; without rows all are alike. A fit takes row_steps / rows steps, from 200
    to 3000. The driver gets a count for each slot and domain, then at most KEPT numbers of two bytes for each row of the sample, whatever
    the length of its text."""
    counted = sample.groupBy("domain").count().collect()  # a row for each domain
    per_domain = np.zeros(domains, np.int64)
    for r in counted:
        per_domain[r["domain"]] = r["count"]
    n, index, empty = int(per_domain.sum()), np.full(1 << SLOT_BITS, -1, np.int32), np.zeros((DENSE, domains))
    if not n:
        return Classifier(index, np.zeros(DENSE), np.ones(DENSE), empty, np.zeros(domains))
    slots = sample.mapInArrow(_slot_counts(domains), "slot int, domain int, n long").groupBy("slot", "domain").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((domains, 1 << SLOT_BITS), np.int64)
    seen[slots["domain"].to_numpy(), slots["slot"].to_numpy()] = slots["n"].to_numpy()
    share = seen.sum(axis=0) / n
    words = np.flatnonzero(share)
    rank = np.zeros(len(words))
    for k in np.flatnonzero(per_domain):
        log_p, bound = _chance(seen[:, words].sum(axis=0), seen[k, words], n, int(per_domain[k]))
        rank = np.minimum(rank, np.where(log_p <= bound, log_p, 0))
    best = np.argsort(rank, kind="stable")[:KEPT]
    best = np.sort(words[best[rank[best] < 0]])
    index[best] = np.arange(len(best))
    rows = sample.mapInArrow(_sample_features(index), "domain int, words binary, dense array<double>").collect()  # bounded, as above
    y = np.array([r["domain"] for r in rows])
    held = [np.frombuffer(r["words"], "<u2").astype(np.int64) for r in rows]
    owner, word = np.repeat(np.arange(n), [len(w) for w in held]), np.concatenate(held)
    ridge = max(ridge, PRIOR / len(rows))
    dense = np.array([r["dense"] for r in rows])
    centre, scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-6) / 4
    x = np.zeros((len(rows), len(best) + DENSE), np.float32)
    lift = np.minimum(1 / np.sqrt(np.maximum(share * (1 - share), 1e-9)), 10)[best].astype(np.float32)  # rare words learn as fast
    x[owner, word] = lift[word]
    x[:, len(best) :] = (dense - centre) / scale
    hot = np.eye(domains, dtype=np.float32)[y]
    w, b = np.zeros((x.shape[1], domains), np.float32), np.log((per_domain + 0.5) / (len(rows) + 0.5 * domains)).astype(np.float32)
    # Accelerated gradient descent; the step follows from the largest curvature, found by power iteration.
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.5 * float(v @ (x.T @ (x @ v))) / len(rows) + ridge + 0.5)
    aw, ab = w, b
    for t in range(1, min(3000, max(200, row_steps // len(rows))) + 1):
        error = (_softmax(x @ aw + ab) - hot) / len(rows)
        nw, nb = aw - step * (x.T @ error + ridge * aw), ab - step * error.sum(axis=0)
        aw, ab = nw + (t - 1) / (t + 2) * (nw - w), nb + (t - 1) / (t + 2) * (nb - b)
        w, b = nw, nb
    w[: len(best)] *= lift[:, None]
    return Classifier(index, centre, scale, w.astype(float), b.astype(float))


def _score(model: Classifier):
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                n, p = model.posteriors([t.as_py() for t in part.column(1).cast(pa.binary())])
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "posteriors"])

    return run


def domain_posteriors(docs: DataFrame, labelled: DataFrame, domains: int, sample_rows: int = 20_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens (words), posteriors of each row of docs; labelled: doc_id, domain (0 to domains - 1).

    The classifier is fitted on at most sample_rows labelled documents, those with the least hash of doc_id: a bound on
    training only. All texts are then read once and scored.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("int").alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL").distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "domain").limit(sample_rows)
    # At most sample_rows rows: of documents that repeat a doc_id the least text stands for all.
    sample = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text")).select("domain", "text")
    sample = staged(sample, "sample")
    return rows.mapInArrow(_score(train(sample, domains)), "doc_id long, n_tokens long, posteriors array<double>")


STATE = "doc_id long, n_tokens long, posteriors array<double>, rate double, ahead double"


@dataclass
class _Problem:
    """Numbers that all steps share: tokens in all, what an error in a domain weighs, domains' tokens, the pull to 1 and the cap."""

    total: float
    weights: np.ndarray
    have: np.ndarray
    pull: float
    most: float


def _step(problem: _Problem, n: np.ndarray, p: np.ndarray, rate: np.ndarray, ahead: np.ndarray, history: list) -> tuple:
    """(rate, ahead, sums of the last step) after the steps of a history of (errors per domain, momentum).

    A document's step is the gradient over its share of the curvature, a bound of the whole by its diagonal. The sums tell
    whether the momentum leads uphill, and how far the documents' tokens moved.
    """
    curve = p @ (problem.weights * problem.have) / problem.total + problem.pull
    uphill = moved = 0.0
    for errors, momentum in history:
        new = np.clip(ahead - (p @ (problem.weights * errors) + problem.pull * (ahead - 1)) / curve, 0, problem.most)
        uphill, moved = float((n * curve * (ahead - new)) @ (new - rate)), float(n @ (new - ahead) ** 2)
        rate, ahead = new, new + momentum * (new - rate)
    return rate, ahead, uphill, moved


def _columns(batch) -> tuple[np.ndarray, ...]:
    n = batch.column(1).to_numpy().astype(float)
    p = batch.column(2).flatten().to_numpy().reshape(len(n), -1) if len(n) else np.zeros((0, 1))
    return n, p, batch.column(3).to_numpy(), batch.column(4).to_numpy()


def _sums(problem: _Problem, history: list):
    def run(batches):
        for batch in batches:
            if len(batch):
                n, p, rate, ahead = _columns(batch)
                rate, ahead, *last = _step(problem, n, p, rate, ahead, history)
                sums = [*(n * ahead) @ p, *(n * rate) @ p, *last]
                yield pa.record_batch([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums, pa.float64())], ["k", "v"])

    return run


def _advance(problem: _Problem, history: list):
    def run(batches):
        for batch in batches:
            if len(batch):
                rate, ahead, _, _ = _step(problem, *_columns(batch), history)
                yield pa.record_batch([*batch.columns[:3], pa.array(rate), pa.array(ahead)], batch.schema.names)

    return run


def mixing_rates(
    scored: DataFrame, targets: list[float], keep: int | None = None, most: float = float("inf"), weights: list[float] | None = None, pull: float = 1e-4, steps: int = 400, close: float = 1e-4, stage: int = 25
) -> DataFrame:
    """scored (doc_id, n_tokens, posteriors) with rate for each document, and for all of them converged and target_gap.

    Minimises the squared distances of expected domain tokens, the sum of n_tokens * posterior * rate, from their targets, as shares
    of all tokens and each times the weight of its domain, with a small pull of rates towards 1; rates stay between 0 and `most`.
    Expected totals aim at the tokens in docs by the normed targets; with keep, the total is such that domain `keep` is to have as
    many tokens as it has. An aim above what `most` allows is lowered to that.

    Projected gradient with momentum, which starts anew where it leads uphill. Each step is one job over staged numbers that gives
    some sums; the driver holds no more than these. Rates follow from the sums, and every `stage` steps they are staged, so that no
    step repeats more than that many. converged tells whether a step moved rates by less than `close`, as the
    root of the mean square over tokens, before `steps` were made. target_gap is the largest distance of a domain's expected tokens from
    its aim as a share of all tokens: 0 where rates can meet the targets, more where posteriors or bounds forbid it.
    """
    one = F.lit(1.0)
    state, k = staged(scored.select("doc_id", "n_tokens", "posteriors", one.alias("rate"), one.alias("ahead")), "scored"), len(targets)
    goal = np.array(targets, float) / sum(targets)
    problem = _Problem(1.0, np.ones(k) if weights is None else np.array(weights, float), np.zeros(k), pull, most)

    def sums(history):
        found = state.mapInArrow(_sums(problem, history), "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
        out = np.zeros(2 * k + 2)
        for row in found.collect():  # 2 * k + 2 numbers
            out[row["k"]] = row["v"]
        return out[:k], out[k : 2 * k], out[2 * k], out[2 * k + 1]

    have = sums([])[0]
    total = have.sum()
    out = lambda converged, gap: state.select("doc_id", "n_tokens", "posteriors", "rate", F.lit(converged).alias("converged"), F.lit(float(gap)).alias("target_gap"))
    if not total:
        return out(True, 0)
    aim = goal * (have[keep] / goal[keep] if keep is not None else total)
    aim = np.minimum(aim, most * have) if np.isfinite(most) else aim
    problem = _Problem(total, problem.weights, have, pull, most)
    history, ahead, expected, momentum, converged = [], have, have, 0, False
    for _ in range(steps):
        history.append(((ahead - aim) / total, momentum / (momentum + 3)))
        ahead, expected, uphill, moved = sums(history)
        momentum = 0 if uphill > 0 else momentum + 1
        converged = bool(np.sqrt(moved / total) < close)
        if converged or len(history) == stage:
            state, history = staged(state.mapInArrow(_advance(problem, history), STATE), "rates"), []
        if converged:
            break
    if history:
        state = staged(state.mapInArrow(_advance(problem, history), STATE), "rates")
    return out(converged, np.abs(expected - aim).max() / total)


def mix(docs: DataFrame, labelled: DataFrame, targets: list[float], seed: int = 42, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate, converged, target_gap and copies of each row of docs: how often it is to be taken.

    copies is rate rounded up or down by a hash of doc_id, so that its expectation is the rate. Null and empty texts have no tokens and
    the prior's posteriors; null keys take part; repeated rows get the same figures each; an empty table gives no
    rows, an empty labelled table equal posteriors; other columns are not read.
    """
    fitted = mixing_rates(domain_posteriors(docs, labelled, len(targets), key=key, text=text), targets, **options)
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return fitted.withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def label_domains(labels: DataFrame) -> Column:
    """Domains of the labels table: 0 clean, 1 of low quality, 2 toxic; null where nothing is known. A column that is not there tells nothing."""
    quality, toxic = (F.col(c) if c in labels.columns else F.lit(None).cast("int") for c in ("quality", "toxic"))
    return F.when(toxic == 1, 2).when(quality == 0, 1).when((quality == 1) | (toxic == 0), 0)
