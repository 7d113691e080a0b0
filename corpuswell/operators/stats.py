"""Bootstrap intervals, paired bootstrap and the Wilcoxon signed-rank test, per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswell.config import SETTINGS as S
from corpuswell.staging import staged


#: 32-bit numbers that a task draws at a time (even); a group that needs more is dealt to tasks.
DRAWN = 1 << 22


def _means(values: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Means of resamples. Some resamples are drawn at a time from one generator, which gives the same picks as all at once."""
    rng, n = np.random.default_rng(seed), len(values)
    some = max(1, DRAWN // n)
    return np.concatenate([values[rng.integers(0, n, size=(min(some, resamples - at), n))].mean(axis=1) for at in range(0, resamples, some)])


def picks(seed: int, block: int, n: int, drawn: int) -> np.ndarray:
    """What the block-th `drawn` numbers of the generator pick out of n. The generator is advanced to where the block begins; whether a number picks or is thrown
    away, so that all of n are equally likely, depends on that number only."""
    source = np.random.PCG64(seed)
    source.advance(block * (drawn // 2))
    scaled = source.random_raw(drawn // 2).view(np.uint32).astype(np.uint64) * np.uint64(n)
    return (scaled[(scaled & np.uint64(0xFFFFFFFF)) >= (1 << 32) % n] >> np.uint64(32)).astype(np.int64)


def _dealt_means(values: DataFrame, by: list[str], resamples: int, seed: int) -> DataFrame:
    """by, means (array), value (the mean) and n of groups that need many numbers. values: by, _o, _v.

    A group is sorted and packed once; its draws are dealt to tasks in blocks. What blocks of draws pick is counted first, which tells at which place of which
    resample each begins; then the blocks give sums of resamples, which meet by resample.
    """
    keys, drawn = ", ".join(f"`{c}` {t}" for c, t in values.dtypes if c in by), DRAWN

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("_o")["_v"].to_numpy("<f8")
        if len(v) >= 1 << 32:
            raise ValueError("a group has 2**32 values or more")
        return pd.DataFrame([[*pdf.iloc[0][by], len(v), v.mean(), v.tobytes()]], columns=[*by, "n", "value", "packed"])

    def count(frames):
        for pdf in frames:
            pdf["picked"] = [len(picks(seed, b, n, drawn)) for b, n in zip(pdf["block"], pdf["n"])]
            yield pdf

    def add(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                v, n = np.frombuffer(row["packed"], "<f8"), row["n"]
                own = v[picks(seed, row["block"], n, drawn)][: max(0, resamples * n - row["start"])]
                place = (row["start"] + np.arange(len(own))) // n
                first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))[: len(own)]
                if len(own):
                    yield pd.DataFrame({**{c: [row[c]] * len(first) for c in by}, "resample": place[first], "total": np.add.reduceat(own, first)})

    packed = staged(values.groupBy(*by).applyInPandas(pack, f"{keys}, n long, value double, packed binary"), "packed")
    # So many numbers are thrown away on average; a block more is far beyond chance.
    thrown = F.pmod(F.lit(1 << 32), F.col("n")) / (1 << 32)
    last = F.ceil(resamples * F.col("n") / (1 - thrown) / drawn).cast("int")
    blocks = packed.select(*by, "n", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    # Rows of blocks are few bytes and much work: their number of tasks is given, or adaptive execution makes one of them.
    tasks = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), values.sparkSession.sparkContext.defaultParallelism)
    counted = blocks.repartition(tasks, *by, "block").mapInPandas(count, f"{keys}, n long, block int, picked long")
    before = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    started = counted.withColumn("start", F.coalesce(F.sum("picked").over(before), F.lit(0))).where(F.col("start") < resamples * F.col("n"))
    same = [started[c].eqNullSafe(packed[c]) for c in by]
    work = started.join(packed.select(*by, "packed"), same).select(*[started[c] for c in by], "n", "block", "start", "packed") if by else started.crossJoin(packed.select("packed"))
    sums = work.repartition(tasks, *by, "block").mapInPandas(add, f"{keys}, resample long, total double")
    each = sums.groupBy(*by, "resample").agg(F.sum("total").alias("total"))
    totals = each.groupBy(*by).agg(F.collect_list("total").alias("means"))  # a number for each resample
    found = totals.join(packed.select(*by, "n", "value"), [totals[c].eqNullSafe(packed[c]) for c in by]).select(*[totals[c] for c in by], "n", "value", F.transform("means", lambda x: x / F.col("n")).alias("means"))
    return found.withColumn("means", F.when(F.size("means") == resamples, F.col("means")).otherwise(F.raise_error(F.lit("resamples are missing"))))


def _resampled(values: DataFrame, by: list[str], finish, columns: str, resamples: int, seed: int) -> DataFrame:
    """by and what finish(mean, means of resamples or None, n) gives for each group of values (by, _o, _v). Groups that need no more than DRAWN numbers are done whole."""
    ordered = [c for c, _ in values.dtypes if c in by]
    keys = ", ".join(f"`{c}` {t}" for c, t in values.dtypes if c in by)
    names = [*ordered, *[c.split()[0] for c in columns.split(", ")]]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("_o")["_v"].to_numpy(float)
        return pd.DataFrame([[*pdf.iloc[0][ordered], *finish(v.mean(), _means(v, resamples, seed) if len(v) > 1 else None, len(v))]], columns=names)

    def dealt(frames):
        for pdf in frames:
            yield pd.DataFrame([[*[r[c] for c in ordered], *finish(r["value"], np.asarray(r["means"]), r["n"])] for r in pdf.to_dict("records")], columns=names)

    values = staged(values, "values")  # read some times
    large = values.groupBy(*ordered).agg(F.count("*").alias("_n")).where(F.col("_n") * resamples > DRAWN).select(*[F.col(c).alias(f"_{c}") for c in ordered])
    if large.isEmpty():
        return values.groupBy(*ordered).applyInPandas(whole, f"{keys}, {columns}")
    large = staged(large, "large")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ordered]
    few = values.join(F.broadcast(large) if large.count() < 10_000 else large, same, "left_anti").groupBy(*ordered).applyInPandas(whole, f"{keys}, {columns}")
    many = _dealt_means(values.join(large, same, "left_semi"), ordered, resamples, seed).mapInPandas(dealt, f"{keys}, {columns}")
    return few.unionByName(many)


def bootstrap_ci(scores: DataFrame, by: list[str], value: str = "value", order: str = "example_id", resamples: int = S.resamples, seed: int = S.seed, alpha: float = 0.05) -> DataFrame:
    """by, mean, lo, hi: percentile bootstrap of the mean. A group is the examples of one configuration and metric."""

    def finish(mean, means, n):
        return (mean, *np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])) if n > 1 else (mean, mean, mean)

    values = scores.select(*by, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))
    return _resampled(values, by, finish, "mean double, lo double, hi double", resamples, seed)


def paired_bootstrap(pairs: DataFrame, by: list[str], order: str = "example_id", resamples: int = S.resamples, seed: int = S.seed, alpha: float = 0.05) -> DataFrame:
    """pairs (by, example_id, a, b): by, mean_diff, lo, hi, p_value (two-sided, of shifts as large as the one seen), n."""

    def finish(seen, means, n):
        means = np.full(1, seen) if means is None else means
        lo, hi = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
        return seen, lo, hi, float((np.abs(means - seen) >= abs(seen)).mean()), n

    values = pairs.select(*by, F.col(order).alias("_o"), (F.col("a") - F.col("b")).cast("double").alias("_v"))
    return _resampled(values, by, finish, "mean_diff double, lo double, hi double, p_value double, n int", resamples, seed)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution at z <= 0."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))

    return tail(z)


def wilcoxon(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, statistic, z: the signed-rank statistic over non-zero differences and its tie-corrected normal deviate.

    Equal sizes share their mean rank. Groups without a difference have statistic 0 and z null (p is 1).
    """
    wide = lambda c: F.col(c).cast("double")  # noqa: E731  third powers of counts are beyond a long
    d = pairs.withColumn("d", F.col("a") - F.col("b")).where("abs(d) > 1e-12").withColumn("m", F.round(F.abs("d"), 12))
    tied = d.groupBy(*by, "m").agg(F.count("*").alias("t"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*by).orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = tied.withColumn("r", before + (F.col("t") + 1) / 2)
    sums = rank.groupBy(*by).agg(F.sum(F.col("r") * F.col("up")).alias("plus"), F.sum(F.col("r") * F.col("t")).alias("all"), F.sum(wide("t")).alias("n"), F.sum(wide("t") * wide("t") * wide("t") - wide("t")).alias("ties"))
    statistic = F.least("plus", F.col("all") - F.col("plus"))
    spread = F.sqrt((F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) - F.col("ties") / 2) / 24)
    groups = pairs.select(*by).distinct()
    found = sums.select(*by, statistic.alias("statistic"), ((statistic - F.col("n") * (F.col("n") + 1) / 4) / spread).alias("z"))
    return groups.join(found, by, "left").select(*by, F.coalesce("statistic", F.lit(0.0)).alias("statistic"), "z")


def wilcoxon_p(pairs: DataFrame, by: list[str]) -> DataFrame:
    return wilcoxon(pairs, by).withColumn("p_value", F.coalesce(normal_tail(F.coalesce("z", F.lit(0.0))), F.lit(1.0)))
