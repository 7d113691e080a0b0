import numpy as np
from pyspark.sql import functions as F

from corpuswell.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every=20, k=5):
    """Of each anchor row its first positives and of each the negatives within the limits, one pair after the other."""
    ints = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v in rows if None not in (i, label) and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    out = []
    for own, (i, label, a) in enumerate(ints):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j, other) for place, (j, other, b) in enumerate(ints) if place != own)
        for place, (s, p, _) in enumerate([x for x in scored if x[2] == label][:k], 1):
            fit = [(j, -t) for t, j, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(i, p, place, rank, j, clip(-s), clip(t)) for rank, (j, t) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, hn.hard_negatives(table, F.col("vec_id") % 20 == 0, **options).collect()))


def some_rows(n=240, width=8, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=width)
    return [(k, int(rng.integers(0, 4)), [float(x) for x in (centre + rng.choice([-0.4, -0.1, 0.0, 0.1, 0.3], width)).astype(np.float32)]) for k in range(n)]


def test_negatives_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_BYTES", 30 * 8 * 8)
    monkeypatch.setattr(hn, "ANCHORS", 4)
    rows = some_rows()
    rows += [(300, None, [1.0] * 8), (320, 1, None), (340, 2, [float("nan")] * 8), (360, 1, [None] * 8), (380, 0, [1.0] * 5), (400, 0, []), (420, 3, [float("inf")] * 8), (None, 1, [1.0] * 8)]
    want = brute(rows)
    assert len(want) > 200 and found(spark, rows, groups=3) == want


def test_repeated_rows_and_ties(spark):
    rows = some_rows(60)
    rows += [rows[20]] * 7 + [rows[5]] * 2 + [(40, 1, rows[3][2]), (40, rows[40][1], rows[3][2])]
    assert found(spark, rows, groups=2) == brute(rows)
    same = [(k, k % 2, [0.5, 0.5]) for k in range(50)]
    assert found(spark, same) == brute(same)


def test_few_rows_no_positives_and_empty_tables(spark):
    rows = some_rows(8)
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(0, 1, [1.0]), (1, 2, [1.0])]) == []
    assert found(spark, [(0, 1, [1.0]), (20, 1, [-1.0]), (3, 2, [-1.0])]) == []  # limits of a negative positive hold nothing
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []
    assert hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.lit(None).cast("boolean")).collect() == []


def test_scores_beyond_doubles_and_longs(spark):
    rng = np.random.default_rng(6)
    rows = [(k, k % 2, (rng.normal(size=3) + 2).astype(np.float32).tolist()) for k in range(30)]
    rows += [(40, 0, [1e8, 3.0, 0.5]), (41, 0, [1e8, 2.0, 0.5]), (42, 1, [1e8, 1.0, 0.25]), (43, 1, [9e7, 1.0, 0.25]), (60, 0, [3e38] * 3), (61, 0, [3e38, 2e38, 3e38]), (62, 1, [2.5e38] * 3), (63, 1, [2.9e38] * 3)]
    want = brute(rows)
    assert any(r[5] == (1 << 63) - 1 for r in want) and found(spark, rows) == want


def test_order_keys_sort_like_their_numbers():
    numbers = [-(1 << 300), -(1 << 64), -257, -256, -255, -1, 0, 1, 255, 256, 257, 1 << 63, 1 << 300]
    keys = [hn.order_key(x) for x in numbers]
    assert keys == sorted(keys) and [hn.from_order_key(k) for k in keys] == numbers


def test_blocks_are_cut_by_bytes(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(hn, "BLOCK_BYTES", 1000)
    wide = [(k, k % 2, [1.0] * (2 if k % 9 else 100)) for k in range(60)]
    table = spark.createDataFrame(wide, SCHEMA).coalesce(1).selectExpr("vec_id AS id", "0L AS mark", "cast(label AS long) AS label", "1L AS rows", "cast(embedding AS array<double>) AS v")
    for row in table.mapInArrow(hn._blocks(False, 256), hn.BLOCKS).collect():
        sizes.append((len(row["vectors"]), len(row["ids"]) // 8))
    assert sum(n for _, n in sizes) == 60 and all(size <= 1000 or n == 1 for size, n in sizes)
