"""Quality rules whose thresholds come from quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswell.llm._shared import staged, whole_text

SPACE = r"[\x20\x09-\x0D]+"

#: Measures of a document that have an adaptive upper fence. Rates count per word.
MEASURES = ["symbol_rate", "dup_line_rate", "word_length"]

#: Rows from which on a group has a fence of its own; the fence of a smaller one is drawn towards that of its parent.
OWN_ROWS = 50

#: By how much of a fence an estimate may be above it, as equal figures differ by rounding.
ROUNDING = 1e-9


def _windows(hashed: Column) -> Column:
    """A hash of each five consecutive words. hashed is a column, not an expression: each window reads it."""
    five = lambda i: F.xxhash64(*[F.element_at(hashed, i + k) for k in range(5)])
    return F.when(F.size(hashed) >= 5, F.transform(F.sequence(F.lit(1), F.size(hashed) - 4), five)).otherwise(F.array().cast("array<bigint>"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) of whole texts.

    Words are runs without ASCII white space. A null or empty text has zeros everywhere. Window hashes are
    first compared as a set; only texts with a repeat pay for the sort by which the places of
    repeated windows are found, so the work is n log n in the words of a text.
    """
    raw = whole_text(text)
    found = docs.withColumn("_words", F.filter(F.split(raw, SPACE), lambda w: w != ""))
    found = found.withColumn("_hashed", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_windows", _windows(F.col("_hashed")))
    lines = F.filter(F.split(raw, "\n", -1), lambda x: F.regexp_replace(x, SPACE, "") != "")
    repeats = """
        aggregate(
          sort_array(filter(transform(
              sequence(1, size(_sorted)),
              i -> if((i > 1 and _sorted[i - 1].h = _sorted[i - 2].h)
                      or (i < size(_sorted) and _sorted[i - 1].h = _sorted[least(i, size(_sorted) - 1)].h), _sorted[i - 1].i, -1)),
            p -> p >= 0)),
          named_struct('n', 0L, 'end', -1),
          (s, p) -> named_struct('n', s.n + (p + 5) - greatest(p, s.end), 'end', p + 5),
          s -> s.n)"""
    has_repeat = F.size(F.array_distinct("_windows")) < F.size("_windows")
    return (
        found.withColumn("_sorted", F.when(has_repeat, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .select(
            *docs.columns,
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.regexp_replace(raw, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(raw) - F.length(F.translate(raw, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            F.when(F.col("_sorted").isNull(), F.lit(0).cast("long")).otherwise(F.expr(repeats)).alias("n_repeat_words"),
        )
    )


def _bounds(measured: DataFrame) -> tuple[dict[str, Column], dict[str, Column]]:
    """(upper, lower) estimates of each measure: a text shows a rate no finer than one occurrence more or less, and its words'
    mean length no finer than by one in the root of their number."""
    words, some = F.col("n_words"), F.greatest("n_words", F.lit(1))
    length, error = F.col("word_chars") / some, 1 / F.sqrt(some)
    counts = {"symbol_rate": F.col("n_symbols"), "dup_line_rate": F.col("n_dup_lines")}
    upper = {m: (c + 1) / (words + 1) for m, c in counts.items()} | {"word_length": length * (1 + error)}
    lower = {m: (c - 1) / some for m, c in counts.items()} | {"word_length": length * (1 - error)}
    return upper, lower


def adaptive_fences(measured: DataFrame, by: list[str], spread: float = 8.0, accuracy: int = 10_000) -> DataFrame:
    """Per group of `by` an upper fence for each measure, max_ and its name.

    Groups nest: leaving out the last names of `by` one after the other gives their parents, the outermost being all rows. The
    fence of a level is the median of the upper estimates plus `spread` times its distance from the lowest tenth. Only the lower half decides, so
    that up to half of a group may be junk without moving its fence. From OWN_ROWS rows on it is the group's alone, however much noisier the group
    is than the corpus; a smaller group's is the geometric mean of its own and its parent's, the own weighing as its rows to OWN_ROWS. No width is
    fixed: where most texts have no symbol at all, quantiles still tell how finely texts of such lengths show a rate.

    Quantiles come from Greenwald-Khanna sketches, which Spark merges from map-side parts: a group with a third of
    all rows costs no more than another.
    """
    upper = measured.select(*by, *[c.alias(m) for m, c in _bounds(measured)[0].items()])
    quantiles = [F.percentile_approx(m, [0.1, 0.5], accuracy).alias(m) for m in MEASURES]
    own = [(F.col(m)[1] + (F.col(m)[1] - F.col(m)[0]) * spread).alias(m) for m in MEASURES]
    levels = staged(upper.rollup(*by).agg(F.grouping_id().alias("_level"), F.count("*").alias("_n"), *quantiles).select(*by, "_level", "_n", *own), "fences")
    found = None
    for depth in range(len(by) + 1):
        level = levels.where(F.col("_level") == 2 ** (len(by) - depth) - 1).select(*by[:depth], "_n", *MEASURES)
        if found is None:
            found = level.select(*[F.col(m).alias(f"max_{m}") for m in MEASURES])
            continue
        parent = found.select(*[F.col(c).alias(f"_p{c}") for c in by[: depth - 1]], *[F.col(f"max_{m}").alias(f"_p{m}") for m in MEASURES])
        same = [F.col(c).eqNullSafe(F.col(f"_p{c}")) for c in by[: depth - 1]] or F.lit(True)
        weight = F.least(F.lit(1.0), F.col("_n") / OWN_ROWS)
        drawn = lambda m: F.pow(m, weight) * F.pow(f"_p{m}", 1 - weight)
        found = level.join(parent, same).select(*by[:depth], *[drawn(m).alias(f"max_{m}") for m in MEASURES])
    return found


def judge_quality(docs: DataFrame, by: list[str] = ["lang", "source"], text: str = "text", spread: float = 8.0, carry: list[str] | None = None) -> DataFrame:  # noqa: B006
    """Every row of docs with its measures, base_failed, failed_by (names of the failed rules) and kept.

    A document is kept if it passes the base rules (10 words or more; no more than a fifth of the words
    in repeated windows) and no lower estimate of it is above the adaptive fence of its language and source, so that one symbol or one
    repeated line alone is no reason. Null language or source make groups of their own. Null or empty texts fail the base
    rule; repeated rows are judged each; an empty table gives no rows; columns of docs with the name of a measure are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
    names = [f"_by{k}" for k in range(len(by))]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in [*made, "base_failed", "failed_by", "kept"]]
    body = docs.select(F.struct(*carry).alias("_body"), F.col(text).alias("_text"), *[F.col(c).alias(n) for c, n in zip(by, names)])
    # The texts are measured once; what the sketches and the verdicts read is narrow if carry is.
    measured = staged(measures(body, "_text").drop("_text"), "measures")
    fences = adaptive_fences(measured, names, spread).withColumnsRenamed({n: f"{n}g" for n in names})
    same = [F.col(n).eqNullSafe(F.col(f"{n}g")) for n in names]
    joined = measured.join(fences, same, "left")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    over = F.filter(F.array(*[F.when(c > F.col(f"max_{m}") * (1 + ROUNDING), F.lit(m)) for m, c in _bounds(measured)[1].items()]), lambda x: x.isNotNull())
    return joined.select("_body.*", *made, base.alias("base_failed"), over.alias("failed_by"), (~base & (F.size(over) == 0)).alias("kept"))
