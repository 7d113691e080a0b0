import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept string, node string, _words string, slot string"


def odd_rows():
    """Null and empty texts, white space, a very long text, a very long word, repeated rows, a null id, characters of all widths."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß中🙂'") for _ in range(rng.randint(1, 6)))
    body = " ".join(word() for _ in range(120))
    texts = [None, "", " \t\n ", body, body, body + " tail", " ".join(word() for _ in range(6000)), "x" * 3000, "one", "one two", "A b\nA b\nA b " + body, "don't 'tis  we'll x\n\n 12½", "\x00\x00" + body[:150]]
    rows = [(k, t, "en" if k % 3 else None, "s" if k % 2 else None) for k, t in enumerate(texts)]
    return [*rows, rows[5], rows[0], (None, body + " null id", "en", "s"), (None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A table with odd rows and columns whose names clash with those that operators add."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    rows = [(i, t, lang, source, len(t or ""), 1, "k", "n", "w", "s") for i, t, lang, source in odd_rows()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(odd, spark):
    return spark.createDataFrame([], odd.schema)


def key(row):
    return tuple((v is not None, v) for v in row)
