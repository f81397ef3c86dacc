import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def documents():
    """Texts with what operators must bear: NULLs, empty and long texts, copies, near copies, odd letters."""
    rng = random.Random(7)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    near = base.split()
    near[40] = "changed"
    texts = [None, "", " \n\t ", "word", "a b c d e", base, base, " ".join(near), base + "\n", prose(rng, 4000)]
    texts += [f"{prose(rng, 30)}\n{passage}\n{prose(rng, 30)}" for _ in range(6)]
    texts += ["x" * 30_000, "é日本🙂 " * 200, "same " * 500, "line\n" * 300, "\x00\x1c\x85  Σ<|endoftext|>ΑΣ"]
    texts += ["Footer of the site\n" + prose(rng, 40) for _ in range(12)]
    rows = [(i, t, "en", "site" if i % 2 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows += [(None, base, None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use inside, and an extra one."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    clash = ("id", "key", "row", "d", "k", "raw", "run", "size", "full", "norm", "n", "x", "learn", "copies", "host", "count", "drop", "_id", "_host", "page", "pages")
    return frame.withColumns({c: F.lit(c) for c in clash})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
