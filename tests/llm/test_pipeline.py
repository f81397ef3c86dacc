"""The pipeline, and the queries against their SQL."""

import math
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from jabcheck.llm.common import staged, table
from jabcheck.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    selected = ", ".join(f'"{c}"' for c in columns)
    plain = lambda v: "NaN" if isinstance(v, float) and math.isnan(v) else v
    ours = Counter(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    assert ours == Counter(tuple(map(plain, r)) for r in duck.sql(f"SELECT {selected} FROM ({ORACLE[name]})").fetchall())


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    columns, sizes, chars = docs.columns, [docs.count()], []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SMALL))
        assert docs.columns == columns, name
        sizes.append(docs.count())
        chars.append(docs.selectExpr("sum(length(text))").first()[0])
        assert docs.filter("n_chars <> length(text)").count() == 0
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] == sizes[4]
    assert chars[0] >= chars[1] > chars[2] > chars[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    words = docs.selectExpr(r"sum(regexp_count(text, '[^\\x20\\x09-\\x0D]+'))").first()[0]
    assert packed.selectExpr("sum(n_tokens)").first()[0] == words


def test_run_is_its_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "repeated_passages", "packing"]
    assert corpus_pipeline.run(spark, SMALL).columns[:2] == ["doc_id", "piece"]


@pytest.mark.parametrize("stage", range(5))
def test_stages_bear_empty_and_odd_tables(spark, docs, rows, stage):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    function = corpus_pipeline.STAGES[stage][1]
    assert function(spark, plain.limit(0), SMALL).count() == 0
    got = function(spark, plain, SMALL)
    assert got.count() > 0 and (stage == 4 or got.columns == plain.columns)


def test_one_of_many_copies_in_a_source_survives(spark):
    """A third of all rows are copies in one source: stages 2 to 5 must keep their text once, without the footer."""
    rng = random.Random(11)
    body = lambda: [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(4)]
    copied, footer = body(), "Footer of the site"
    texts = [[*copied, footer]] * 100 + [[*body(), footer] for _ in range(100)] + [body() for _ in range(100)]
    rows = [(i, "\n".join(t), "en", "a" if i < 200 else "b", 0) for i, t in enumerate(texts)] + [(300, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").repartition(3)
    distinct = {(source, text) for _, text, _, source, _ in rows}
    pages = Counter(source for source, _ in distinct)
    on = Counter((source, line) for source, text in distinct for line in set((text or "").split("\n")))
    common = {k for k, n in on.items() if n >= 5 and n > 0.02 * pages[k[0]]}
    assert common == {("a", footer)}
    expected = {i: None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in common) for i, t, _, s, _ in rows}
    lines = staged(corpus_pipeline.STAGES[1][1](spark, docs, SMALL))
    assert {r.doc_id: r.text for r in lines.collect()} == expected
    for _, stage in corpus_pipeline.STAGES[2:4]:
        lines = staged(stage(spark, lines, SMALL))
    assert {r.doc_id: r.text for r in lines.collect()} == {i: t or "" for i, t in expected.items() if not 0 < i < 100}
    packed = corpus_pipeline.STAGES[4][1](spark, lines, SMALL).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in packed if r[0] < 100} == {0: 120}
