"""Every registered query with SQL must give the rows that DuckDB gives on the same tables."""

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from sylva import queries as core
from sylva import queries_more, queries_rest, queries_state  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    return v


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    rows = core.QUERIES[name](spark, str(DATA))
    columns = sorted(rows.columns)
    got = Counter(str(tuple(norm(r[c]) for c in columns)) for r in rows.collect())
    out = duck.execute(core.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == Counter(str(tuple(norm(r[i]) for i in at)) for r in out.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, str(DATA)).count() > 0


@pytest.mark.parametrize("name", ["fn_normalised", "emp_strip", "fn_word_count", "agg_runs_merge", "spec_attachments", "src_spec", "win_page_assign"])
def test_whole_tables(spark, name):
    """Every document with a text has its rows."""
    docs = {r.doc_id for r in spark.read.parquet(str(DATA / "documents.parquet")).where("trim(text) <> ''").collect()}
    assert {r.doc_id for r in core.QUERIES[name](spark, str(DATA)).collect()} >= docs


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_no_caps(name):
    """The SQL keeps to no number of sections or lines."""
    assert "section <= 12" not in core.ORACLE_SQL[name] and "<= 200" not in core.ORACLE_SQL[name]


@pytest.mark.parametrize("name", ["win_page_assign", "join_page_probe"])
def test_pages_of_long_documents(spark, tmp_path, name):
    texts = ["\n".join(f"line {i * i % 977} of the long text" for i in range(450)), "one\ntwo", "x" * 4000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for d, text in enumerate(texts):
        pages, page = [text[k : k + 1524] for k in range(0, len(text), 1500)], 1
        for pos, line in enumerate(text.split("\n"), 1):
            page = next((k for k in range(page, len(pages) + 1) if line[:24] in pages[k - 1]), page)
            want.append((d, pos, page))
    assert sorted(map(tuple, core.QUERIES[name](spark, str(tmp_path)).select("doc_id", "pos", "page").collect())) == want


def test_sections_after_the_twelfth(spark):
    from sylva.operators import brief
    from sylva.sources.corpus import nodes

    n = nodes(spark, str(DATA))
    want = sorted(map(tuple, brief.sections(n).select("doc_id", "section", "heading").collect()))
    assert max(w[1] for w in want) > 12
    read = queries_more._read_sections(n)
    assert sorted(map(tuple, read.select("doc_id", "section", "heading").collect())) == want
    assert max(r.section for r in core.QUERIES["join_reading"](spark, str(DATA)).collect()) > 12
    assert max(r.section for r in core.QUERIES["set_union_terms"](spark, str(DATA)).collect()) > 12


def test_chart_kinds_are_read_off_the_phrases(duck):
    """The SQL judges what is said: another name gives another kind, whatever the number."""
    sql = core.ORACLE_SQL["chart_kind"].replace("FROM part", "FROM (SELECT p_partkey, 'scattered' AS p_name, p_type, p_brand FROM part)")
    kinds = dict(duck.execute(sql).fetchall())
    assert {k: v for k, v in kinds.items() if k < 12} == {0: "pie", 1: "pie", 2: "scatter", 3: "line", 4: "scatter", 5: "scatter", 6: "grouped_bar", 7: "grouped_bar", 8: "scatter", 9: "scatter", 10: "bar", 11: "scatter"}
