"""Queries whose results the contract fixes whole, against their SQL."""

import duckdb
import pytest

from hexalloc.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con(tmp_path_factory):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(r[c] for c in names) for r in df.collect())
    assert got == sorted(rel.fetchall()) and {type(v) for r in got for v in r} <= {int, str, bool}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_edges_equal_sql(spark, edges, name):
    """Nulls, empty and long texts and marks of all kinds, read by both engines."""
    pdf = edges.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).toPandas()
    c = duckdb.connect()
    c.register("documents", pdf)
    c.execute("create table benchmark as select * from (values (1, 'one'), (2, 'The word1 the word2 the word3'), (3, null), (4, '日本語のテキスト と'), (5, 'mit LICENSE')) t(item_id, text)")
    rel = c.execute(catalog.ORACLE_SQL[name])
    names, want = [d[0] for d in rel.description], sorted(rel.fetchall())
    docs = edges.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    if name == "op5_decontamination":
        from hexalloc.llm import decontamination

        df = decontamination.verdicts(docs, spark.createDataFrame(c.execute("select * from benchmark").df()))
    else:
        from hexalloc.llm import near_dups

        df = near_dups.group(docs, 3, 85)
    assert sorted(tuple(r[x] for x in names) for r in df.collect()) == want
