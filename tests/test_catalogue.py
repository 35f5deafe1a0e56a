"""Every query with SQL agrees with DuckDB; every other one returns rows."""

import duckdb
import pytest

from oreline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents labels pages conversations".split()


def rows(t):
    cols = sorted(t.column_names)
    norm = lambda v: round(v, 6) if isinstance(v, float) else str(v)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in t.to_pylist()), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, name):
    got = catalogue.queries()[name](spark, sf).toArrow()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert rows(got) == rows(con.sql(sql).to_arrow_table())


def test_bsp_build_takes_every_part(spark, tmp_path):
    parts = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    parts.repartition(5, "p_size").write.parquet(f"{tmp_path}/part.parquet")
    got, dealt = (sorted(map(tuple, catalogue.queries()["bsp_build"](spark, d).collect())) for d in ("/root/testdata/sf0.01", str(tmp_path)))
    assert got == dealt
    totals = {}
    for r in got:
        totals[r[0]] = totals.get(r[0], 0) + r[2]
        assert 0 < r[2] <= 64 and r[6] == 0
    assert totals == {r.p_brand: r["count"] for r in parts.groupBy("p_brand").count().collect()} and max(totals.values()) > 64
