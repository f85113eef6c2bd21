"""Every query with SQL gives what DuckDB gives."""

import os

import duckdb
import pytest

from tidewater.plans import registry as catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


def rows(df):
    cell = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(repr([cell(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalogue.queries()[name](spark, SF).toPandas(), db.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_facts_of_other_families(spark, tmp_path):
    """q47 asks the families of its SQL, with its word bounds, spaces and small letters."""
    texts = ["the CEO of X", "a damage of the CEO", "it impacts X", "a subsidiary", "x the y", "x of y", "owned\x0bby", "owned\f\n by", "owned by", "éowns", "ownsß", "disowns", "owns_", "OWNS", "acquİred", "İowns", "led to the end", "led tokens", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.doc_id: r.core for r in catalogue.queries()["q47_edge_type_from_fact"](spark, str(tmp_path)).collect()}
    assert got == dict(db.execute(catalogue.oracle_sql()["q47_edge_type_from_fact"]).fetchall())
    assert [got[i] for i in (0, 1, 2, 4, 5, 6, 9)] == ["TRIGGERS", "PART_OF", None, "PART_OF", "TRIGGERS", None, "PART_OF"]
