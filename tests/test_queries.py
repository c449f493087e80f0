"""Every query of the engine runs, and agrees with its SQL where there is one."""

import math
import os

import duckdb
import pytest

from folioscope.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, SF)
    rows = found.collect()
    assert rows
    if name in catalogue.oracle_sql():
        got = duck.execute(catalogue.oracle_sql()[name])
        columns = [d[0] for d in got.description]
        assert sorted(columns) == sorted(found.columns)
        want = [tuple(value(x) for x in r) for r in got.fetchall()]
        assert sorted((tuple(value(r[c]) for c in columns) for r in rows), key=repr) == sorted(want, key=repr)


def test_entry_works_without_the_optional_part(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "id", "section_index", "score", "rank"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_exact_closure_selects_all_vectors(spark):
    found = catalogue.queries()["exact_closure"](spark, SF)
    want = {(str(r["label"]), f"c{r['vec_id']}") for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert want <= {(r["doc_id"], r["id"]) for r in found.collect()}
