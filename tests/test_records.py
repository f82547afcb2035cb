"""Queries on the record view against DuckDB, over documents with empty names, repeated ids and missing values."""

import duckdb
import pytest

from matchloom.plans import registry


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = [(i, f"kaban locor {i // 6} mifes\nsecond line {'x' * 80}", "en", "src1") for i in range(60)]
    rows += [(60 + i, f"... !!\nno name here {'y' * 80}", "en", "src2") for i in range(6)]  # equal heads, empty names
    rows += [(i, f"kaban locor {i // 6} mifes\nsecond line {'x' * 80}", "en", "src1") for i in (3, 4, 4)]  # ids that repeat
    rows += [(70, None, "en", "src1"), (71, "", "fr", None), (72, "kaban locor 1 mifes", None, "src1"), (73, "kaban lo", "en", None)]
    sf = tmp_path_factory.mktemp("odd")
    docs = [(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(sf / "documents.parquet"))
    return str(sf)


def same_as_duckdb(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    got = registry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert rows and sorted(map(str, rows)) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["sim_jaro_winkler"])
def test_pairs_match_duckdb(spark, odd, name):
    same_as_duckdb(spark, odd, name)
