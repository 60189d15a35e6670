"""Every registered query: against its SQL where it has one, else that it gives rows of a stable schema."""

from __future__ import annotations

import pytest

from compare import TABLES, connect, differences
from decisium.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, sf_dir, con, name):
    assert differences(registry.queries()[name](spark, sf_dir), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_gives_rows(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_example_rows_of_odd_tables(spark, sf_dir, tmp_path):
    for t in TABLES:
        if t not in ("documents", "labels"):
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    rows = [
        (1, "Not labelled as good.", "en", "a"), (2, "later", "en", "a"), (3, "A language that is no option.", "xx", "b"), (4, "later", "fr", "b"), (5, None, "fr", "c"), (6, "No language.", None, "d"),
        (7, "No source.", "es", None), (8, "later", "es", None), (9, "  x\u3000\t" * 90, "de", "e"), (10, "A copy.", "de", "f"), (10, "A copy.", "de", "f"), (11, "The first of two labels.", "de", "g"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0), (2, 1, 0), (11, 1, 0), (11, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = registry.queries()["example_rows"](spark, str(tmp_path))
    assert differences(df, connect(str(tmp_path)), SQL["example_rows"]) == []
    assert df.filter("family = 'a' AND contains(shown, 'idx=None → ? (gold=?)')").count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
