"""Queries beside their SQL: the smallest tables, and a folder of awkward rows."""

from __future__ import annotations

import duckdb
import pytest
from compare import rows as values

from panelith.llm import queries
from panelith.llm.oracle import SQL

TABLES = ("documents", "labels")


def both(spark, folder: str, name: str) -> tuple[list, list]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if folder.startswith('/root') else '/*.parquet'}')")
    return values(queries.QUERIES[name](spark, folder).toPandas()), values(con.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_the_oracles(spark, small, name):
    own, other = both(spark, small, name)
    assert own and own == other


@pytest.fixture(scope="module")
def awkward(spark, docs, tmp_path_factory):
    """The common fixture with labels that certify some rules: symbols and exclamations in what is bad."""
    folder = str(tmp_path_factory.mktemp("awkward"))
    prose = [(1000 + i, " ".join(f"{'abcdefgh'[(i * k) % 8] * (1 + (k * 7 + i) % 6)}{(i * 31 + k * k) % 97}" for k in range(70 + i % 40)), "en" if i % 2 else None) for i in range(1400)]
    prose = [(i, t if i % 7 else t.replace("a", "#!"), lang) for i, t, lang in prose]
    extra = spark.createDataFrame([(i, t, lang, "s", len(t), True, "x") for i, t, lang in prose], docs.schema)
    docs.unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1 if i % 7 else 0, 0) for i, _, _ in prose] + [(1001, 0, 0), (None, 1, 0), (1002, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(SQL))
def test_awkward_rows_equal_the_oracles(spark, awkward, name):
    own, other = both(spark, awkward, name)
    assert own and own == other
