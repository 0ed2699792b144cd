"""Every query that SQL can express gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from millrace.operators import code_units
from millrace.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    found = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return found


def _rows(rows):
    return sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, small, con, name):
    df = registry.queries()[name](spark, small)
    cols = sorted(df.columns)
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    assert _rows(df.select(*cols).collect()) == _rows([[r[names.index(c)] for c in cols] for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_give_rows(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_repository_parts_hold_bounded_texts_of_any_repository(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(code_units, "PART_BYTES", 1000)
    docs = [(i, "x" * 200, None if i % 3 == 0 else "en", "web") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["repository_markdown"](spark, str(tmp_path))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert _rows(found.select("repo", "position", "text").collect()) == _rows(own.execute(registry.oracle_sql()["repository_markdown"]).fetchall())
