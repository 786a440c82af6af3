"""All queries with SQL, side by side on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([norm(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.mark.skipif(not Path(D).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    got = entry.queries()[name](spark, D).toArrow()
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
        want = c.sql(entry.oracle_sql()[name]).to_arrow_table()
    rows = lambda t: sorted(tuple(norm(r[k]) for k in sorted(t.column_names)) for r in t.to_pylist())
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not Path(D).exists(), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() >= 0


def test_tags_of_any_hash(spark, tmp_path):
    """Full-width and small hashes are hashes after NFKC."""
    from tidewell.functions import text_rules

    texts = ["see #plain now", "見て ＃猫 です", "see ﹟small now", "none here", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["display"]) for r in entry.queries()["tags_in_texts"](spark, str(tmp_path)).collect())
    assert got == [(0, "plain"), (1, "猫"), (2, "small")] and [len(text_rules.tags_in(t)) for t in texts[:4]] == [1, 1, 1, 0]
