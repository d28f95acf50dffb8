"""The corpus queries against SQL, and the pipeline's stages on small tables."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from pagequarry.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cursor = con.execute(ORACLES[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == names
    order = [have.index(n) for n in names]
    want = sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == want


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (odd_docs.select(*columns), no_docs.select(*columns)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            path = str(tmp_path / f"{name}-{start.count()}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == columns
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (docs.count() > 0) == (start.count() > 0)
