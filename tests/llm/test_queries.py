import pytest
from compare import connect, same

from spanwright.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    same(Q.queries()[name](spark, sf_dir).toPandas(), connect(sf_dir).sql(Q.oracle_sql()[name]).df())


def test_all_queries():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{n}" for n in range(1, 14)]


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    assert [n for n, _ in c.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now and now <= before, name
        docs, before = out, now
    result = c.run(spark, sf_dir)
    assert result.count() > 0 and result.columns == [*columns, "copy", "size", "text_crc32", "shard", "slot"]
    assert result.select("shard", "slot").distinct().count() == result.count()
