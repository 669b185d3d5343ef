"""op7's counts by kind, where a kind's spans stand at any place of the array."""

from spanwright.llm import queries as L


def test_counts_are_of_kinds_and_not_of_places(spark, tmp_path):
    rows = [(1, "a@b.co c@d.co 1.2.3.4"), (2, "+49 151 2345678 and 4111 1111 1111 1111"), (3, None), (4, "9.9.9.9")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in L.queries()["op7_pii"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 1, 0, 0), 2: (0, 0, 1, 1), 3: (0, 0, 0, 0), 4: (0, 1, 0, 0)}
