from factline.llm import queries


def test_the_query_sees_order_beyond_neighbours(spark, tmp_path):
    # all hold the same words and pairs; the last one has a triple of its own
    rows = [(i, "a b a c a", "en", "s", 9) for i in range(5)] + [(9, "a c a b a", "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["log_score"] for r in queries.op10_lm_scores(spark, str(tmp_path)).collect()}
    assert found[0] > found[9]
