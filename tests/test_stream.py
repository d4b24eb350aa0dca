from folioflow.streaming.incremental import new_documents, paginate_stream


def test_restart_reads_only_what_is_new(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for ids in ([1, 2], [3]):
        docs = spark.createDataFrame([(i, "Bir cümle. İkinci cümle.") for i in ids], "doc_id long, text string")
        docs.write.mode("append").parquet(source)
        query = paginate_stream(new_documents(spark, source, docs.schema), out, mark)
        query.awaitTermination(120)
        assert query.exception() is None
    rows = spark.read.parquet(out).select("book_id", "batch").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0), (2, 0), (3, 1)]
