from quillspan.streaming.ingest import append_docs, stream_texts


def test_files_are_taken_up_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([(1, "title\nbody words")], "doc_id long, text string").write.parquet(source)
    append_docs(stream_texts(spark, source), out, state).awaitTermination()
    spark.createDataFrame([(2, "other"), (3, None)], "doc_id long, text string").write.mode("append").parquet(source)
    append_docs(stream_texts(spark, source), out, state).awaitTermination()
    rows = sorted((r.doc_id, r.title, r.body_len) for r in spark.read.parquet(out).collect())
    assert rows == [(1, "title", 2), (2, "other", 0), (3, "", 0)]
