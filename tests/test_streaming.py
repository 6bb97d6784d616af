from litloom import streaming
from litloom.runtime import table


def drain(spark, d, name, mode):
    q = d.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_agree_with_tables(spark, sf, tmp_path):
    p = table(spark, sf, "papers")
    p.repartition(3).write.parquet(f"{tmp_path}/in")
    rows = streaming.papers_stream(spark, f"{tmp_path}/in", p.schema)
    assert drain(spark, streaming.screened_stream(rows).select("record_id", "is_relevant"), "screens", "append").count() == p.count()
    once = drain(spark, streaming.first_rows(streaming.papers_stream(spark, f"{tmp_path}/in", p.schema), delay="9000 days").select("key"), "keys", "append")
    assert once.count() == once.distinct().count()
    n = drain(spark, streaming.yearly_counts(streaming.papers_stream(spark, f"{tmp_path}/in", p.schema)), "counts", "complete")
    assert n.agg({"n": "sum"}).first()[0] == p.count()
