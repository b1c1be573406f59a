import datetime

from helixmill.streaming import rows


def test_streamed_reads_match_batch(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    data = [(i % 5, "@r\r", "ACGT\r", "IIII\r", 1, day + datetime.timedelta(minutes=i)) for i in range(10)] + [(9, "@x", "ACX", "III", 2, day)]
    schema = "read_idx long, id string, seq string, qual string, run_id int, loaded_at timestamp"
    src = str(tmp_path / "in")
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(src)
    stream = rows.cleaned(rows.arriving(spark, src, spark.read.parquet(src).schema))
    q = stream.writeStream.format("memory").queryName("cleaned_reads").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select read_idx, seq, problem from cleaned_reads order by read_idx").collect()
    assert [tuple(r) for r in got] == [(i, "ACGT", None) for i in range(5)] + [(9, "ACX", "illegal base")]
    totals = rows.run_totals(spark.createDataFrame(data, schema)).orderBy("run_id").collect()
    assert [(r.run_id, r.reads) for r in totals] == [(1, 10), (2, 1)]
