from checks import registry


def test_stream_reads_a_folder_of_files(spark, tmp_path):
    rows = [(i, [float(i % 5), 1.0, 0.5], i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.QUERIES.get("R10_lookup_stream") or registry.load() is None
    assert registry.QUERIES["R10_lookup_stream"](spark, str(tmp_path)).count() == 40 * 8
