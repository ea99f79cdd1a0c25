from pyspark.sql import functions as F

from tallygrove.streaming import incremental as I


def test_only_missing_keys_are_worked_on(spark, tmp_path):
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    seen = []

    def work(df):
        rows = [r.id for r in df.select("id").collect()]
        seen.extend(rows)
        return df.withColumn("v", F.col("id") * 2)

    spark.range(4).write.parquet(source)
    run = lambda: I.keep_filled(spark.readStream.schema("id long").parquet(source), store, "id", work, f"{tmp_path}/check", once=True).awaitTermination()
    run()
    spark.range(2, 7).write.mode("append").parquet(source)
    run()
    assert sorted(seen) == list(range(7))
    assert sorted((r.id, r.v) for r in spark.read.parquet(store).collect()) == [(i, 2 * i) for i in range(7)]
    I.fill(spark.range(7), store, "id", work)
    assert spark.read.parquet(store).count() == 7
