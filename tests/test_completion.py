"""The completion trigger: each file once, re-delivery and restarts change nothing, jobs as in a batch."""

from pyspark.sql import functions as F

from registra.operators.storage import new_path
from registra.streaming import completion

PAGE = "file_id string, place int"


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(folder)


def test_each_file_once(spark):
    folder, state, out = (new_path(spark, n) for n in ("pages", "state", "out"))
    files = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1), ("d", 9), ("e", 0)], "file_id string, page_count int")
    schema = spark.createDataFrame([], PAGE).schema
    seen = []

    def job(done):
        seen.append(sorted(r.file_id for r in done.collect()))
        return done.withColumn("double", 2 * F.col("pages_in"))

    run = lambda: completion.run_on_completion(spark, folder, schema, files, job, "test", state=state, out=out)
    deliver(spark, folder, [("a", 0), ("a", 0), ("a", 1), ("b", 1), ("b", 7), ("z", 0), ("e", 0), ("c", 0)])
    assert {(r.file_id, r.pages_in, r.double) for r in run().collect()} == {("c", 1, 2)}
    deliver(spark, folder, [("a", 0), ("b", 0), ("c", 0), ("d", 0)])
    deliver(spark, folder, [("a", 2), ("b", 0), ("c", 0)])
    assert sorted(r.file_id for r in run().collect()) == ["a", "b", "c"]
    deliver(spark, folder, [("a", 0), ("a", 1), ("a", 2), ("b", 1)])  # a whole file again
    assert sorted(r.file_id for r in run().collect()) == ["a", "b", "c"]
    assert sorted(sum(seen, [])) == ["a", "b", "c"]
