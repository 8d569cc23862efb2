"""The push stream over several micro-batches: what it raises and how much it remembers."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codestrata.streaming import micro_review

DAY = datetime(2024, 1, 1)


def _pushed(spark, folder, number, rows):
    made = spark.createDataFrame([(DAY + timedelta(days=d), name) for d, name in rows], "ts timestamp, name string")
    made.coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return number


def _run(spark, folder, raised=None):
    stream = spark.readStream.schema("ts timestamp, name string").parquet(str(folder / "in"))
    once = micro_review.deduplicated(stream, F.col("name"), "ts", "10 days", raised).select("fingerprint")
    query = (once.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state"))
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return sorted(r["fingerprint"] for r in spark.read.parquet(str(folder / "out")).collect()), state[-1]


def test_state_falls_after_the_horizon(spark, tmp_path):
    raised = spark.createDataFrame([("old",), ("old",)], "fingerprint string")
    _pushed(spark, tmp_path, 1, [(0, f"f{i}") for i in range(50)] + [(1, "f0"), (1, "old")])
    found, remembered = _run(spark, tmp_path, raised)
    assert found == sorted(f"f{i}" for i in range(50)) and remembered == 50
    # repeats inside the horizon raise nothing, across batches and a restart of the stream
    _pushed(spark, tmp_path, 2, [(5, "f3"), (5, "f3"), (6, "g")])
    found, remembered = _run(spark, tmp_path, raised)
    assert found == sorted([f"f{i}" for i in range(50)] + ["g"]) and remembered == 51
    # long after, the first fingerprints are forgotten, a row behind the watermark is dropped, issues raised before still count
    _pushed(spark, tmp_path, 3, [(60, "h")])
    _run(spark, tmp_path, raised)
    _pushed(spark, tmp_path, 4, [(61, "old"), (61, "i"), (2, "late")])
    found, remembered = _run(spark, tmp_path, raised)
    assert found == sorted([f"f{i}" for i in range(50)] + ["g", "h", "i"]) and remembered == 2
