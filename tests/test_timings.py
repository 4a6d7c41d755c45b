import time

from fieldloom.operators.metrics import ewm_smooth, running_total
from fieldloom.sources.schema import METRIC
from fieldloom.streaming.timings import Timings, timed_write


def test_timings_are_a_table(spark, tmp_path):
    """Three micro-batches and a batch write make four rows, which smoothing reads."""
    for i in range(3):
        spark.range(10 * (i + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = Timings()
    spark.streams.addListener(seen)
    try:
        source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = source.writeStream.queryName("room").format("noop").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if len(seen.rows) == 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    seen.save(spark, str(tmp_path / "metrics"))
    timed_write(spark.range(7), "room", "predict", 5, str(tmp_path / "out"), str(tmp_path / "metrics"))
    table = spark.read.schema(METRIC).parquet(str(tmp_path / "metrics"))
    rows = sorted((r.op, r.scan_id, r.num_points) for r in table.collect())
    assert rows[0] == ("predict", 5, 7) and sorted(n for _, _, n in rows[1:]) == [10, 20, 30] and spark.read.parquet(str(tmp_path / "out")).count() == 7
    updates = running_total(table.where("op = 'update'"), "model", "scan_id", "num_points", "points")
    smooth = ewm_smooth(updates, "model", "points", "seconds").collect()
    assert len(smooth) == 3 and all(r.ewm > 0 and r.seconds > 0 for r in smooth) and max(r.points for r in smooth) == 60
