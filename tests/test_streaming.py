from pyspark.sql import functions as F

from trackloom.operators.clusterize import clusters
from trackloom.streaming.files import cell_stream, run_stage

HEAD = "geometry_id,measurement_id,channel0,channel1,timestamp,value\n"


def test_files_are_processed_as_whole_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for event in range(3):
        (tmp_path / "in" / f"event{event:09d}-cells.csv").write_text(HEAD + "7,0,1,1,0,0.5\n7,0,2,2,0,0.5\n7,0,9,9,0,0.5\n")

    def stage(batch):
        cells = batch.select("event_id", F.lit(0).alias("module_index"), "channel0", "channel1", (F.col("event_id") * 100 + F.col("channel0")).alias("cell_id"))
        return clusters(cells).groupBy("event_id", "cluster_id").agg(F.count("*").alias("n"))

    run = lambda: run_stage(cell_stream(spark, str(tmp_path / "in"), files_per_batch=2), stage, str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination(120)
    run()
    (tmp_path / "in" / "event000000009-cells.csv").write_text(HEAD + "7,0,1,1,0,0.5\n")
    run()
    got = sorted((r.event_id, r.cluster_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [*((e, e * 100 + c, n) for e in range(3) for c, n in ((1, 2), (9, 1))), (9, 901, 1)]
