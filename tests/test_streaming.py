import shutil

from methyloom.operators import quarantine as quar
from methyloom.streaming import arrivals


def test_stream_equals_batch(spark, sf, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    shutil.copy(f"{sf}/pileup_lines.parquet", folder / "a.parquet")
    lines = spark.read.parquet(str(folder))
    good, bad, check = (str(tmp_path / n) for n in ("good", "bad", "check"))
    arrivals.split_arrivals(arrivals.read_lines(spark, str(folder)), good, bad, check).awaitTermination(120)
    records, errors = quar.load_pileup(lines)
    assert spark.read.parquet(good).count() == records.count() and spark.read.parquet(bad).count() == errors.count() > 0


def test_window_aggregate_in_a_stream(spark, sf, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    shutil.copy(f"{sf}/pileup_lines.parquet", folder / "a.parquet")
    want = arrivals.arrivals_per_window(spark.read.parquet(str(folder)))
    stream = arrivals.arrivals_per_window(arrivals.read_lines(spark, str(folder)))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("arrived").collect())) == sorted(map(tuple, want.collect()))
