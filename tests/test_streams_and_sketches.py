"""Streams in append mode over several batches of files, and sketches against exact figures."""

import random

from pyspark.sql import functions as F

from docloom.operators import sketches
from docloom.streaming import counts

EVENTS = "user_id long, event_type string, value double, ts timestamp"


def events(spark, rows):
    return spark.createDataFrame(rows, "user_id long, event_type string, value double, at string").select("user_id", "event_type", "value", F.to_timestamp("at").alias("ts"))


def test_a_second_batch_of_files_adds_only_new_windows(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    day = lambda d, h=1, v=1.0, kind="a": (1, kind, v, f"2024-01-{d:02} {h:02}:00:00")
    schema = events(spark, []).schema
    shape = lambda e: counts.windowed(e, "1 day", "1 day")
    events(spark, [day(1), day(1, 5, 2.0), day(2), day(4)]).write.parquet(f"{source}/p1.parquet")
    assert counts.appended(spark, f"{source}/*.parquet", schema, shape, out) == 0
    seen = lambda: sorted((str(r.start)[:10], r.event_type, r.n, r.total) for r in spark.read.parquet(f"{out}/rows").collect())
    first = [("2024-01-01", "a", 2, 3.0), ("2024-01-02", "a", 1, 1.0)]
    assert seen() == first
    files = {f.name for f in (tmp_path / "out" / "rows").glob("*.parquet")}
    events(spark, [day(1, 9, 50.0), day(4, 7), day(7, kind="b")]).write.parquet(f"{source}/p2.parquet")
    late = counts.appended(spark, f"{source}/*.parquet", schema, shape, out)
    assert late == 1 and seen() == [*first, ("2024-01-04", "a", 2, 2.0)]
    assert files < {f.name for f in (tmp_path / "out" / "rows").glob("*.parquet")}
    assert counts.appended(spark, f"{source}/*.parquet", schema, shape, out) == 0 and len(seen()) == 3


def test_two_streams_meet_in_time(spark, tmp_path):
    clicks = [(1, "c", 1.0, "2024-01-01 10:00:00"), (2, "c", 2.0, "2024-01-01 10:00:00"), (None, "c", 3.0, "2024-01-01 10:00:00")]
    buys = [(1, "p", 5.0, "2024-01-01 10:30:00"), (1, "p", 6.0, "2024-01-01 11:00:01"), (2, "p", 7.0, "2024-01-01 09:59:59"), (2, "p", 8.0, "2024-01-01 11:00:00")]
    for name, rows in (("c", clicks), ("p", buys)):
        events(spark, rows).write.parquet(str(tmp_path / name))
    read = lambda r, name: r.schema(events(spark, []).schema).parquet(str(tmp_path / name))
    want = [(1, 5.0), (2, 8.0)]
    still = counts.followed(read(spark.read, "c"), read(spark.read, "p"), "user_id", "1 HOUR")
    assert sorted((r.user_id, r.then_value) for r in still.collect()) == want
    moving = counts.followed(read(spark.readStream, "c"), read(spark.readStream, "p"), "user_id", "1 HOUR")
    moving.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.user_id, r.then_value) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == want


def test_sketches_are_near_and_merge(spark):
    draw = random.Random(5)
    rows = [(g, d, draw.randrange(3000) if g else 7, draw.gauss(0, 1) if g < 3 else None) for g in range(4) for d in range(10) for _ in range(600)] + [(0, 0, None, None)]
    df = spark.createDataFrame(rows, "g int, d int, u int, v double").repartition(5)
    of = ({"us": F.col("u")}, {"vs": F.col("v")})
    whole = {r.g: r for r in sketches.sketched(df, ["g"], *of).select("g", "n", sketches.distinct_count(F.col("us")).alias("u")).collect()}
    merged = sketches.merged(sketches.sketched(df, ["g", "d"], *of), ["g"], ["us"], ["vs"])
    ranks = [F.when(F.col("g") < 3, sketches.quantile(F.col("vs"), q)).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.9))]
    for r in merged.select("g", "n", sketches.distinct_count(F.col("us")).alias("u"), *ranks).collect():
        users, values = {x[2] for x in rows if x[0] == r.g and x[2] is not None}, sorted(x[3] for x in rows if x[0] == r.g and x[3] is not None)
        assert (r.n, r.u) == (whole[r.g].n, whole[r.g].u) and abs(r.u - len(users)) <= max(1, 0.05 * len(users))
        for i, q in enumerate((0.1, 0.5, 0.9)):
            if r.g < 3:
                assert abs(sum(v <= r[f"q{i}"] for v in values) / len(values) - q) < 0.02


def test_estimates_do_not_tell_in_how_many_parts_rows_were_sketched(spark):
    for n in (0, 5, 300, 390, 1500, 30_000):
        rows = spark.range(0, n, 1, 1).select(F.col("id").alias("u"), (F.col("id") % 13).alias("d"), F.lit(1.0).alias("v"))
        of = ({"us": F.col("u")}, {"vs": F.col("v")})
        estimate = sketches.distinct_count(F.col("us"))
        whole = sketches.sketched(rows, [], *of).select(estimate).first()[0]
        merged = sketches.merged(sketches.sketched(rows, ["d"], *of), [], ["us"], ["vs"]).select(estimate).first()[0]
        assert whole == merged and abs(whole - n) <= max(1, 0.05 * n)
