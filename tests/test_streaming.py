import random

from pyspark.sql import functions as F

from ragloom.streaming.progress import RESULTS, current_progress, track_progress


def test_progress_goes_on_where_it_stopped(spark, tmp_path):
    """Files arrive out of order and with repeats; the stream stops after some of them, starts anew, and counts each row once."""
    r = random.Random(1)
    rows = [(f"c{c}", i, i % 4 != 0, None if i % 4 == 0 else i / 100) for c in range(3) for i in range(30) if not (c == 2 and i == 11)]
    sent = rows + r.sample(rows, 25)
    r.shuffle(sent)
    results, progress, checkpoint = (f"{tmp_path}/{n}" for n in ("results", "progress", "checkpoint"))
    write = lambda part: spark.createDataFrame(part, RESULTS).coalesce(1).write.mode("append").parquet(results)
    for a in range(0, 40, 10):
        write(sent[a : a + 10])
    query = track_progress(spark, results, progress, checkpoint, files=1)
    query.awaitTermination()
    first = {x.config: x for x in current_progress(spark, progress).collect()}
    met = set(sent[:40])
    assert {c: x.n for c, x in first.items()} == {c: len([m for m in met if m[0] == c]) for c in first}
    for a in range(40, len(sent), 10):
        write(sent[a : a + 10])
    track_progress(spark, results, progress, checkpoint, files=2).awaitTermination()
    track_progress(spark, results, progress, checkpoint).awaitTermination()  # nothing new
    got = {x.config: tuple(x)[1:5] for x in current_progress(spark, progress).collect()}
    # the third configuration waits for its index 11
    assert got == {"c0": (30, 0, 30, 22), "c1": (30, 0, 30, 22), "c2": (11, 18, 29, 21)}
    left = spark.createDataFrame(rows, RESULTS).join(current_progress(spark, progress), "config").where(F.col("idx") >= F.col("next_idx"))
    assert left.count() == 18
    mean = sum(i for i in range(30) if i % 4) / 22 / 100
    assert abs(current_progress(spark, progress).where("config = 'c0'").first().avg_trace - mean) < 1e-6
