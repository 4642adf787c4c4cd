"""Streams with state: timers, restarts, and files that are offered again."""

import time

from vellumite.streaming import sessions


def wait(done, query, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end and not query.exception():
        time.sleep(0.3)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


CHOICE = "session long, generation long, level int, ended boolean"


def test_debounce_over_a_restart(spark, tmp_path):
    """A choice that waits when the query is stopped is let through after the restart, once; older generations are dropped."""
    put(spark, tmp_path / "in", [(1, 1, 0, False), (1, 3, 2, False), (1, 2, 1, False), (2, 7, 4, False), (3, 1, 1, False), (3, 2, None, True)], CHOICE)
    stream = lambda: sessions.debounced(spark.readStream.schema(CHOICE).parquet(str(tmp_path / "in")), 6000)
    with sessions.state_store(spark):  # reads all, and is stopped before the timers
        first = stream().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="100 milliseconds").start()
    wait(lambda: any(p["numInputRows"] for p in first.recentProgress), first)
    first.stop()
    put(spark, tmp_path / "in", [(1, 2, 9, False), (2, 8, 3, False)], CHOICE)
    with sessions.state_store(spark):
        out = stream().writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
    read = lambda: sorted(tuple(r) for r in spark.read.schema(sessions.Debounce.SCHEMA).parquet(str(tmp_path / "out")).collect()) if (tmp_path / "out").exists() else []
    wait(lambda: {(1, 3, 2), (2, 8, 3)} <= set(read()), out)
    time.sleep(3)
    out.stop()
    got = read()
    # the restart may take longer than the choice of session 2 waits
    assert {(1, 3, 2), (2, 8, 3)} <= set(got) <= {(1, 3, 2), (2, 7, 4), (2, 8, 3)} and len(got) == len(set(got))


def test_files_are_taken_once(spark, tmp_path):
    """A file that is listed again, in one batch or after a restart, is handled once; a changed one again."""
    schema, met = "path string, length long, modified long", []
    handle = lambda df, n: met.extend(tuple(r) for r in df.collect())
    for rows in ([("a", 1, 5), ("b", 2, 5), ("a", 1, 5)], [("a", 1, 5), ("c", 3, 5)], [("a", 9, 6), ("c", 3, 5)]):
        put(spark, tmp_path / "in", rows, schema)
        sessions.each_new(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "check"), handle).awaitTermination()
    assert sorted(met) == [("a", 1, 5), ("a", 9, 6), ("b", 2, 5), ("c", 3, 5)]


def test_phases_are_remembered(spark, tmp_path):
    schema, met = "session long, place long, phase string, url string", []
    batches = [[(1, 1, None, "file:///a"), (1, 2, "working", None), (1, 3, None, "file:///b"), (2, 1, None, "https://x")], [(1, 4, None, "FILE:///c"), (1, 5, "done", None), (1, 6, None, "file:///d")]]
    for rows in batches:
        put(spark, tmp_path / "in", rows, schema)
        with sessions.state_store(spark):
            q = sessions.taken_offers(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(lambda df, n: met.extend(tuple(r) for r in df.collect()))
            q.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(met) == [(1, 1, "file:///a"), (1, 6, "file:///d")]
