"""Capture keeps the ids of the clock skew only, and loses nothing that comes later."""

from palimpsest.streaming import capture

SCHEMA = "conv_id long, turn long, role string, text string"


def rows(conversations):
    return [(c, t, "user", f"{c} {t}") for c in conversations for t in range(3)]


def test_state_is_bounded_and_late_rows_are_swept(spark, tmp_path):
    source, out = f"file://{tmp_path}/entries", f"file://{tmp_path}/out"
    # ten minutes apart, five minutes of skew; the last parts come far too late and twice
    parts = [[n] for n in range(4)] + [[0, 20], [1, 1, 21]]
    for n, conversations in enumerate(parts):
        spark.createDataFrame(rows(conversations), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        got = capture.run_capture(spark, source, spark.read.parquet(source).schema, out)
        seen = {c for part in parts[: n + 1] for c in part}
        assert sorted(r.id for r in got.collect()) == sorted(f"ep-{c}-{t}" for c in seen for t in range(3))
    spark.createDataFrame(rows([40]), SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    query = capture.deduplicated(stream).writeStream.foreachBatch(lambda batch, number: batch.collect()).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held and max(held) <= 6
