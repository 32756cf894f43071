import datetime as dt

from spanforge.operators import chunking
from spanforge.streaming.ingest import ingest_chunks


def test_ingestion_is_incremental_and_drops_repeats(spark, tmp_path):
    schema = "id string, text string, loaded_at timestamp"
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    at = dt.datetime(2026, 3, 1)

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = ingest_chunks(spark.readStream.schema(schema).parquet(source), lambda d: chunking.chunk_fixed(d, 10), out, state)
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r["source_id"], r["start"]) for r in spark.read.parquet(out).collect())

    assert deliver([("a", "x" * 25, at), ("a", "x" * 25, at), ("b", None, at), (None, "y", at)]) == [("a", 0), ("a", 10), ("a", 20)]
    assert deliver([("a", "x" * 25, at), ("c", "short", at)]) == [("a", 0), ("a", 10), ("a", 20), ("c", 0)]


def test_positions_are_unique_for_equal_and_distant_times(spark, tmp_path):
    schema = "id string, text string, loaded_at timestamp"
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def deliver(rows):
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(source)
        q = ingest_chunks(spark.readStream.schema(schema).parquet(source), lambda d: chunking.chunk_fixed(d, 10), out, state)
        q.awaitTermination(120)
        assert q.exception() is None

    start = dt.datetime(2026, 3, 1)
    deliver([(f"a{i}", "x" * 25, start) for i in range(5)])
    deliver([("b", "y" * 5, start + dt.timedelta(hours=100)), ("c", "z" * 5, start + dt.timedelta(hours=1))])
    rows = {r["chunk_pos"]: r["source_id"] for r in spark.read.parquet(out).collect()}
    assert len(rows) == 17
    order = [rows[p] for p in sorted(rows)]
    assert [x for i, x in enumerate(order) if i == 0 or order[i - 1] != x] == ["a0", "a1", "a2", "a3", "a4", "c", "b"]
