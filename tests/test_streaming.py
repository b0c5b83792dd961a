"""A streamed feed gives the batch answer, whatever the order of arrival."""

from palimpsest.operators.history import visible
from palimpsest.store import Store
from palimpsest.streaming.latest import ingest, latest_updates, live

SCHEMA = "key string, seq long, kind int, value string"


def feed(spark, path):
    rows = [(f"k{n % 7}", n + 1, 2 if n % 5 == 0 else 1, None if n % 5 == 0 else str(n)) for n in range(60)]
    h = spark.createDataFrame(rows, SCHEMA)
    for part in (2, 0, 1):  # later versions arrive first
        h.filter(f"seq % 3 = {part}").coalesce(1).write.mode("append").parquet(path)
    return h, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_latest_in_complete_mode(spark, tmp_path):
    h, stream = feed(spark, str(tmp_path / "feed"))
    q = live(stream).writeStream.outputMode("complete").format("memory").queryName("live_pairs").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r["key"], r["seq"], r["value"]) for r in visible(h).collect()}
    assert {(r["key"], r["seq"], r["value"]) for r in spark.table("live_pairs").collect()} == want


def test_latest_with_state(spark, tmp_path):
    h, stream = feed(spark, str(tmp_path / "feed"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {}

    def keep(batch, _):
        got.update({r["key"]: (r["seq"], r["kind"]) for r in batch.collect()})

    q = latest_updates(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {k for k, (_, kind) in got.items() if kind == 1} == {r["key"] for r in visible(h).collect()}


def test_ingest_into_a_store(spark, tmp_path):
    h, stream = feed(spark, str(tmp_path / "feed"))
    store = Store(spark, str(tmp_path / "s"))
    ready = stream.filter("seq % 3 = 0").selectExpr("seq as op_index", "kind", "key", "value")
    ingest(ready, store, str(tmp_path / "c")).awaitTermination(120)
    want = {r["key"]: r["value"] for r in visible(h.filter("seq % 3 = 0")).collect()}
    got = {bytes(r["key"]).decode(): bytes(r["value"]).decode() for r in store.scan(b"k").collect()}
    assert got == want
