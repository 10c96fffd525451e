from graphloom.operators import reach
from graphloom.streaming.incremental import GrowingClosure, follow

PAIRS = [
    ("kiln", "loom"), ("mill", "forge"), ("loom", "mill"), ("forge", "kiln"), ("well", "pump"), ("forge", "dock"),
    ("quay", "well"),
]


def test_stream_equals_batch(spark, tmp_path):
    seeds = spark.createDataFrame([("kiln", "kiln"), ("quay", "quay")], "root string, node string")
    where = f"file://{tmp_path}/state"
    for i, p in enumerate(PAIRS):
        spark.createDataFrame(
            [p], "src string, dst string",
        ).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/edges")
        if i % 2:
            # A process of its own each time: it finds the state and the checkpoint where they were.
            follow(spark, f"file://{tmp_path}/edges", GrowingClosure(seeds, where=where)).awaitTermination()
    growing = GrowingClosure(seeds, where=where)
    follow(spark, f"file://{tmp_path}/edges", growing).awaitTermination()
    whole = reach.closure(spark.createDataFrame(PAIRS, "src string, dst string"), seeds)
    want = sorted((r["root"], r["node"]) for r in whole.collect())
    assert sorted(tuple(r) for r in growing.nodes.collect()) == want
    done = growing.done()
    assert done == 3
    growing.add(spark.createDataFrame([("kiln", "zinc")], "src string, dst string"), 0)  # an epoch done before
    assert growing.nodes.count() == len(want) and growing.done() == done


def test_an_epoch_that_failed_halfway_is_done_again(spark, tmp_path):
    seeds = spark.createDataFrame([("a", "a")], "root string, node string")
    growing = GrowingClosure(
        seeds, spark.createDataFrame([("a", "b")], "src string, dst string"), f"file://{tmp_path}/s",
    )
    batch = spark.createDataFrame([("b", "c")], "src string, dst string")
    growing._write(batch, "edges", 0)  # the process ends before the nodes are written
    again = GrowingClosure(seeds, where=f"file://{tmp_path}/s")
    assert again.done() == -1 and again.edges.count() == 1
    again.add(batch, 0)
    assert {r["node"] for r in again.nodes.collect()} == {"a", "b", "c"} and again.edges.count() == 2
