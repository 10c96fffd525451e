"""Reachability over edges that arrive as a stream.

New edge files are read with readStream; each micro-batch extends a stored closure by
what the new edges add, so that old levels aren't walked again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reach
from ..plans.storage import fresh_path, settle


class GrowingClosure:
    """The nodes (root, node) that roots reach over all edges seen so far.

    The state is kept in `where`, what each epoch adds in a folder of its own, so a batch writes only what is
    new, and a process that starts again with the same folder goes on where the last finished epoch ended.
    """

    def __init__(self, seeds: DataFrame, edges: DataFrame | None = None, where: str | None = None):
        self.spark: SparkSession = seeds.sparkSession
        self.where = (where or fresh_path(self.spark, "closure")).rstrip("/")
        self.schema = {"edges": "src string, dst string", "nodes": "root string, node string"}
        if self.done() is None:
            first = edges.select("src", "dst").distinct() if edges is not None else self.spark.createDataFrame(
                [], self.schema["edges"],
            )
            self._write(first, "edges", -1)
            self._write(reach.closure(self._read("edges", -1), seeds).select("root", "node"), "nodes", -1)

    def _folder(self, what: str, epoch: int) -> str:
        return f"{self.where}/{what}/{epoch + 1:012}"

    def _write(self, df: DataFrame, what: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(self._folder(what, epoch))

    def _epochs(self, what: str) -> list[int]:
        """Epochs that are written as a whole."""
        spark = self.spark
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.where}/{what}/*/_SUCCESS")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(s.getPath().getParent().getName()) - 1 for s in found or ())

    def done(self) -> int | None:
        """The last finished epoch; nodes are written after the edges."""
        return max(self._epochs("nodes"), default=None)

    def _read(self, what: str, upto: int) -> DataFrame:
        kept = [self._folder(what, e) for e in self._epochs(what) if e <= upto]
        return self.spark.read.schema(self.schema[what]).parquet(*kept)

    @property
    def edges(self) -> DataFrame:
        return self._read("edges", self.done())

    @property
    def nodes(self) -> DataFrame:
        return self._read("nodes", self.done())

    def add(self, batch: DataFrame, epoch: int) -> None:
        """Idempotent for an epoch that is given again after a failure."""
        before = self.done()
        if epoch <= before:
            return
        known = self._read("nodes", before)
        new = batch.select("src", "dst").distinct().join(self._read("edges", before), ["src", "dst"], "left_anti")
        self._write(new, "edges", epoch)
        new, every = self.spark.read.parquet(self._folder("edges", epoch)), self._read("edges", epoch)
        # Only nodes that a new edge leads out of the known ones start the search.
        starts = known.join(new, known["node"] == new["src"]).select("root", F.col("dst").alias("node")).distinct()
        starts = settle(starts.join(known, ["root", "node"], "left_anti"))
        more = starts if starts.isEmpty() else reach.closure(every, starts).select("root", "node").distinct().join(
            known, ["root", "node"], "left_anti",
        )
        self._write(more, "nodes", epoch)


def follow(spark: SparkSession, path: str, growing: GrowingClosure, schema: str = "src string, dst string", **trigger):
    """Start a query that feeds new Parquet files of edges under path to growing; its checkpoint stands beside the state."""
    stream = spark.readStream.schema(schema).parquet(path)
    writer = stream.writeStream.foreachBatch(growing.add).option("checkpointLocation", f"{growing.where}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
