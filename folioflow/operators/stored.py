"""Tables that are kept up by deltas: rows in parts by a hash of their key, of which a change rewrites only those that it touches.

The rows of a change are written beside the table first and then replace the partitions that they belong to (dynamic partition overwrite). A change is told by
what its rows are, not by when it comes, so one that was cut short, or comes twice, leaves the same table as one that comes once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.history import head_events
from folioflow.session import cut

PARTS = 16
HEADS = "document_id long, branch string, version_id long, valid_from long, event_type string, valid_to long"


class StoredTable:
    """Rows of schema in a folder that all executors see; keys are the columns that a change goes by, and are not null."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str, parts: int = PARTS):
        self.spark, self.folder, self.keys, self.parts = spark, folder.rstrip("/"), keys, parts
        self.schema = f"{schema}, _part int, _row boolean"
        self.columns = spark.createDataFrame([], schema).columns

    def create(self) -> StoredTable:
        """The table without rows, instead of what the folder holds."""
        self._write(self.spark.createDataFrame([], self.schema), list(range(self.parts)))
        return self

    def _part(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder).where("_row")

    def read(self) -> DataFrame:
        return self._all().select(self.columns)

    def _write(self, rows: DataFrame, touched: list[int]) -> None:
        # each touched part has a row that says nothing, so that one that is empty now is replaced, too
        marks = self.spark.createDataFrame([(p, False) for p in touched], "_part int, _row boolean")
        rows.unionByName(marks, allowMissingColumns=True).repartition("_part").write.partitionBy("_part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.folder)

    def fold(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], keys: DataFrame | None = None) -> StoredTable:
        """The rows of incoming's keys (or of keys) become merge(what is stored of them, incoming); all others stay, most of them unread."""
        asked = cut((incoming if keys is None else keys).select(self.keys).dropna().distinct().withColumn("_part", self._part()))
        touched = [r["_part"] for r in asked.select("_part").distinct().collect()]  # at most parts numbers
        if not touched:
            return self
        held, own = self._all().where(F.col("_part").isin(touched)), asked.select(self.keys)
        new = merge(held.join(own, self.keys, "left_semi").select(self.columns), incoming).select(self.columns)
        placed = new.withColumn("_part", self._part()).withColumn("_row", F.lit(True))
        self._write(cut(held.join(own, self.keys, "left_anti").unionByName(placed)), touched)
        return self

    def replace(self, incoming: DataFrame, keys: DataFrame | None = None) -> StoredTable:
        """All rows of incoming's keys go and incoming comes; of keys that incoming has no rows for, all rows go."""
        return self.fold(incoming, lambda _, new: new, keys)


class StoredHistory(StoredTable):
    """Head events with their intervals, kept up as saves and deletes come, in any order and any number of times."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        super().__init__(spark, folder, ["document_id"], HEADS, parts)

    def save(self, events: DataFrame) -> StoredHistory:
        """events (document_id, branch, version_id, valid_from, event_type): a version that is stored stays as it is; its branch's intervals are told anew."""

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            one = ["document_id", "branch", "version_id"]
            fresh = new.dropDuplicates(one).join(old.select(one), one, "left_anti")
            return head_events(old.drop("valid_to").unionByName(fresh.select(old.drop("valid_to").columns)))

        return self.fold(events, merge)

    def sink(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch; a batch that is handed over again changes nothing."""
        self.save(batch)
