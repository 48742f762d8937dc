"""A Parquet table laid out by a hash of its key, changed by commits that rewrite only the partitions they touch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shotweave.sources.corpus import latest, upsert
from shotweave.sources.scratch import drop, stored

PART = "part_"


@dataclass
class KeyedTable:
    """The table at `path` with rows of `schema`, dealt over `parts` folders by a hash of the columns `by`.

    A commit first stores the new content of the touched folders, then overwrites these folders alone; the files of all others
    stay. If it fails in between, the same commit run again repairs it, since its result depends on the keys only. A commit with a
    batch id that is complete is not made again. Commits are made one after the other.
    """

    spark: SparkSession
    path: str
    schema: StructType
    by: list[str]
    parts: int = 64

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some folders; no rows before the first commit."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self.schema)
        kinds = StructType([*self.schema.fields]).add(PART, "integer")
        rows = self.spark.read.schema(kinds).parquet(self.path)
        return (rows if only is None else rows.where(F.col(PART).isin(only))).select(self.schema.names)

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.parts)).cast("int")

    def upsert(self, changes: DataFrame, keys: list[str], recency: list[str] | None = None, batch: str | None = None) -> bool:
        """Inserts or overwrites by `keys`, which hold the columns `by`; of several changes of a key the last by `recency` wins."""
        if set(self.by) - set(keys):
            raise ValueError("the keys of an upsert must hold the columns that the table is laid out by")
        return self._commit(changes, lambda old, new: upsert(old, new, keys, recency), batch)

    def append_new(self, rows: DataFrame, keys: list[str], batch: str | None = None) -> bool:
        """Adds one row of each key that the table has not."""
        return self._commit(rows, lambda old, new: old.unionByName(latest(new.join(old.select(keys), keys, "left_anti"), keys, [])), batch)

    def replace_for(self, rows: DataFrame, gone: DataFrame | None = None, batch: str | None = None) -> bool:
        """Deletes all rows of the keys `by` in `gone`, by default those of the new rows, and loads the new ones."""
        keys = (rows if gone is None else gone.unionByName(rows, allowMissingColumns=True)).select(self.by).distinct()
        same = lambda old: old.join(keys, self.by, "left_anti")
        return self._commit(rows, lambda old, new: same(old).unionByName(new), batch, keys)

    def _commit(self, rows: DataFrame, change, batch: str | None, keys: DataFrame | None = None) -> bool:
        done = f"{self.path}/_batches/{batch}"
        if batch is not None and self._exists(done):
            return False
        rows = stored(rows.select(self.schema.names))
        touched = sorted(r[0] for r in (rows if keys is None else keys).select(self.part().alias(PART)).distinct().collect())  # `parts` numbers at most
        if touched:
            new = change(self.read(touched), rows).select(*self.schema.names, self.part().alias(PART))
            new = stored(new.repartition(PART), instead=rows)
            left = {r[0] for r in new.select(PART).distinct().collect()}
            new.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
            for part in set(touched) - left:  # a folder that has no rows any more
                self._delete(f"{self.path}/{PART}={part}")
            drop(new)
        if batch is not None:
            self._files(done).create(self._at(done)).close()
        return True

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self, name: str):
        return self._at(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._files(name).exists(self._at(name))

    def _delete(self, name: str) -> None:
        self._files(name).delete(self._at(name), True)
