"""A folder of stage tables, with the verbs that keep them up to date.

Tables are Parquet, written beside the old version and switched by a pointer file, so
that a stage may read the table it replaces. Rows are keyed by content, so applying a
stage twice leaves the table as applying it once does.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What has to go when a table's rows go, in order.
DEPENDENTS = {"documents": ["sentences"], "sentences": ["mentions"], "mentions": ["candidates"], "candidates": ["features", "labels", "marginals"]}


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _version(self, name: str) -> str | None:
        fs, place = self._fs(f"{self.root}/{name}.json")
        if not fs.exists(place):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(place.toString()).collect()))["version"]

    def read(self, name: str) -> DataFrame | None:
        version = self._version(name)
        return None if version is None else self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Replaces a table."""
        old, version = self._version(name), uuid.uuid4().hex
        path = f"{self.root}/{name}/{version}"
        df.write.parquet(path)
        fs, place = self._fs(f"{self.root}/{name}.json")
        stream = fs.create(place, True)
        stream.write(bytearray(json.dumps({"version": version}).encode()))
        stream.close()
        if old is not None:
            ofs, gone = self._fs(f"{self.root}/{name}/{old}")
            ofs.delete(gone, True)
        return self.spark.read.parquet(path)

    def append(self, name: str, df: DataFrame, keys: list[str]) -> DataFrame:
        """Adds the rows whose keys the table doesn't have."""
        old, new = self.read(name), df.dropDuplicates(keys)
        return self.write(name, new if old is None else old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True))

    def upsert(self, name: str, df: DataFrame, keys: list[str]) -> DataFrame:
        """Adds rows, in place of those with the same keys."""
        old, new = self.read(name), df.dropDuplicates(keys)
        return self.write(name, new if old is None else old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True))

    def clear(self, name: str, where: Column | None = None, docs: DataFrame | None = None) -> None:
        """Takes rows out of a table (all, those of ``where``, or those of some documents), and what depends on them."""
        table = self.read(name)
        if table is None:
            return
        if docs is not None:
            gone = table.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        else:
            gone = table if where is None else table.where(where)
        keys = [k for k in ("candidate_id", "doc_id") if k in table.columns][:1]
        lost = gone.select(*keys).distinct()
        for other in DEPENDENTS.get(name, []):
            self._cascade(other, lost, keys)
        if docs is not None:
            kept = table.join(docs.select("doc_id").distinct(), "doc_id", "left_anti")
        else:
            kept = table.limit(0) if where is None else table.where(~F.coalesce(where, F.lit(False)))
        self.write(name, kept)

    def _cascade(self, name: str, lost: DataFrame, keys: list[str]) -> None:
        table = self.read(name)
        if table is None or not set(keys) <= set(table.columns):
            return
        own = [k for k in ("candidate_id", "doc_id") if k in table.columns][:1]
        mine = table.join(lost, keys, "left_semi").select(*own).distinct()
        for other in DEPENDENTS.get(name, []):
            self._cascade(other, mine, own)
        self.write(name, table.join(lost, keys, "left_anti"))
