"""Helpers that the corpus operators share: column hygiene and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the context's checkpoint folder, or the session's ``spark.checkpoint.dir``.

    Where neither is set, a temporary folder serves a local session, as in tests; on
    a cluster, whose machines don't share theirs, that is an error.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="factloom-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage.

    The files are replicated storage, so a lost executor costs no recomputation,
    and Spark's cleaner removes them with the last reference to the plan.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that start with the given stems and clash with nothing in ``df``."""
    taken, names = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(df: DataFrame, name: str) -> Column:
    """An id column as longs. Ids are integers to every operator here: another type is a ``TypeError`` at once, not a failing task."""
    kind = next(f.dataType.typeName() for f in df.schema.fields if f.name == name)
    if kind not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"{name} holds {kind}s; ids are integers here")
    return col(name).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
