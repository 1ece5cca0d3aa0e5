"""Documents that keep arriving: the same stages, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from factloom.plans.store import Store

Stage = Callable[[DataFrame], DataFrame]


def run_batch(store: Store, docs: DataFrame, stages: list[tuple[str, Stage, list[str]]]) -> None:
    """Takes documents through (table, stage, keys) in turn. Rows known by their keys are left alone, so a batch that comes twice changes nothing."""
    current = store.append("documents", docs, ["doc_id"]).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    for name, stage, keys in stages:
        made = stage(current)
        current = store.append(name, made, keys).join(made.select(*keys).distinct(), keys, "left_semi")


def start(stream: DataFrame, store: Store, stages: list[tuple[str, Stage, list[str]]], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``run_batch`` on every micro-batch of a stream of documents; with ``once``, on what is there, and stops."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: run_batch(store, batch, stages)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
