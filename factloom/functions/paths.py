"""Column functions over element paths such as ``/html/body/div[2]/p``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(path: Column) -> Column:
    """The steps of a path, the empty one before the root included."""
    return F.split(path, "/", -1)


def common_ancestor(*paths: Column) -> Column:
    """The longest common prefix of paths' steps, positions included."""
    out = steps(paths[0])
    for p in paths[1:]:
        y = steps(p)
        same = F.zip_with(out, y, lambda i, j: F.coalesce(i == j, F.lit(False)))
        first = F.array_position(same, False)
        out = F.slice(out, F.lit(1), F.when(first == 0, F.least(F.size(out), F.size(y))).otherwise(first - 1).cast("int"))
    return out


def lowest_common_ancestor_depth(*paths: Column) -> Column:
    """How far the nearest of some elements lies below their lowest common ancestor."""
    sizes = [F.size(steps(p)) for p in paths]
    return (F.least(*sizes) if len(sizes) > 1 else sizes[0]) - F.size(common_ancestor(*paths))


def ancestor_tags(path: Column) -> Column:
    """Tags from the root down to the element itself."""
    return F.filter(F.split(F.regexp_replace(path, r"\[\d+\]", ""), "/"), lambda x: x != "")
