"""Column functions over page boxes: structs of page, top, bottom, left, right."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(page: Column, top: Column, bottom: Column, left: Column, right: Column) -> Column:
    """The box of token arrays: the first token's page and the extremes of the coordinates."""
    return F.struct(F.get(page, F.lit(0)).alias("page"), F.array_min(top).alias("top"), F.array_max(bottom).alias("bottom"), F.array_min(left).alias("left"), F.array_max(right).alias("right"))


def _cross(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    # the intervals, 1.5 points shorter at either end, overlap
    return F.coalesce((low_a + 1.5 <= high_b - 1.5) & (low_b + 1.5 <= high_a - 1.5), F.lit(False))


def horz_aligned(a: Column, b: Column) -> Column:
    return _cross(a["top"], a["bottom"], b["top"], b["bottom"])


def vert_aligned(a: Column, b: Column) -> Column:
    return _cross(a["left"], a["right"], b["left"], b["right"])


def vert_aligned_left(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a["left"] - b["left"]) <= 2, F.lit(False))


def vert_aligned_right(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a["right"] - b["right"]) <= 2, F.lit(False))


def vert_aligned_center(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs((a["left"] + a["right"]) / 2 - (b["left"] + b["right"]) / 2) <= 5, F.lit(False))


def all_aligned(test: Callable[[Column, Column], Column], boxes: list[Column]) -> Column:
    """Every box passes a test with the first one, which has to pass it with itself: a sliver is aligned with nothing."""
    return reduce(lambda x, y: x & y, [test(b, boxes[0]) for b in boxes])


def same_page(boxes: list[Column]) -> Column:
    """All boxes are there and on one page."""
    return all_aligned(lambda a, b: F.coalesce(a["page"] == b["page"], F.lit(False)), boxes)


def page_vert_percentile(b: Column, page_height: float = 792) -> Column:
    return b["top"] / F.lit(float(page_height))


def page_horz_percentile(b: Column, page_width: float = 612) -> Column:
    return b["left"] / F.lit(float(page_width))
