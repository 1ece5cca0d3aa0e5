"""Column functions over grid rectangles (row_start, row_end, col_start, col_end; ends included)."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

Range = tuple[Column, Column]


def _pair(a: Range, b: Range) -> Column:
    """Signed distance of the nearest members, first less second; 0 if the ranges overlap."""
    return F.when((a[0] <= b[1]) & (b[0] <= a[1]), F.lit(0)).when(a[1] < b[0], a[1] - b[0]).otherwise(a[0] - b[1])


def min_range_diff(ranges: list[Range], absolute: bool = True) -> Column:
    """The difference of least size between neighbours of a chain of ranges, over all choices of members.

    The closed form looks at each pair of neighbours alone. It is exact for two
    ranges and for absolute values; of signed differences that tie in size over
    three ranges or more, the first pair's is taken.
    """
    pairs = [_pair(a, b) for a, b in zip(ranges, ranges[1:])]
    sized = [F.abs(p) for p in pairs] if absolute else pairs
    return reduce(lambda x, y: F.when(F.abs(y) < F.abs(x), y).otherwise(x), sized)


def rows(cell: str | Column) -> Range:
    get = (lambda f: cell[f]) if isinstance(cell, Column) else (lambda f: F.col(f"{cell}.{f}" if cell else f))
    return get("row_start"), get("row_end")


def cols(cell: str | Column) -> Range:
    get = (lambda f: cell[f]) if isinstance(cell, Column) else (lambda f: F.col(f"{cell}.{f}" if cell else f))
    return get("col_start"), get("col_end")


def min_row_diff(cells: list, absolute: bool = True) -> Column:
    return min_range_diff([rows(c) for c in cells], absolute)


def min_col_diff(cells: list, absolute: bool = True) -> Column:
    return min_range_diff([cols(c) for c in cells], absolute)


def min_axis_diff(a, b, axis: str | None = None, absolute: bool = True) -> Column:
    if axis == "row":
        return min_row_diff([a, b], absolute)
    if axis == "col":
        return min_col_diff([a, b], absolute)
    r, c = min_row_diff([a, b], absolute), min_col_diff([a, b], absolute)
    return F.least(r, c)


def is_row_aligned(a, b, spread: tuple[int, int] = (0, 0)) -> Column:
    """Rows apart by ``spread[0]`` to ``spread[1]``, in either direction."""
    return min_row_diff([a, b]).between(*spread)


def is_col_aligned(a, b, spread: tuple[int, int] = (0, 0)) -> Column:
    return min_col_diff([a, b]).between(*spread)


def is_axis_aligned(a, b, axis: str | None = None, spread: tuple[int, int] = (0, 0)) -> Column:
    if axis == "row":
        return is_row_aligned(a, b, spread)
    if axis == "col":
        return is_col_aligned(a, b, spread)
    return is_row_aligned(a, b, spread) | is_col_aligned(a, b, spread)


def num_rows(cell, correct: bool = False) -> Column:
    """Rows that a cell spans. As known from the feature keys this engine matches, the sign of
    the difference is turned round (a span of 3 gives -1) unless ``correct``."""
    start, end = rows(cell)
    return end - start + 1 if correct else start - end + 1


def num_cols(cell, correct: bool = False) -> Column:
    start, end = cols(cell)
    return end - start + 1 if correct else start - end + 1


def same(values: list[Column]) -> Column:
    """All equal and none null."""
    return F.coalesce(reduce(lambda x, y: x & y, [values[0].isNotNull(), *(v == values[0] for v in values[1:])]), F.lit(False))


def same_table(args: list[Column]) -> Column:
    """All arguments lie in one table of their document."""
    return same([a["table_pos"] for a in args])


def same_cell(args: list[Column]) -> Column:
    return same_table(args) & same([a["cell_pos"] for a in args])


def _all(args: list[Column], test) -> Column:
    """One table, and every argument passes the test with the first."""
    return reduce(lambda x, y: x & y, [same_table(args), *(F.coalesce(test(a, args[0]), F.lit(False)) for a in args)])


def same_row(args: list[Column]) -> Column:
    """One table, and every argument has a row in common with the first."""
    return _all(args, is_row_aligned)


def same_col(args: list[Column]) -> Column:
    return _all(args, is_col_aligned)


def is_tabular_aligned(args: list[Column]) -> Column:
    """One table, and every argument has a row or a column in common with the first."""
    return _all(args, is_axis_aligned)


def min_row(arg: Column) -> Column:
    """The first row that a mention's cell takes up; null outside tables. Of a candidate, its first argument's is asked."""
    return arg["row_start"]


def max_row(arg: Column) -> Column:
    """The last row. Of a candidate, its last argument's is asked."""
    return arg["row_end"]


def min_col(arg: Column) -> Column:
    return arg["col_start"]


def max_col(arg: Column) -> Column:
    return arg["col_end"]


def enumerate_diff(starts_ends: list[tuple[int, int]], absolute: bool = True) -> int:
    """The distance by enumeration, as the closed form's check."""
    diffs = lambda t: [abs(x - y) if absolute else x - y for x, y in zip(t, t[1:])]
    return min((d for t in product(*(range(a, b + 1) for a, b in starts_ends)) for d in diffs(t)), key=abs)
