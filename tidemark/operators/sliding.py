"""Aggregates over long sliding windows with work in proportion to samples and points, not to their product.

A sample first counts at grid point i, the first at or after it, and last at i + K or i + K - 1, where K is the whole
steps in the width: the later part of a cell (samples with the same i), within width - K steps of the point, reaches one
point further. So the window of point n holds the cells n - K + 1 to n and the later part of cell n - K.

Cells are cut into blocks of K. Cells n - K + 1 to n are the end of one block and the beginning of the next, so running
aggregates from both ends of each block give every window from three parts at most: the later part, a suffix and a
prefix. Only parts of the window are ever combined and nothing is taken away again, so neither NaN nor infinity of one
window reaches another. Nor does rounding, but for the spread, whose error is relative to the block's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.grid import Grid


@dataclass(frozen=True)
class Parts:
    """cell: aggregates of samples; a part's columns have the same names. value: of the parts l, s, p of a window.

    running gives from cells and a window (in the order of time or against it) the columns of prefixes or suffixes; it
    may first add columns to the cells.
    """

    cell: dict[str, Column]
    running: Callable[[DataFrame, Callable[[int, int], Window], bool], tuple[DataFrame, dict[str, Column]]]
    value: Callable[[Callable[[str], Column], Callable[[str], Column], Callable[[str], Column]], Column]


def commutative(cell: dict[str, Column], join: dict[str, Callable[[Column], Column]], pair: Callable[[Column, Column], Column], value: Callable[[Callable[[str], Column]], Column]) -> Parts:
    """Parts that are combined column by column, in any order; pair ignores a null."""

    def running(cells: DataFrame, over, forward: bool) -> tuple[DataFrame, dict[str, Column]]:
        return cells, {c: f(F.col(c)).over(over(Window.unboundedPreceding, 0)) for c, f in join.items()}

    return Parts(cell, running, lambda l, s, p: value(lambda c: pair(pair(l(c), s(c)), p(c))))


def plus(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def sums(cell: dict[str, Column], value: Callable[[Callable[[str], Column]], Column]) -> Parts:
    return commutative(cell, dict.fromkeys(cell, F.sum), plus, value)


def spread(value: Column) -> Parts:
    """The population standard deviation from count, mean and squared deviations; a block is shifted by its own mean."""
    cell = {"c": F.count(value).cast("double"), "m": F.avg(value), "d": F.var_pop(value) * F.count(value)}

    def running(cells: DataFrame, over, forward: bool) -> tuple[DataFrame, dict[str, Column]]:
        sane = F.when(~F.isnan("m") & (F.abs("m") < float("inf")), F.col("m"))
        cells = cells.withColumn("_shift", F.coalesce(F.avg(sane).over(over(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)))
        off, whole = F.col("m") - F.col("_shift"), over(Window.unboundedPreceding, 0)
        n, s = F.sum("c").over(whole), F.sum(F.col("c") * off).over(whole)
        q = F.sum(F.col("d") + F.col("c") * off * off).over(whole)
        return cells, {"c": n, "m": F.col("_shift") + s / n, "d": F.greatest(q - s * s / n, F.lit(0.0))}

    def merged(l, s, p) -> Column:
        parts = [(x("c"), x("m"), x("d")) for x in (l, s, p)]
        n = sum((F.coalesce(c, F.lit(0.0)) for c, _, _ in parts), F.lit(0.0))
        mean = sum((F.coalesce(c * m, F.lit(0.0)) for c, m, _ in parts), F.lit(0.0)) / n
        squares = sum((F.coalesce(d + c * (m - mean) * (m - mean), F.lit(0.0)) for c, m, d in parts), F.lit(0.0))
        return F.sqrt(squares / n)

    return Parts(cell, running, merged)


def climbs(up: Column, first: Column) -> Parts:
    """The sum of up over the samples of a window but the first, whose step comes from outside; null for one sample.

    up is zero for a sample without one before; first tells the earliest sample of each half of a cell. f is the step
    of the earliest sample of a part, r the sum of the others.
    """
    cell = {"c": F.count("*").cast("double"), "f": F.max(F.when(first, up)), "r": F.coalesce(F.sum(F.when(~first, up)), F.lit(0.0))}

    def running(cells: DataFrame, over, forward: bool) -> tuple[DataFrame, dict[str, Column]]:
        whole = over(Window.unboundedPreceding, 0)
        count, all_of = F.sum("c").over(whole), F.col("f") + F.col("r")
        if forward:
            cells = cells.withColumn("_k", F.count("f").over(whole))
            cells = cells.withColumn("_x", F.when(F.col("_k") == 1, F.col("r")).otherwise(all_of))
            return cells, {"c": count, "f": F.first("f", ignorenulls=True).over(whole), "r": F.sum("_x").over(whole)}
        cells = cells.withColumn("_later", F.coalesce(F.sum(all_of).over(over(Window.unboundedPreceding, -1)), F.lit(0.0)))
        cells = cells.withColumn("_x", F.when(F.col("f").isNotNull(), F.col("_later") + F.col("r")))
        return cells, {"c": count, "f": F.last("f", ignorenulls=True).over(whole), "r": F.last("_x", ignorenulls=True).over(whole)}

    def value(l, s, p) -> Column:
        n = plus(plus(l("c"), s("c")), p("c"))
        total = l("r")
        for before, x in (((l,), s), ((l, s), p)):
            any_before = F.lit(False)
            for b in before:
                any_before = any_before | b("c").isNotNull()
            total = plus(total, F.when(any_before, x("f") + x("r")).otherwise(x("r")))
        return F.when(n >= 2, total)

    return Parts(cell, running, value)


def cell_of(ts: Column, grid: Grid, width: int) -> tuple[Column, Column]:
    """The first point at or after ts, and whether the sample is in the later half of that cell."""
    i = F.ceil((ts - grid.start) / F.lit(grid.step)).cast("long")
    return i, (F.lit(grid.start) + i * F.lit(grid.step) - ts) <= width % grid.step


def over_blocks(rows: DataFrame, keys: list[str], grid: Grid, width: int, parts: Parts) -> DataFrame:
    """(keys, n, value) of each window [t - width, t] that holds a sample of rows (keys, ts, …); width is a step at least."""
    whole = width // grid.step
    i, late = cell_of(F.col("ts"), grid, width)
    halves = rows.withColumns({"i": i, "late": late}).groupBy(*keys, "i", "late").agg(*[c.alias(n) for n, c in parts.cell.items()])
    halves = halves.withColumn("b", F.floor(F.col("i") / F.lit(whole)).cast("long"))
    # a block has a row for each half of a cell, the early one first, and a blank one after each place, where its result is read
    begin = F.col("b") * F.lit(whole)
    blanks = halves.select(*keys, "b").distinct().select(*keys, F.explode(F.sequence(begin, begin + (whole - 1))).alias("i"), "b")
    dense = halves.unionByName(blanks, allowMissingColumns=True)

    def running(forward: bool) -> DataFrame:
        half = F.col("late").cast("int") if forward else 1 - F.col("late").cast("int")
        order = [F.col("i").asc() if forward else F.col("i").desc(), F.coalesce(half, F.lit(2)).asc()]

        def over(begin: int, end: int):
            block = Window.partitionBy(*keys, "b")
            return block if end == Window.unboundedFollowing else block.orderBy(*order).rowsBetween(begin, end)

        cells, found = parts.running(dense, over, forward)
        done = cells.select(*keys, "i", "late", "b", F.struct(*[c.alias(n) for n, c in found.items()]).alias("x"))
        done = done.where(F.col("late").isNull() & F.col(f"x.{next(iter(found))}").isNotNull())
        if forward:
            return done.select(*keys, F.col("i").alias("n"), F.lit("p").alias("part"), "x")
        # the suffix from a block's own beginning is all of it, which the last prefix is too
        done = done.where(F.col("i") > F.col("b") * F.lit(whole))
        return done.select(*keys, (F.col("i") + (whole - 1)).alias("n"), F.lit("s").alias("part"), "x")

    later = halves.where("late").select(*keys, (F.col("i") + whole).alias("n"), F.lit("l").alias("part"), F.struct(*parts.cell).alias("x"))
    every = later.union(running(False)).union(running(True)).where(F.col("n").between(0, grid.points - 1))
    joined = every.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("part") == p, F.col("x"))).alias(p) for p in "lsp"])
    value = parts.value(*[lambda c, p=p: F.col(f"{p}.{c}") for p in "lsp"])
    return joined.select(*keys, "n", value.alias("value")).where("value is not null")
