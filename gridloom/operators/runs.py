"""Statistics of whole runs of cells from running sums along the raster's rows.

Inside a polygon a row of cells is one run of equal coverage, so the sum of its
values is the difference of two running sums. A feature's sum is written as one
term for each place where its coverage changes: the change times the running
sum there. So what is shuffled and joined follows the outline of a feature and
not its area, and no inner cell of it is ever made.

Running sums begin anew every :data:`BLOCK` columns, so a wide row is dealt to
several tasks. Differences of sums can lose what larger values before them
cover: each feature carries a bound of that loss (from running sums of absolute
values), and a feature whose bound is over :data:`LOSS` of what it sums, or which
meets infinite values, is computed from its cells instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import cut

#: Columns after which running sums begin anew.
BLOCK = 1024
#: Share of a feature's absolute sum that rounding may be, by its bound.
LOSS = 1e-10
_ROUNDING = 2.0**-50

#: Statistics that sums of runs give.
RUN_STATS = ("count", "sum", "mean", "weighted_sum", "weighted_mean", "weighted_count", "weighted_fraction")


def changes(runs: DataFrame) -> DataFrame:
    """``fid, row, first, last, c`` -> ``fid, row, block, col, k, e``: where running sums are read, the coefficient of each, and that of a mere count of cells."""
    a, b = F.floor(F.col("first") / BLOCK).cast("int"), F.floor(F.col("last") / BLOCK).cast("int")
    pieces = runs.select("fid", "row", "first", "last", "c", F.explode(F.sequence(a, b)).alias("block"))
    low, high = F.greatest(F.col("first"), F.col("block") * BLOCK), F.least(F.col("last"), F.col("block") * BLOCK + BLOCK - 1)
    # nothing comes before a block's first column
    before = F.when(low > F.col("block") * BLOCK, F.struct((low - 1).alias("col"), (-F.col("c")).alias("k"), F.lit(False).alias("last")))
    ends = F.array(F.struct(high.alias("col"), F.col("c").alias("k"), F.lit(True).alias("last")), before)
    points = pieces.select("fid", "row", "block", F.explode(ends).alias("p")).where("p is not null")
    edge = F.when(F.col("p.last"), F.lit(1)).otherwise(F.lit(-1))
    return points.groupBy("fid", "row", "block", F.col("p.col").alias("col")).agg(F.sum("p.k").alias("k"), F.sum(edge).alias("e")).where("k <> 0 or e <> 0")


def _columns(weighted: bool) -> dict[str, Column]:
    """What is summed along a row: counts, sums and sums of absolute values; a missing weight counts apart, so that it spoils its own features only."""
    x, w = F.col("x").cast("double"), F.coalesce(F.col("w"), F.lit(0.0))
    out = {"n": F.lit(1.0), "s": x, "as": F.abs(x)}
    if weighted:
        # a weight of NaN is missing too
        w = F.when(F.isnan(w), F.lit(0.0)).otherwise(w)
        out |= {"nw": w, "anw": F.abs(w), "sw": x * w, "asw": F.abs(x * w), "gone": (F.col("w").isNull() | F.isnan("w")).cast("double")}
    return out


def run_sums(points: DataFrame, cells: DataFrame, weighted: bool) -> DataFrame:
    """``fid, n, s[, nw, sw], ok`` from :func:`changes` and cells ``row, col, x, w`` without missing values; features without a cell have no row."""
    columns = _columns(weighted)
    none = F.lit(None)
    values = cells.select("row", F.floor(F.col("col") / BLOCK).cast("int").alias("block"), "col", none.cast("bigint").alias("fid"), none.cast("double").alias("k"), none.cast("bigint").alias("e"), *[c.alias(n) for n, c in columns.items()])
    asked = points.select("row", "block", "col", "fid", "k", "e", *[none.cast("double").alias(n) for n in columns])
    # a place is read after the cell that stands there: null ids come first
    along = Window.partitionBy("row", "block").orderBy("col", F.col("fid").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    read = values.unionByName(asked).select("fid", "k", "e", *[F.coalesce(F.sum(n).over(along), F.lit(0.0)).alias(n) for n in columns]).where("fid is not null")
    absolute = [n for n in columns if n.startswith("a")]
    sums = [F.sum(F.col("k") * F.col(n)).alias(n) for n in columns]
    sums += [F.sum(F.abs("k") * F.col(n)).alias(f"{n}_read") for n in absolute]
    sums.append(F.sum(F.col("e") * F.col("n")).alias("cells"))
    if weighted:
        sums.append(F.sum(F.col("e") * F.col("gone")).alias("cells_gone"))
    out = read.groupBy("fid").agg(*sums).where("cells > 0")
    ok = F.lit(True)
    for n in absolute:
        ok = ok & ~F.isnan(n) & (F.col(f"{n}_read") * _ROUNDING <= F.abs(n) * LOSS) & (F.col(f"{n}_read") < float("inf"))
    if not weighted:
        return out.select("fid", "n", "s", ok.alias("ok"))
    spoilt = lambda n: F.when(F.col("cells_gone") > 0, F.lit(float("nan"))).otherwise(F.col(n)).alias(n)
    return out.select("fid", "n", "s", spoilt("nw"), spoilt("sw"), ok.alias("ok"))


def checked(sums: DataFrame, by_cells) -> DataFrame:
    """Sums that are sure, written once; those of the other features come from ``by_cells(ids)``, which is planned only where there are such."""
    sums = cut(sums, "zs-sums")
    unsure = sums.where("not ok").select("fid")
    sure = sums.where("ok").drop("ok")
    if not unsure.limit(1).count():
        return sure
    return sure.unionByName(by_cells(unsure).select(*sure.columns))
