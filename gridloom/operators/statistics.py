"""The built-in statistics as Catalyst aggregates over joined cells.

Input is ``fid, row, col, c, x, w``: coverage (double), value (cell type) and
weight (double). Statistics of one kind share one aggregation: scalars in one
``groupBy(fid)``, the variance family in one more with the means joined back,
value counts in ``groupBy(fid, x)``, arrays in one sorted list.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import cut, drop_cut

NAN = float("nan")

SCALAR = ("count", "sum", "mean", "min", "max", "weighted_sum", "weighted_mean", "weighted_count", "weighted_fraction", "min_center_x", "min_center_y", "max_center_x", "max_center_y")
MOMENT = ("variance", "stdev", "coefficient_of_variation", "weighted_variance", "weighted_stdev")
HISTOGRAM = ("mode", "majority", "minority", "variety", "unique", "frac", "weighted_frac")
QUANTILE = ("median", "quantile")
ARRAY = ("values", "coverage", "weights", "cell_id", "center_x", "center_y")
#: Statistics that one category of cells has: argument ``v``.
CATEGORY = ("count_of", "frac_of", "weighted_count_of", "weighted_frac_of")
ALL = (*SCALAR, *MOMENT, *HISTOGRAM, *QUANTILE, *ARRAY, *CATEGORY)

#: Result for a feature without cells.
EMPTY = {"count": 0.0, "sum": 0.0, "weighted_sum": 0.0, "weighted_count": 0.0, "variety": 0} | {s: NAN for s in ("mean", "weighted_mean", "weighted_fraction", *MOMENT, "min_center_x", "min_center_y", "max_center_x", "max_center_y")} | {"count_of": 0.0, "weighted_count_of": 0.0, "frac_of": NAN, "weighted_frac_of": NAN}
NEEDS_WEIGHT = tuple(s for s in ALL if s.startswith("weight"))


def result_type(stat: str, scalar: str) -> str:
    """Spark type of a result column, given that of the raster's scalars."""
    if stat in ("min", "max", "mode", "majority", "minority", "median", "quantile"):
        return scalar
    if stat in ("values", "unique"):
        return f"array<{scalar}>"
    if stat in ("coverage", "weights", "center_x", "center_y", "frac", "weighted_frac"):
        return "array<double>"
    return {"variety": "bigint", "cell_id": "array<bigint>"}.get(stat, "double")


def fill(stat: str, column: Column, kind: str) -> Column:
    """A result column with the value for features without cells, in its type."""
    column = column.cast(kind)
    if kind.startswith("array"):
        return F.coalesce(column, F.array().cast(kind))
    return F.coalesce(column, F.lit(EMPTY[stat]).cast(kind)) if stat in EMPTY else column


def _ratio(a: Column, b: Column, when: Column) -> Column:
    return F.when(when, a / F.nullif(b, F.lit(0.0))).otherwise(F.lit(NAN))


def _x() -> Column:
    return F.col("x").cast("double")


def scalar_sums() -> dict[str, Column]:
    """Sums that scalar statistics are made of."""
    return {"n": F.sum("c"), "s": F.sum(_x() * F.col("c")), "nw": F.sum(F.col("c") * F.col("w")), "sw": F.sum(_x() * F.col("c") * F.col("w"))}


def scalar(stat: str, cx: Column, cy: Column) -> tuple[dict[str, Column], Callable[[], Column]]:
    """Aggregates that a scalar statistic needs, and the result from them."""
    sums = scalar_sums()
    pick = lambda *names: {k: sums[k] for k in names}
    n, s, nw, sw = (F.col(k) for k in ("n", "s", "nw", "sw"))
    first = F.struct("x", "row", "col")
    last = F.struct("x", -F.col("row"), -F.col("col"))
    return {
        "count": (pick("n"), lambda: n),
        "sum": (pick("s"), lambda: s),
        "mean": (pick("n", "s"), lambda: _ratio(s, n, n > 0)),
        "min": ({"lo": F.min("x")}, lambda: F.col("lo")),
        "max": ({"hi": F.max("x")}, lambda: F.col("hi")),
        "weighted_sum": (pick("sw"), lambda: sw),
        "weighted_count": (pick("nw"), lambda: nw),
        "weighted_mean": (pick("nw", "sw"), lambda: _ratio(sw, nw, nw != 0)),
        "weighted_fraction": (pick("s", "sw"), lambda: _ratio(sw, s, s != 0)),
        "min_center_x": ({"lox": F.min_by(cx, first)}, lambda: F.col("lox")),
        "min_center_y": ({"loy": F.min_by(cy, first)}, lambda: F.col("loy")),
        "max_center_x": ({"hix": F.max_by(cx, last)}, lambda: F.col("hix")),
        "max_center_y": ({"hiy": F.max_by(cy, last)}, lambda: F.col("hiy")),
    }[stat]


def moments(cells: DataFrame, stats: set[str]) -> DataFrame:
    """Two passes: means by feature, then squares about them, so nothing cancels."""
    weighted = any(s.startswith("weighted") for s in stats)
    sums = {k: v for k, v in scalar_sums().items() if weighted or k in ("n", "s")}
    means = cells.groupBy("fid").agg(*[v.alias(k) for k, v in sums.items()])
    mu = [_ratio(F.col("s"), F.col("n"), F.col("n") > 0).alias("mu")]
    if weighted:
        mu.append(_ratio(F.col("sw"), F.col("nw"), F.col("nw") != 0).alias("muw"))
    both = cells.join(means.select("fid", *mu), "fid")
    c, cw = F.col("c"), F.col("c") * F.col("w")
    out = [F.first("mu").alias("mu"), _ratio(F.sum(c * (_x() - F.col("mu")) ** 2), F.sum(c), F.sum(c) > 0).alias("var")]
    if weighted:
        # a weight of zero counts for nothing, even beside an undefined mean
        square = F.when(cw == 0, F.lit(0.0)).otherwise(cw * (_x() - F.col("muw")) ** 2)
        out.append(_ratio(F.sum(square), F.sum(cw), F.sum(cw) != 0).alias("varw"))
    got = both.groupBy("fid").agg(*out)
    return got


MOMENT_RESULT: dict[str, Callable[[], Column]] = {
    "variance": lambda: F.col("var"),
    "stdev": lambda: F.sqrt("var"),
    "coefficient_of_variation": lambda: F.when(F.col("mu") == 0, F.when(F.col("var") == 0, F.lit(NAN)).otherwise(F.lit(float("inf")))).otherwise(F.sqrt("var") / F.nullif(F.col("mu"), F.lit(0.0))),
    "weighted_variance": lambda: F.col("varw"),
    "weighted_stdev": lambda: F.sqrt("varw"),
}


def histogram(cells: DataFrame, weighted: bool) -> DataFrame:
    """``fid, x, sc, sw``: coverage and weight of each value of a feature."""
    return cells.groupBy("fid", "x").agg(F.sum("c").alias("sc"), (F.sum(F.col("c") * F.col("w")) if weighted else F.lit(None).cast("double")).alias("sw"))


def histogram_stats(hist: DataFrame, stats: set[str]) -> DataFrame:
    """Statistics of the values' shares; a column for each name in ``stats``."""
    arrays = stats & {"unique", "frac", "weighted_frac"}
    aggs = {
        "mode": F.max_by("x", F.struct("sc", "x")),
        "majority": F.max_by("x", F.struct("sc", "x")),
        "minority": F.min_by("x", F.struct("sc", "x")),
        "variety": F.count("*"),
    }
    out = [aggs[s].alias(s) for s in sorted(stats & aggs.keys())]
    if arrays:
        out += [F.sort_array(F.collect_list(F.struct("x", "sc", "sw"))).alias("h"), F.sum("sc").alias("n"), F.sum("sw").alias("nw")]
    got = hist.groupBy("fid").agg(*out)
    share = lambda field, total: F.transform("h", lambda e: F.when(F.col(total) != 0, e[field] / F.nullif(F.col(total), F.lit(0.0))).otherwise(F.lit(NAN)))
    columns = {"unique": lambda: F.transform("h", lambda e: e["x"]), "frac": lambda: share("sc", "n"), "weighted_frac": lambda: share("sw", "nw")}
    return got.select("fid", *sorted(stats & aggs.keys()), *[columns[s]().alias(s) for s in sorted(arrays)])


#: Values of a feature that one task ranks at most; of more, only those near its quantiles are ranked.
MANY = 100_000
#: Slices that a round cuts a feature's values into, and sets of their borders that are broadcast at most.
SLICES, MOST_BORDERS = 64, 20_000
#: Values for each copy of a part's borders, at least, where these are not broadcast: from :data:`SLICES` times as many on, a part has that many copies.
DEALT = 1 << 14


def _at() -> Column:
    """Where a value stands on the scale of a quantile, from its rank ``i``, weight ``wt`` and the weight ``lower`` of those before it."""
    return F.when(F.col("i") == 0, F.lit(0.0)).otherwise(F.col("i") * F.col("wt") + (F.col("n") - 1) * F.col("lower"))


def _ranked(values: DataFrame) -> DataFrame:
    """``fid, x, wt`` with ``all`` weight, count ``n``, place ``s``, and value and place of the next value; a feature in one task."""
    by, whole = Window.partitionBy("fid").orderBy("x"), Window.partitionBy("fid")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    a = values.select("fid", "x", "wt", (F.row_number().over(by) - 1).alias("i"), F.count("*").over(whole).alias("n"), F.sum("wt").over(whole).alias("all"), F.coalesce(F.sum("wt").over(before), F.lit(0.0)).alias("lower"))
    return a.withColumn("s", _at()).withColumns({"xr": F.lead("x").over(by), "sr": F.lead("s").over(by)})


def _sliced(rows: DataFrame) -> DataFrame:
    """``rows(fid, part, x, ...)`` with ``slice``, the number of its part's borders below ``x``.

    Borders are approximate quantiles of the values as they are (merged
    sketches, a ten-thousandth off at most), so slices are of about one size
    whatever the distribution. They are broadcast or, where there are many sets,
    merged with the rows: one copy of a set for each :data:`DEALT` values at most,
    so that all copies grow no faster than the rows, and rows of a large part are
    dealt to its copies by their value.
    """
    borders = cut(rows.groupBy("fid", "part").agg(F.percentile_approx("x", [k / SLICES for k in range(1, SLICES)], 10_000).alias("borders"), F.count("*").alias("many")), "zs-borders")
    keys, columns = [F.col("fid") == F.col("f"), F.col("part") == F.col("p")], rows.columns
    sets = borders.select(F.col("fid").alias("f"), F.col("part").alias("p"), "borders", "many")
    if sets.count() <= MOST_BORDERS:
        sets = F.broadcast(sets)
    else:
        large = F.col("many") >= DEALT * SLICES
        hot = borders.where(large).select("fid", "part", F.lit(SLICES).alias("copies"))
        sets = sets.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(large, F.lit(SLICES - 1)).otherwise(F.lit(0)))))
        rows = rows.join(F.broadcast(hot), ["fid", "part"], "left")
        keys.append(F.pmod(F.xxhash64("x"), F.coalesce(F.col("copies"), F.lit(1))) == F.col("copy"))
        # a table of borders is many times its files, from which Spark would judge it small enough for a broadcast
        sets = sets.hint("merge")
    joined = rows.join(sets, reduce(Column.__and__, keys))
    return joined.select(*columns, F.size(F.filter("borders", lambda b: b < F.col("x"))).alias("slice"))


def _narrowed(values: DataFrame, qs: list[float], many: int) -> DataFrame:
    """What :func:`_ranked` gives, but only for values near the quantiles of each feature; no task sorts more than ``many`` of one.

    Round by round the parts that hold a quantile are cut into slices, whose
    exact counts and weights tell which of them holds it. ``values`` (each of a
    feature once) is read several times.
    """
    totals = values.groupBy("fid").agg(F.count("*").alias("n"), F.sum("wt").alias("all"))
    start = {"part": F.lit(0).cast("bigint"), "i0": F.lit(0).cast("bigint"), "l0": F.lit(0.0), "xn": F.lit(None).cast("double"), "sn": F.lit(None).cast("double")}
    rows, own = values.join(totals, "fid").select("fid", "x", "wt", "n", "all", *[c.alias(k) for k, c in start.items()]), None
    of_part = ["n", "all", "i0", "l0", "xn", "sn"]
    while (rows.groupBy("fid", "part").count().agg(F.max("count")).first()[0] or 0) > many:
        sliced = _sliced(rows)
        sums = sliced.groupBy("fid", "part", "slice").agg(F.count("*").alias("k"), F.sum("wt").alias("own"), F.min("x").alias("x"), F.min_by("wt", "x").alias("wt"), *[F.first(c).alias(c) for c in of_part])
        by = Window.partitionBy("fid", "part").orderBy("slice")
        before = by.rowsBetween(Window.unboundedPreceding, -1)
        none = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
        first = sums.select("fid", "part", "slice", "x", "wt", "n", "all", (F.col("i0") + none("k")).alias("i"), (F.col("l0") + none("own")).alias("lower"), "xn", "sn").withColumn("s", _at())
        first = first.withColumns({"xn": F.coalesce(F.lead("x").over(by), "xn"), "sn": F.coalesce(F.lead("s").over(by), "sn")})
        holds = [(F.col("s") <= t) & (F.col("sn").isNull() | (F.col("sn") > t)) for t in (F.lit(q) * F.col("all") * (F.col("n") - 1) for q in qs)]
        held = first.where(reduce(Column.__or__, holds)).select(F.col("fid").alias("f"), F.col("part").alias("p"), F.col("slice").alias("b"), F.col("i").alias("i1"), F.col("lower").alias("l1"), F.col("xn").alias("x1"), F.col("sn").alias("s1"))
        inside = sliced.join(held, (F.col("fid") == F.col("f")) & (F.col("part") == F.col("p")) & (F.col("slice") == F.col("b")))
        new = cut(inside.select("fid", "x", "wt", "n", "all", (F.col("part") * SLICES + F.col("slice")).alias("part"), F.col("i1").alias("i0"), F.col("l1").alias("l0"), F.col("x1").alias("xn"), F.col("s1").alias("sn")), "zs-part")
        if own is not None:
            drop_cut(own)
        rows = own = new
    by = Window.partitionBy("fid", "part").orderBy("x")
    lower = F.col("l0") + F.coalesce(F.sum("wt").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    a = rows.select("fid", "part", "x", "wt", "n", "all", "xn", "sn", (F.col("i0") + F.row_number().over(by) - 1).alias("i"), lower.alias("lower")).withColumn("s", _at())
    return a.select("fid", "x", "all", "n", "i", "s", F.coalesce(F.lead("x").over(by), "xn").alias("xr"), F.coalesce(F.lead("s").over(by), "sn").alias("sr"))


def quantiles(hist: DataFrame, qs: list[float], kind: str, many: int | None = None) -> DataFrame:
    """Weighted quantiles ``q0, q1, ...`` by interpolation between the values of a feature.

    Integer rasters get integers, truncated toward zero. With ``many`` features
    of more values than that are narrowed down round by round, the others are
    ranked as they are (``hist`` should be cut then).
    """
    h = hist.select("fid", F.col("x").cast("double").alias("x"), F.col("sc").alias("wt"))
    if many is None:
        a = _ranked(h)
    else:
        large = cut(h.groupBy("fid").count().where(F.col("count") > many).select("fid"), "zs-large")
        columns = ["fid", "x", "all", "n", "i", "s", "xr", "sr"]
        a = _ranked(h.join(large, "fid", "left_anti")).select(*columns)
        if large.count():
            a = a.unionByName(_narrowed(h.join(large, "fid", "left_semi"), qs, many).select(*columns))
    aggs = []
    for k, q in enumerate(qs):
        t = F.lit(q) * F.col("all") * (F.col("n") - 1)
        at = F.when(F.col("sr").isNull() | (F.col("sr") == F.col("s")), F.col("x")).otherwise(F.col("x") + (t - F.col("s")) * (F.col("xr") - F.col("x")) / F.nullif(F.col("sr") - F.col("s"), F.lit(0.0)))
        got = F.max_by(F.when(F.col("s") <= t, at), F.when(F.col("s") <= t, F.struct("s", "i")))
        aggs.append((got if kind == "double" else F.when(got < 0, F.ceil(got)).otherwise(F.floor(got))).cast(kind).alias(f"q{k}"))
    return a.groupBy("fid").agg(*aggs)


def arrays(cells: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Arrays of the cells' columns, row by row from the top left."""
    names = list(columns)
    listed = cells.select("fid", "row", "col", *[columns[n].alias(n) for n in names]).groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("row", "col", *names))).alias("cells"))
    return listed.select("fid", *[F.col(f"cells.{n}").alias(n) for n in names])


def category(cells: DataFrame, wanted: list[tuple[str, float]]) -> DataFrame:
    """Coverage, weight and their shares of single values; columns ``k0, k1, ...``."""
    cw = F.col("c") * F.col("w")
    out = []
    for k, (stat, v) in enumerate(wanted):
        mine = F.col("x") == F.lit(v)
        weight = cw if stat.startswith("weighted") else F.col("c")
        part = F.sum(F.when(mine, weight).otherwise(F.lit(0.0)))
        out.append((_ratio(part, F.sum(weight), F.sum(weight) != 0) if "frac" in stat else part).alias(f"k{k}"))
    return cells.groupBy("fid").agg(*out)
