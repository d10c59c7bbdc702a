"""Zonal statistics: the planner that turns requests into one DataFrame.

Requests that are sums over cells are met by runs of coverage and running sums
of the raster (``operators/runs.py``), and over rasters in blocks by states that
merge (``operators/block_states.py``). For others coverage is computed once and
joined once with every raster in use; each request sees that one table through its own filter. Where the statistics need
more than one pass over it, it is written once to the shared folder, so that
no pass repeats the joins. Rasters kept in tiles are read only where features
lie. A feature without cells still has a row (left join from features).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.descriptors import Descriptor, DescriptorError, Request, expand, parse_literal, unique_names
from gridloom.functions.grid import Grid, common_grid
from gridloom.operators import block_states as bs
from gridloom.operators import runs as rn
from gridloom.operators import statistics as st
from gridloom.operators.coverage import cells_of_runs, coverage, coverage_runs
from gridloom.operators.custom import CustomStat, custom_results
from gridloom.sources.geometry import edges
from gridloom.shared import cut, fresh, numbered
from gridloom.sources.blocks import BlockRaster
from gridloom.sources.raster import Raster, cell_area, prepare

COVERAGE_WEIGHTS = ("fraction", "none", "area_cartesian", "area_spherical_m2", "area_spherical_km2")
STRATEGIES = ("feature-sequential", "raster-sequential", "raster-parallel")
#: Least coverage unless asked otherwise: any that is more than none.
LEAST_COVERAGE = 0.0


@dataclass(frozen=True)
class Operation:
    """A checked request: what to compute, from what, under which name."""

    stat: str
    name: str
    values: str
    weights: str | None
    min_coverage: float = LEAST_COVERAGE
    coverage_weight: str = "fraction"
    default_value: object = None
    default_weight: float | None = None
    q: float | None = None
    v: object = None
    custom: CustomStat | None = None

    @property
    def key(self) -> tuple:
        """Operations of one key see the same cells."""
        weights = self.weights if self.stat in st.NEEDS_WEIGHT or (self.custom and self.custom.weighted) else None
        return (self.values, weights, self.min_coverage, self.coverage_weight, self.default_value, self.default_weight if weights is not None else None, self.custom is not None)


def check(request: Request, dtype: str, custom: CustomStat | None = None) -> Operation:
    """Read and check the options of a request."""
    args = dict(request.args)
    found: dict = {}
    if custom is None and request.stat not in st.ALL:
        raise DescriptorError(f"Unsupported stat: {request.stat}")
    if request.stat == "quantile":
        if "q" not in args:
            raise DescriptorError("Missing required argument: q")
        found["q"] = parse_literal(str(args.pop("q")), "float64")
        if not 0 <= found["q"] <= 1:
            raise DescriptorError("Quantile must be between 0 and 1.")
    if request.stat in st.CATEGORY:
        if "v" not in args:
            raise DescriptorError("Missing required argument: v")
        found["v"] = parse_literal(str(args.pop("v")), dtype)
    if "min_coverage_frac" in args:
        f = found["min_coverage"] = parse_literal(str(args.pop("min_coverage_frac")), "float64")
        if not 0 <= f <= 1:
            raise DescriptorError("Minimum coverage fraction must be between 0 and 1.")
    if "coverage_weight" in args:
        found["coverage_weight"] = str(args.pop("coverage_weight"))
        if found["coverage_weight"] not in COVERAGE_WEIGHTS:
            raise DescriptorError(f"Unexpected coverage_weight: {found['coverage_weight']}")
    if "default_value" in args:
        found["default_value"] = parse_literal(str(args.pop("default_value")), dtype)
    if "default_weight" in args:
        found["default_weight"] = parse_literal(str(args.pop("default_weight")), "float64")
    if args:
        raise DescriptorError(f"Unexpected argument(s) to {request.stat}: {', '.join(args)}")
    name = f"{request.name}_{int(found['q'] * 100)}" if request.stat == "quantile" else request.name
    return Operation(request.stat, name, request.values, request.weights, custom=custom, **found)


def _index(grid: Grid, common: Grid) -> tuple[Column, Column, Column]:
    """Row and column in ``grid`` of a cell of the common grid, and whether it is inside."""
    ry, rx = grid.ratio(common)
    yo, xo = common.offset(Grid(grid.xmin, grid.ymin, grid.xmax, grid.ymax, common.dx, common.dy))
    row = F.col("row") if (ry, yo) == (1, 0) else F.floor((F.col("row") + yo) / F.lit(float(ry))).cast("int")
    col = F.col("col") if (rx, xo) == (1, 0) else F.floor((F.col("col") + xo) / F.lit(float(rx))).cast("int")
    return row, col, row.between(0, grid.rows - 1) & col.between(0, grid.cols - 1)


def attach(cells: DataFrame, raster: Raster, common: Grid, out: str, outer: bool, keep: tuple[str, ...] = (), on: tuple[str, ...] = ()) -> DataFrame:
    """Cells with the raster's value as ``out`` and its columns ``keep``; ``outer`` keeps cells without a value. Columns ``on`` of both sides agree."""
    row, col, _ = _index(raster.grid, common)
    r = raster.cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias(out), *keep, *[F.col(k).alias(f"_on_{k}") for k in on])
    if not outer:
        r = r.where(F.col(out).isNotNull())
    same = (row == F.col("_r")) & (col == F.col("_c"))
    for k in on:
        same &= F.col(k) == F.col(f"_on_{k}")
    return cells.join(r, same, "left" if outer else "inner").drop("_r", "_c", *[f"_on_{k}" for k in on])


#: Estimated bytes of a raster from which it is worth a job to know which of its cells are covered.
LARGE_RASTER = 256 << 20
#: Covered cells (some 40 bytes each) that are sent to the tasks that read such a raster.
MOST_CELLS = 1_000_000


#: Bytes of a cell, for rasters that tell their count of cells.
CELL_BYTES = 20


def is_large(raster: Raster) -> bool:
    """Whether a raster has :data:`LARGE_RASTER` bytes or more, by its count of cells or else by Spark's estimate; rows from the driver have none, which Spark writes as a very large one."""
    if raster.n_cells is not None:
        return raster.n_cells * CELL_BYTES >= LARGE_RASTER
    return LARGE_RASTER <= int(str(raster.cells._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 60


def near_features(rasters: list[Raster], cov: DataFrame, edges_: DataFrame, kinds: str, grid: Grid, always: bool = False, most: int | None = None) -> tuple[list[Raster], DataFrame]:
    """The rasters without tiles, and large ones without cells, that no feature covers; and the coverage.

    A raster in tiles is read near features only. If one is still large by
    Spark's estimate (or ``always``), the coverage is written once and counted:
    up to ``most`` cells, :data:`MOST_CELLS` at most, go to every task, so that
    the raster's other cells never leave the task that reads them. Beyond,
    raster and coverage shuffle.
    """
    rasters = [r.read_near(edges_, kinds) for r in rasters]
    large = [always or is_large(r) for r in rasters]
    if any(large):
        cov = cut(cov, "zs-coverage")
        if cov.count() <= min(MOST_CELLS, most or MOST_CELLS):
            rasters = [_covered(r, cov, grid) if x else r for r, x in zip(rasters, large, strict=True)]
    return rasters, cov


def _covered(raster: Raster, cov: DataFrame, grid: Grid) -> Raster:
    """The raster's covered cells."""
    row, col, inside = _index(raster.grid, grid)
    places = F.broadcast(cov.where(inside).select(row.alias("_r"), col.alias("_c")).distinct())
    return replace(raster, cells=raster.cells.join(places, (F.col("row") == F.col("_r")) & (F.col("col") == F.col("_c")), "left_semi"))


def joined_cells(cov: DataFrame, used: list[Raster], grid: Grid, outer: bool) -> DataFrame:
    """``fid, row, col, cov, v0, v1, ...``: covered cells with the value of each raster in use; ``outer`` keeps cells without any."""
    for k, r in enumerate(used):
        cov = attach(cov, r, grid, f"v{k}", outer or k > 0)
    return cov


def cells_of(joined: DataFrame, op: Operation, used: list[Raster], values: Raster, weight: Raster | None, grid: Grid) -> DataFrame:
    """``fid, row, col, c, x, w`` of the joined cells that an operation's key sees."""
    at = {id(r): F.col(f"v{k}") for k, r in enumerate(used)}
    cells = joined.where(F.col("cov") >= F.lit(op.min_coverage).cast("float")) if op.min_coverage > 0 else joined
    x = at[id(values)]
    if op.default_value is not None:
        inside = _index(values.grid, grid)[2]
        x = F.coalesce(x, F.when(inside, F.lit(op.default_value).cast(values.cells.schema["value"].dataType)))
    if op.custom is None:
        cells = cells.where(x.isNotNull())
    w = F.lit(None).cast("double")
    if weight is not None:
        w = at[id(weight)].cast("double")
        if op.default_weight is not None:
            w = F.coalesce(w, F.lit(op.default_weight))
        elif op.custom is None:
            w = F.coalesce(w, F.lit(st.NAN))
    return cells.select("fid", "row", "col", _cover(op.coverage_weight, grid).cast("double").alias("c"), x.alias("x"), w.alias("w"))


def _cover(coverage_weight: str, grid: Grid) -> Column:
    """What a cell of coverage ``cov`` in ``row`` counts."""
    if coverage_weight == "none":
        return F.lit(1.0).cast("float")
    return F.col("cov") if coverage_weight == "fraction" else F.col("cov") * cell_area(grid, F.col("row"), coverage_weight.removeprefix("area_"))


def of_runs(op: Operation, values: Raster, grid: Grid) -> bool:
    """Whether running sums along rows give an operation: a sum over cells of the common grid, each a cell of the raster."""
    return op.custom is None and op.stat in rn.RUN_STATS and op.default_value is None and values.grid.ratio(grid) == (1, 1)


def of_blocks(op: Operation, values: Raster, weight: Raster | None, grid: Grid) -> bool:
    """Whether states gathered block by block give an operation: all rasters in blocks of one grid."""
    return op.custom is None and op.stat in bs.BLOCK_STATS and op.default_value is None and all(isinstance(r, BlockRaster) and r.grid == grid and r.tiles == values.tiles for r in (values, weight or values))


def results_of_blocks(runs: DataFrame, ops: list[Operation], values: BlockRaster, weight: BlockRaster | None, grid: Grid) -> tuple[DataFrame, list[tuple[Operation, Column]]]:
    """Results of operations of one key from ``runs``, by the tasks that read the blocks."""
    op = ops[0]
    if op.min_coverage > 0:
        runs = runs.where(F.col("cov") >= F.lit(op.min_coverage).cast("float"))
    runs = runs.withColumn("c", _cover(op.coverage_weight, grid).cast("double"))
    table = bs.merge(bs.states(values, weight, runs, op.default_weight))
    at = _x_of(grid), _y_of(grid)
    return table, [(o, st.MOMENT_RESULT[o.stat]() if o.stat in st.MOMENT else st.scalar(o.stat, *at)[1]()) for o in ops]


def grid_cells(values: Raster, weight: Raster | None, op: Operation, grid: Grid) -> DataFrame:
    """``row, col, x, w`` of the raster's cells, in rows and columns of the common grid."""
    down, right = values.grid.offset(grid)
    cells = values.cells.where(F.col("value").isNotNull()).select((F.col("row") + down).cast("int").alias("row"), (F.col("col") + right).cast("int").alias("col"), F.col("value").alias("x"))
    if weight is None:
        return cells.withColumn("w", F.lit(None).cast("double"))
    cells = attach(cells, weight, grid, "w", True)
    return cells.withColumn("w", F.coalesce(F.col("w").cast("double"), F.lit(st.NAN if op.default_weight is None else op.default_weight)))


def results_of_runs(runs: DataFrame, ops: list[Operation], values: Raster, weight: Raster | None, grid: Grid, large: bool) -> tuple[DataFrame, list[tuple[Operation, Column]]]:
    """Results of operations of one key from ``runs`` (``fid, row, first, last, cov``), without a row for any inner cell."""
    op, weighted = ops[0], weight is not None
    if op.min_coverage > 0:
        runs = runs.where(F.col("cov") >= F.lit(op.min_coverage).cast("float"))
    runs = runs.withColumn("c", _cover(op.coverage_weight, grid).cast("double"))
    cells, points = grid_cells(values, weight, op, grid), rn.changes(runs)
    if large:
        points = cut(points, "zs-points")
        blocks = points.select(F.col("row").alias("_r"), F.col("block").alias("_b")).distinct()
        if blocks.count() <= MOST_CELLS:
            cells = cells.join(F.broadcast(blocks), (F.col("row") == F.col("_r")) & (F.floor(F.col("col") / rn.BLOCK) == F.col("_b")), "left_semi")

    def by_cells(ids: DataFrame) -> DataFrame:
        mine = cells_of_runs(runs.join(F.broadcast(ids) if not large else ids, "fid", "left_semi").drop("cov").withColumnRenamed("c", "cov")).withColumnRenamed("cov", "c")
        sums = st.scalar_sums()
        return mine.join(cells, ["row", "col"]).groupBy("fid").agg(*[sums[k].alias(k) for k in (("n", "s", "nw", "sw") if weighted else ("n", "s"))])

    table = rn.checked(rn.run_sums(points, cells, weighted), by_cells)
    at = _x_of(grid), _y_of(grid)
    return table, [(o, st.scalar(o.stat, *at)[1]()) for o in ops]


def passes(ops: list[Operation]) -> int:
    """How often the cells of operations of one key are read."""
    of = {o.stat for o in ops if o.custom is None}
    has = lambda names: bool(of & set(names))
    return has(st.SCALAR) + 2 * has(st.MOMENT) + has(st.HISTOGRAM) + has(st.QUANTILE) + has(st.ARRAY) + has(st.CATEGORY) + sum(o.custom is not None for o in ops)


def coverage_table(rasters, features: DataFrame, key: str, geometry: str = "geometry", weights=None, kinds: str = "PL", grid_compat_tol: float = 1e-3) -> DataFrame:
    """The joined cells themselves: ``fid, row, col, x_center, y_center, cell_id, coverage, value, weight, area``."""
    rs, ws = prepare(rasters), prepare(weights)
    grid = common_grid([r.grid for r in (*rs, *ws)], grid_compat_tol)
    cov = coverage(edges(features, key, geometry), grid, kinds)
    cells = attach(cov, rs[0], grid, "value", True)
    cells = attach(cells, ws[0], grid, "weight", True) if ws else cells.withColumn("weight", F.lit(None).cast("double"))
    row, col, inside = _index(rs[0].grid, grid)
    return cells.select("fid", "row", "col", _x_of(grid).alias("x_center"), _y_of(grid).alias("y_center"), F.when(inside, row.cast("long") * rs[0].grid.cols + col).alias("cell_id"), F.col("cov").cast("double").alias("coverage"), "value", F.col("weight").cast("double").alias("weight"), cell_area(grid, F.col("row"), "cartesian").cast("double").alias("area"))


def _x_of(grid: Grid) -> Column:
    return F.lit(grid.xmin) + (F.col("col") + 0.5) * F.lit(grid.dx)


def _y_of(grid: Grid) -> Column:
    return F.lit(grid.ymax) - (F.col("row") + 0.5) * F.lit(grid.dy)


def results_of(cells: DataFrame, ops: list[Operation], raster: Raster, grid: Grid, many: int | None = None) -> list[tuple[DataFrame, list[tuple[Operation, Column]]]]:
    """Tables by ``fid`` with the results of operations of one key; ``many``: values of a feature that one task ranks, where some feature may have more."""
    out = []
    of = lambda names: [o for o in ops if o.stat in names and o.custom is None]
    if mine := of(st.SCALAR):
        aggs: dict[str, Column] = {}
        finals = []
        for o in mine:
            need, final = st.scalar(o.stat, _x_of(grid), _y_of(grid))
            aggs |= need
            finals.append((o, final()))
        out.append((cells.groupBy("fid").agg(*[v.alias(k) for k, v in aggs.items()]), finals))
    if mine := of(st.MOMENT):
        out.append((st.moments(cells, {o.stat for o in mine}), [(o, st.MOMENT_RESULT[o.stat]()) for o in mine]))
    if of(st.HISTOGRAM) or of(st.QUANTILE):
        hist = st.histogram(cells, any(o.stat == "weighted_frac" for o in ops))
        if mine := of(st.HISTOGRAM):
            out.append((st.histogram_stats(hist, {o.stat for o in mine}), [(o, F.col(o.stat)) for o in mine]))
        if mine := of(st.QUANTILE):
            qs = [0.5 if o.stat == "median" else o.q for o in mine]
            if many is not None:
                hist = cut(hist, "zs-values")
            out.append((st.quantiles(hist, qs, raster.result_type, many), [(o, F.col(f"q{k}")) for k, o in enumerate(mine)]))
    if mine := of(st.ARRAY):
        row, col, inside = _index(raster.grid, grid)
        columns = {"values": F.col("x"), "coverage": F.col("c"), "weights": F.col("w"), "cell_id": F.when(inside, row.cast("long") * raster.grid.cols + col), "center_x": _x_of(grid), "center_y": _y_of(grid)}
        out.append((st.arrays(cells, {o.stat: columns[o.stat] for o in mine}), [(o, F.col(o.stat)) for o in mine]))
    if mine := of(st.CATEGORY):
        out.append((st.category(cells, [(o.stat, o.v) for o in mine]), [(o, F.col(f"k{k}")) for k, o in enumerate(mine)]))
    for o in ops:
        if o.custom is not None:
            out.append((custom_results(cells, o.custom), [(o, F.col("result"))]))
    return out


def own_rasters(ops) -> tuple[list, dict[str, Raster]]:
    """Requests that hold rasters themselves, with names in their place, and those rasters by name."""
    found: dict[str, Raster] = {}

    def name(r) -> str | None:
        if not isinstance(r, Raster):
            return r
        key = next((k for k, x in found.items() if x is r), f"@{len(found)}")
        found[key] = r
        return key

    many = [ops] if isinstance(ops, (str, Descriptor, Request, CustomStat)) or callable(ops) else list(ops)
    return [replace(o, values=name(o.values), weights=name(o.weights)) if isinstance(o, Request) else o for o in many], found


def plan_operations(rasters: list[Raster], weights: list[Raster], ops, own: dict[str, Raster] | None = None) -> list[Operation]:
    """Descriptors, requests and functions as checked operations with distinct names."""
    by_name = {r.name: r for r in (*weights, *rasters)} | (own or {})
    out: list[Operation] = []
    for op in [ops] if isinstance(ops, (str, Descriptor, Request, CustomStat)) or callable(ops) else ops:
        custom = None
        if callable(op) or isinstance(op, CustomStat):
            custom = op if isinstance(op, CustomStat) else CustomStat(op)
            if custom.weighted and not weights:
                raise DescriptorError(f"No weights provided but {custom.name} expects 3 arguments")
            # named like a statistic of the weights or of the values alone
            op = Descriptor(("weighted_" if custom.weighted else "") + "custom")
        for r in expand([op], [x.name for x in rasters], [x.name for x in weights]):
            if custom is not None:
                r = Request(custom.name, r.name.replace(op.stat, custom.name), r.values, r.weights, r.args)
            for raster in (r.values, *([r.weights] if r.weights is not None else [])):
                if raster not in by_name:
                    raise DescriptorError(f"Unknown raster {raster} in stat {r.stat}")
            out.append(check(r, by_name[r.values].dtype, custom))
    unique_names([o.name for o in out])
    return out


def warn_crs(features_srs: str | None, rasters: list[Raster], weights: list[Raster]) -> None:
    """A warning where known coordinate systems differ."""
    known = lambda s: s.strip().lower().split("+")[0] if s else None
    first = rasters[0].srs if rasters else None
    for r in rasters:
        if known(features_srs) and known(r.srs) and known(features_srs) != known(r.srs):
            warnings.warn("Spatial reference system of input features does not exactly match raster.", stacklevel=3)
            break
    for w in weights:
        if known(first) and known(w.srs) and known(first) != known(w.srs):
            warnings.warn("Spatial reference system of value raster does not exactly match weighting raster.", stacklevel=3)
            break


def zonal_stats(
    rasters,
    features: DataFrame,
    ops,
    weights=None,
    include_cols: str | list[str] | None = None,
    include_geom: bool = False,
    geometry: str = "geometry",
    kinds: str = "PL",
    features_srs: str | None = None,
    strategy: str = "feature-sequential",
    grid_compat_tol: float = 1e-3,
    max_cells_in_memory: int = 30_000_000,
    progress: Callable[[float, str], None] | None = None,
    frac_as_map: bool = False,
) -> DataFrame:
    """One row for each feature: geometry (if asked), included columns, then a column for each operation.

    ``rasters`` may be None where every operation is a :class:`Request` that
    holds its rasters, or ``bands.Bands``, whose bands share one plan. ``frac_as_map`` gives ``frac`` and ``weighted_frac`` as
    maps from value to share. An operation can't have the name of an included
    column. ``kinds`` limits the plan to polygons (``P``) or lines (``L``)
    where that is known. With ``feature-sequential`` only large rasters stay
    where they are read and get the features' cells; with the other strategies
    all do. At most ``max_cells_in_memory`` cells go to each task for that (and
    never more than :data:`MOST_CELLS`); beyond, both sides shuffle.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {strategy}")
    if max_cells_in_memory <= 0:
        raise ValueError("Invalid value for max_cells_in_memory")
    from gridloom.plans.bands import Bands, zonal_bands

    if isinstance(rasters, Bands):
        if frac_as_map or progress:
            raise DescriptorError("Shares as maps and progress are not offered for bands.")
        warn_crs(features_srs, [rasters.raster], prepare(weights))
        return zonal_bands(rasters, features, ops, weights, include_cols, include_geom, geometry, kinds, grid_compat_tol, strategy != STRATEGIES[0], max_cells_in_memory)
    rs, ws = prepare(rasters), prepare(weights)
    ops, own = own_rasters(ops)
    plan = plan_operations(rs, ws, ops, own)
    warn_crs(features_srs, [*rs, *own.values()], ws)
    if progress:
        progress(0.0, "")
    include = [include_cols] if isinstance(include_cols, str) else list(include_cols or [])
    shown = [*([geometry] if include_geom else []), *include]
    unique_names([*shown, *(o.name for o in plan)])
    of_values, of_weights = own | {r.name: r for r in rs}, own | {r.name: r for r in (*rs, *ws)}
    pairs = [(of_values[o.values], of_weights[o.key[1]] if o.key[1] is not None else None) for o in plan]
    fid, other = fresh(features, "fid", "f")
    f = numbered(features, fid, "zs-features")
    out, columns = f.select(fid, *shown), {}
    if plan:
        used = list({id(r): r for pair in pairs for r in pair if r is not None}.values())
        # the values come first: with one value raster and no use for cells outside it, its join is an inner one
        used.sort(key=lambda r: not any(r is v for v, _ in pairs))
        grid = common_grid([r.grid for r in used], grid_compat_tol)
        # geometries are decoded once, whatever reads their edges
        e = cut(edges(f, fid, geometry), "zs-edges")
        present = {r[0] for r in e.select("kind").distinct().collect()}
        groups: dict[tuple, list[Operation]] = {}
        for o in plan:
            groups.setdefault(o.key, []).append(o)
        by_blocks = all(of_blocks(o, v, w, grid) for o, (v, w) in zip(plan, pairs, strict=True))
        by_runs = not by_blocks and all(of_runs(o, v, grid) for o, (v, _) in zip(plan, pairs, strict=True))
        if by_blocks or by_runs:
            near = {id(r): r.read_near(e, kinds) for r in used}
            runs = coverage_runs(e, grid, kinds, present)
        else:
            used_now, cov = near_features(used, coverage(e, grid, kinds, present), e, kinds, grid, strategy != STRATEGIES[0], max_cells_in_memory)
            outer = len({id(v) for v, _ in pairs}) > 1 or any(o.default_value is not None or o.custom is not None for o in plan)
            joined = joined_cells(cov, used_now, grid, outer)
            ranked = any(o.stat in st.QUANTILE for o in plan)
            if ranked or sum(passes(mine) for mine in groups.values()) > 1:
                joined = cut(joined, "zs-cells")
            # cells of a feature bound its values
            many = st.MANY if ranked and (joined.groupBy("fid").count().agg(F.max("count")).first()[0] or 0) > st.MANY else None
        k = 0
        for mine in groups.values():
            raster, weight = next(p for o, p in zip(plan, pairs, strict=True) if o is mine[0])
            asked = list(mine)
            if frac_as_map and any(o.stat in ("frac", "weighted_frac") for o in mine) and not any(o.stat == "unique" for o in mine):
                asked.append(replace(next(o for o in mine if o.stat in ("frac", "weighted_frac")), stat="unique", name=""))
            if by_blocks:
                tables = [results_of_blocks(runs, mine, near[id(raster)], near[id(weight)] if weight is not None else None, grid)]
            elif by_runs:
                every = strategy != STRATEGIES[0] or is_large(raster)
                tables = [results_of_runs(runs, mine, near[id(raster)], near[id(weight)] if weight is not None else None, grid, every)]
            else:
                tables = results_of(cells_of(joined, mine[0], used, raster, weight, grid), asked, raster, grid, many)
            for table, results in tables:
                named = []
                for o, c in results:
                    columns[id(o)] = f"_s{k}", o, raster
                    named.append(c.alias(f"_s{k}"))
                    k += 1
                out = out.join(table.select(F.col("fid").alias(other), *named), F.col(fid) == F.col(other), "left").drop(other)
            if frac_as_map:
                keys = next((F.col(columns[id(o)][0]) for o in asked if o.stat == "unique"), None)
                for o in mine:
                    if o.stat in ("frac", "weighted_frac"):
                        c = F.map_from_arrays(keys, F.col(columns[id(o)][0]))
                        kind = f"map<{raster.result_type},double>"
                        out = out.withColumn(columns[id(o)][0], F.coalesce(c.cast(kind), F.create_map().cast(kind)))
    final = []
    for o in plan:
        c, _, raster = columns[id(o)]
        as_it_is = o.custom or frac_as_map and o.stat in ("frac", "weighted_frac")
        final.append((F.col(c) if as_it_is else st.fill(o.stat, F.col(c), st.result_type(o.stat, raster.result_type))).alias(o.name))
    if progress:
        progress(1.0, "")
    return out.select(*shown, *final)
