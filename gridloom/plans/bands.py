"""Statistics of many bands in one plan: the band is a key, not a raster of its own.

The coverage of a feature is the same for all bands, so it is computed and
joined once; a cell's bands meet it as rows, and every statistic groups by
feature and band. The plan has one size whatever the count of bands.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.descriptors import DescriptorError, band_names, unique_names
from gridloom.functions.grid import Grid, common_grid
from gridloom.operators import statistics as st
from gridloom.operators.coverage import coverage
from gridloom.plans.zonal import Operation, attach, cells_of, near_features, passes, plan_operations, results_of
from gridloom.shared import cut, fresh, numbered
from gridloom.sources.geometry import edges
from gridloom.sources.raster import Raster, from_table, prepare


@dataclass(frozen=True)
class Bands:
    """Bands 1..n of one grid and cell type: a raster whose cells have a ``band`` column."""

    raster: Raster
    count: int
    root: str = ""

    @property
    def names(self) -> list[str]:
        return band_names(self.root, self.count)


def stack(table: DataFrame, grid: Grid, count: int | None = None, root: str = "", band: str = "band", **options) -> Bands:
    """Bands of a table of cells with a ``band`` column (1-based); options as of :func:`from_table`.

    Without ``count`` a job over the band column finds it.
    """
    if count is None:
        count = table.agg(F.max(band)).first()[0] or 0
    if count <= 0:
        raise DescriptorError("No rasters provided.")
    named = table.withColumn("band", F.col(band).cast("int"))
    return Bands(from_table(named, grid, "v", keep=("band",), **options), count, root)


def band_stats(bands: Bands, features: DataFrame, ops, weights=None, include_cols: str | list[str] | None = None, geometry: str = "geometry", kinds: str = "PL", grid_compat_tol: float = 1e-3) -> DataFrame:
    """One row for each feature and band: included columns, ``band``, then a column for each operation.

    ``ops`` are descriptors without raster names, or functions; ``weights`` is
    one raster for all bands. A band has no row for a cell that it lacks: with
    a default value, or a function, every covered cell stands once for each band.
    """
    plan, weight = _plan(bands, ops, weights)
    include = [include_cols] if isinstance(include_cols, str) else list(include_cols or [])
    unique_names([*include, "band", *(o.name for o in plan)])
    (fid,) = fresh(features, "fid")
    f = numbered(features, fid, "zs-features")
    return _band_rows(bands, f, fid, plan, weight, include, geometry, kinds, grid_compat_tol).drop(fid)


def _plan(bands: Bands, ops, weights) -> tuple[list[Operation], Raster | None]:
    """Operations of one band, and the weight raster."""
    found = prepare(weights)
    if len(found) > 1:
        raise DescriptorError("All bands have one weight raster.")
    weight = found[0].named("w") if found else None
    return plan_operations([bands.raster], [weight] if weight else [], ops), weight


def _band_rows(bands: Bands, f: DataFrame, fid: str, plan: list[Operation], weight: Raster | None, include: list[str], geometry: str, kinds: str, grid_compat_tol: float, always: bool = False, most: int | None = None) -> DataFrame:
    """``fid``, included columns, ``band`` and a column for each operation of numbered features."""
    raster = bands.raster
    (other,) = fresh(f, "f")
    numbers = F.explode(F.sequence(F.lit(1), F.lit(bands.count))).alias("band")
    out = f.select(fid, *include, numbers)
    used = [raster, *([weight] if weight else [])]
    grid = common_grid([r.grid for r in used], grid_compat_tol)
    e = edges(f, fid, geometry)
    (near, *rest), cov = near_features(used, coverage(e, grid, kinds), e, kinds, grid, always, most)
    for w in rest:
        cov = attach(cov, w, grid, "v1", True)
    if any(o.custom is not None or o.default_value is not None for o in plan):
        joined = attach(cov.select("*", numbers), near, grid, "v0", True, on=("band",))
    else:
        joined = attach(cov, near, grid, "v0", False, ("band",))
    # feature and band are one key to the statistics
    joined = joined.withColumn("fid", F.struct("fid", "band")).drop("band")
    if not weight:
        joined = joined.select("fid", "row", "col", "cov", "v0")
    groups: dict[tuple, list] = {}
    for o in plan:
        groups.setdefault(o.key, []).append(o)
    if sum(passes(mine) for mine in groups.values()) > 1:
        joined = cut(joined, "zs-cells")
    columns, k = {}, 0
    for mine in groups.values():
        cells = cells_of(joined, mine[0], used, raster, weight if mine[0].key[1] is not None else None, grid)
        for table, results in results_of(cells, mine, raster, grid):
            named = []
            for o, c in results:
                columns[id(o)] = f"_s{k}"
                named.append(c.alias(f"_s{k}"))
                k += 1
            got = table.select(F.col("fid.fid").alias(other), F.col("fid.band").alias("_b"), *named)
            out = out.join(got, (F.col(fid) == F.col(other)) & (F.col("band") == F.col("_b")), "left").drop(other, "_b")
    filled = lambda o: F.col(columns[id(o)]) if o.custom else st.fill(o.stat, F.col(columns[id(o)]), st.result_type(o.stat, raster.result_type))
    return out.select(fid, *include, "band", *[filled(o).alias(o.name) for o in plan])


def zonal_bands(bands: Bands, features: DataFrame, ops, weights=None, include_cols: str | list[str] | None = None, include_geom: bool = False, geometry: str = "geometry", kinds: str = "PL", grid_compat_tol: float = 1e-3, always: bool = False, most: int | None = None) -> DataFrame:
    """One row for each feature with the columns, names and order of ``zonal_stats`` over the bands as rasters of their own."""
    plan, weight = _plan(bands, ops, weights)
    every = plan_operations([bands.raster.named(n) for n in bands.names], prepare(weights), ops)
    if len(every) != bands.count * len(plan):
        raise DescriptorError("Operations name single bands, which are rasters of their own.")
    include = [include_cols] if isinstance(include_cols, str) else list(include_cols or [])
    shown = [*([geometry] if include_geom else []), *include]
    unique_names([*shown, *(o.name for o in every)])
    fid, other = fresh(features, "fid", "f")
    f = numbered(features, fid, "zs-features")
    rows = _band_rows(bands, f, fid, [replace(o, name=f"_o{k}") for k, o in enumerate(plan)], weight, [], geometry, kinds, grid_compat_tol, always, most)
    # the operations of a band are one value, so that columns are named by band alone
    one = F.first(F.struct(*[f"_o{k}" for k in range(len(plan))]))
    turned = rows.groupBy(F.col(fid).alias(other)).pivot("band", list(range(1, bands.count + 1))).agg(one)
    results = [F.col(f"`{b}`").getField(f"_o{k}").alias(every[k * bands.count + b - 1].name) for k in range(len(plan)) for b in range(1, bands.count + 1)]
    return f.select(fid, *shown).join(turned, F.col(fid) == F.col(other), "left").select(*shown, *results)


def wide(result: DataFrame, bands: Bands, by: str | list[str]) -> DataFrame:
    """:func:`band_stats` with a column for each band and operation, named ``<band>_<operation>``; ``by`` tells features apart."""
    by = [by] if isinstance(by, str) else by
    ops = [c for c in result.columns if c not in (*by, "band")]
    turned = result.groupBy(*by).pivot("band", list(range(1, bands.count + 1))).agg(*[F.first(c).alias(c) for c in ops])
    names = bands.names if bands.count > 1 else [""]
    spark_name = lambda k, c: f"{k}_{c}" if len(ops) > 1 else str(k)
    return turned.select(*by, *[F.col(f"`{spark_name(k, c)}`").alias(f"{n}_{c}" if n else c) for k, n in enumerate(names, 1) for c in ops])
