"""Registered zonal queries over the driver's tables, and the same in DuckDB SQL.

``part`` is laid out as a raster of 50 columns (value: size, missing where it
is a multiple of ten), ``customer`` as a weight raster of half the resolution
(both hold every row of their tables), and every supplier gets a zone: a rectangle, a diamond, an L or a rectangle
with a hole. The SQL computes the same from first principles.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.grid import Grid
from gridloom.operators import statistics as st
from gridloom.operators.coverage import coverage
from gridloom.operators.custom import CustomStat
from gridloom.operators.subdivide import subdivide
from gridloom.plans import bands
from gridloom.plans.zonal import coverage_table, zonal_stats
from gridloom.shared import cut, shared_path
from gridloom.sources import blocks, output, raster, shapefile
from gridloom.sources.geometry import edges, to_wkb
from gridloom.streaming.tiles import stream_tiles

# Corners of the four zone shapes in units of the zone's size, shell then hole.
SHAPES = {
    0: [[(0, 0), (1, 0), (1, 1), (0, 1)]],
    1: [[(0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5)]],
    2: [[(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1)]],
    3: [[(0, 0), (1, 0), (1, 1), (0, 1)], [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)]],
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str) -> int:
    """Rows of 50 cells that hold every part, an even count."""
    return (_table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] // 50 + 2) // 2 * 2


def values(spark: SparkSession, sf_dir: str, value: str = "p_size", name: str = "v") -> raster.Raster:
    """Parts as a raster of 50 columns."""
    nr = _rows(spark, sf_dir)
    cells = _table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).cast("int").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"), F.col(value).alias("value"), (F.col("p_size") % 10 != 0).alias("ok"))
    return raster.from_table(cells, Grid(0.0, 0.0, 50.0, float(nr), 1.0, 1.0), name, mask="ok")


def weights(spark: SparkSession, sf_dir: str, name: str = "w") -> raster.Raster:
    """Customers as a raster of 25 columns of double width, from the same top edge down."""
    nr = _rows(spark, sf_dir)
    c = _table(spark, sf_dir, "customer")
    rows = c.agg(F.max("c_custkey")).first()[0] // 25 + 1
    cells = c.select(F.floor(F.col("c_custkey") / 25).cast("int").alias("row"), (F.col("c_custkey") % 25).cast("int").alias("col"), F.floor(F.col("c_acctbal") / 1000).cast("double").alias("value"), (F.col("c_acctbal") >= 0).alias("ok"))
    return raster.from_table(cells, Grid(0.0, float(nr - 2 * rows), 50.0, float(nr), 2.0, 2.0), name, mask="ok")


def zones(spark: SparkSession, sf_dir: str, line: bool = False, wide: bool = False) -> DataFrame:
    """``id, geometry``: a polygon in WKT (or its shell as a line) for each supplier; ``wide`` ones are up to 41 columns by 14 rows."""
    nr = _rows(spark, sf_dir)
    k = F.col("s_suppkey")
    z = _table(spark, sf_dir, "supplier").select(
        k.alias("id"),
        (k % 4).alias("shape"),
        F.when(k % 10 == 9, F.lit(1000.0)).when(k % 10 == 8, F.lit(-0.5)).otherwise((k * 37 % 368) / 8).alias("x"),
        ((k * 53 % (nr * 8 - 16)) / 8).alias("y"),
        (1 + (k % 5) * F.lit(10.125 if wide else 0.625)).cast("double").alias("w"),
        (1 + (k % 3) * F.lit(6.5 if wide else 0.5)).cast("double").alias("h"),
    )

    def point(p: tuple[float, float]) -> Column:
        return F.concat((F.col("x") + F.col("w") * F.lit(float(p[0]))).cast("string"), F.lit(" "), (F.col("y") + F.col("h") * F.lit(float(p[1]))).cast("string"))

    def ring(ps: list[tuple[float, float]]) -> Column:
        return F.concat(F.lit("("), F.concat_ws(", ", *[point(p) for p in [*ps, ps[0]]]), F.lit(")"))

    text = F.lit(None).cast("string")
    for shape, rings in SHAPES.items():
        wkt = F.concat(F.lit("LINESTRING "), ring(rings[0])) if line else F.concat(F.lit("POLYGON ("), F.concat_ws(", ", *[ring(r) for r in rings]), F.lit(")"))
        text = F.when(F.col("shape") == shape, wkt).otherwise(text)
    return z.select("id", text.alias("geometry"))


def _round(df: DataFrame) -> DataFrame:
    """Doubles to six places; NaN as null, as SQL has it."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(F.when(~F.isnan(c), F.col(c)), 6).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def _stats(ops: list, weighted: bool = False, value: str = "p_size", flat: bool = False, wide: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = zonal_stats(values(spark, sf_dir, value), zones(spark, sf_dir, wide=wide), ops, weights(spark, sf_dir) if weighted else None, "id", kinds="P")
        return _round(output.unnest(df) if flat else df)

    return run


def skewed_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of values over twelve powers of ten in wide zones, which are narrowed down as those of features with many values are."""
    nr = _rows(spark, sf_dir)
    cells = _table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).cast("int").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"), (F.col("p_retailprice") * F.pow(F.lit(10.0), (F.col("p_partkey") % 13 - 6).cast("double"))).alias("x"))
    grid = Grid(0.0, 0.0, 50.0, float(nr), 1.0, 1.0)
    z = zones(spark, sf_dir, wide=True)
    cov = coverage(edges(z, "id"), grid, "P").join(cells, ["row", "col"]).select("fid", "row", "col", F.col("cov").cast("double").alias("c"), "x", F.lit(None).cast("double").alias("w"))
    hist = cut(st.histogram(cov, False), "zs-values")
    got = st.quantiles(hist, [0.5, 0.1, 0.99], "double", SMALL_PART).withColumnRenamed("fid", "_fid")
    out = z.join(got, F.col("id") == F.col("_fid"), "left")
    return out.select("id", *[F.round(F.col(f"q{k}"), 6).alias(n) for k, n in enumerate(("median", "low", "high"))])


#: Values that one task ranks in ``zonal_quantiles_skewed``: few, so that its zones go the way of large features.
SMALL_PART = 20


def coverage_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage join alone, with values and weights of each cell."""
    cells = coverage_table(values(spark, sf_dir), zones(spark, sf_dir), "id", weights=weights(spark, sf_dir), kinds="P")
    return _round(cells.select(F.col("fid").alias("id"), "row", "col", "coverage", "value", "weight"))


def line_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each zone's outline in each cell."""
    cells = coverage_table(values(spark, sf_dir), zones(spark, sf_dir, line=True), "id", kinds="L")
    return _round(cells.groupBy(F.col("fid").alias("id")).agg(F.sum("coverage").alias("length"), F.count("*").alias("cells")))


def user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's function of values and coverage."""
    return zonal_stats(values(spark, sf_dir), zones(spark, sf_dir), CustomStat(_spread, "double", "spread"), None, "id", kinds="P")


def _spread(v, c) -> float | None:
    return float(v.max() - v.min()) if v.count() else None


def subdivided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each zone in each cell, from the cut geometries."""
    nr = _rows(spark, sf_dir)
    cut = subdivide(zones(spark, sf_dir), Grid(0.0, 0.0, 50.0, float(nr), 1.0, 1.0), "id")
    return _areas(cut)


def _areas(pieces: DataFrame) -> DataFrame:
    """Areas of pieces in single precision, as coverage is: so a last digit of a double does not decide how the sixth place is rounded."""
    return _round(pieces.select("id", "row", "col", F.col("area").cast("float").cast("double").alias("area")))


def subdivided_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of wide zones, whose boxes of more than 64 cells are cut by several tasks."""
    nr = _rows(spark, sf_dir)
    pieces = subdivide(zones(spark, sf_dir, wide=True), Grid(0.0, 0.0, 50.0, float(nr), 1.0, 1.0), "id", most_cells=64)
    return _areas(pieces)


def value_shares_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of values as a map, entry by entry."""
    df = zonal_stats(values(spark, sf_dir), zones(spark, sf_dir), ["unique", "frac"], None, "id", kinds="P")
    return _round(output.map_fields(df, {"frac": ("unique", "frac")}).select("id", F.explode("frac").alias("value", "share")))


def common_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two value rasters of different resolution: both counted on the common grid."""
    df = zonal_stats([values(spark, sf_dir), weights(spark, sf_dir)], zones(spark, sf_dir), ["count", "sum"], None, "id", kinds="P")
    return _round(df)


def grouped_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that come from a grouped aggregation: rows without a fixed place."""
    twice = zones(spark, sf_dir).unionAll(zones(spark, sf_dir))
    f = twice.groupBy("id").agg(F.first("geometry").alias("geometry"), F.count("*").alias("copies"))
    return _round(zonal_stats(values(spark, sf_dir), f, ["count", "mean", "variance"], None, ["id", "copies"], kinds="P"))


def multipolygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON features of two boxes each, six columns apart."""
    nr, k = _rows(spark, sf_dir), F.col("s_suppkey")
    s = _table(spark, sf_dir, "supplier").select(k.alias("id"), ((k * 29 % 320) / 8).alias("x"), ((k * 41 % (nr * 8 - 24)) / 8).alias("y"))
    at = lambda dx, dy: F.concat(F.lit("["), (F.col("x") + dx).cast("string"), F.lit(","), (F.col("y") + dy).cast("string"), F.lit("]"))
    box = lambda dx: F.concat(F.lit("[["), F.concat_ws(",", at(dx, 0.0), at(dx + 1.5, 0.0), at(dx + 1.5, 2.25), at(dx, 2.25), at(dx, 0.0)), F.lit("]]"))
    text = F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), box(0.0), F.lit(","), box(6.0), F.lit("]}"))
    return _round(zonal_stats(values(spark, sf_dir), s.select("id", text.alias("geometry")), ["count", "sum"], None, "id", kinds="P"))


def nodata_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster with a NODATA value, scale and offset."""
    nr = _rows(spark, sf_dir)
    cells = _table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).cast("int").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"), F.col("p_size").alias("value"))
    r = raster.from_table(cells, Grid(0.0, 0.0, 50.0, float(nr), 1.0, 1.0), "v", nodata=13, scale=2.5, offset=-4.0)
    return _round(zonal_stats(r, zones(spark, sf_dir), ["count", "sum", "max"], None, "id", kinds="P"))


def sphere_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered area on the sphere, from square metres."""
    df = zonal_stats(values(spark, sf_dir), zones(spark, sf_dir), ["m2=count(coverage_weight=area_spherical_m2)"], None, "id", kinds="P")
    return df.select("id", F.round(F.col("m2") / 1e6, 4).alias("km2"))


def _banded(spark: SparkSession, sf_dir: str, n: int = 4) -> bands.Bands:
    nr = _rows(spark, sf_dir)
    part = _table(spark, sf_dir, "part").select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("band"))
    cells = part.select("band", F.floor(F.col("p_partkey") / 50).cast("int").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"), (F.col("p_size") * F.col("band") % 11).cast("int").alias("value"), (F.col("p_size") % 10 != F.col("band")).alias("ok"))
    return bands.stack(cells, Grid(0.0, 0.0, 50.0, float(nr), 1.0, 1.0), n, mask="ok")


def many_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics for each zone and band, in one plan."""
    return _round(bands.band_stats(_banded(spark, sf_dir), zones(spark, sf_dir), ["count", "mean", "variety", "variance"], None, "id", kinds="P"))


def many_bands_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each band and statistic."""
    b = _banded(spark, sf_dir, 3)
    return _round(bands.wide(bands.band_stats(b, zones(spark, sf_dir), ["count", "sum"], None, "id", kinds="P"), b, "id"))


def many_bands_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bands through the general entry, with a default where a band lacks a cell."""
    return _round(zonal_stats(_banded(spark, sf_dir, 3), zones(spark, sf_dir), ["mean(default_value=7)", "max", "variety(default_value=7)"], None, "id", kinds="P"))


def tiled_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster in tiles of 8 x 8 cells, of which only those near zones are read."""
    nr = _rows(spark, sf_dir)
    key = F.col("p_partkey")
    row, col = F.floor(key / 50).cast("int"), (key % 50).cast("int")
    cells = _table(spark, sf_dir, "part").select(row.alias("row"), col.alias("col"), F.col("p_size").alias("value"), (F.col("p_size") % 10 != 0).alias("ok"), F.floor(row / 8).cast("int").alias("tile_row"), F.floor(col / 8).cast("int").alias("tile_col"))
    r = raster.from_table(cells, Grid(0.0, 0.0, 50.0, float(nr), 1.0, 1.0), "v", mask="ok", tiles=8)
    return _round(zonal_stats(r, zones(spark, sf_dir), ["count", "mean"], None, "id", kinds="P"))


def _tiled(spark: SparkSession, sf_dir: str) -> raster.Raster:
    nr = _rows(spark, sf_dir)
    row, col = F.floor(F.col("p_partkey") / 50).cast("int"), (F.col("p_partkey") % 50).cast("int")
    cells = _table(spark, sf_dir, "part").select(row.alias("row"), col.alias("col"), F.col("p_retailprice").alias("value"), F.floor(row / 4).cast("int").alias("tile_row"), F.floor(col / 4).cast("int").alias("tile_col"))
    return raster.from_table(cells, Grid(0.0, 0.0, 50.0, float(nr), 1.0, 1.0), "v", tiles=4)


def tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of 4 x 4 cells that each wide zone meets: its outline's and those inside it, not those of its hole."""
    z = zones(spark, sf_dir, wide=True)
    return _tiled(spark, sf_dir).tile_cover(edges(z, "id"), "P").select(F.col("fid").alias("id"), "tile_row", "tile_col")


def tiles_of_wide_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of wide zones over a raster of which only the tiles that they meet are read."""
    return _round(zonal_stats(_tiled(spark, sf_dir), zones(spark, sf_dir, wide=True), ["count", "mean", "max"], None, "id", kinds="P"))


def _blocks(ops: list[str], weighted: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        of = lambda value, name: blocks.to_blocks(values(spark, sf_dir, value, name), 8)
        return _round(zonal_stats(of("p_retailprice", "v"), zones(spark, sf_dir, wide=True), ops, of("p_size", "w") if weighted else None, "id", kinds="P"))

    return run


MOMENT_OPS = ["variance", "stdev", "coefficient_of_variation", "count", "mean", "min", "max"]


def zones_over_arriving_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones over tiles that arrive as a stream, restarted twice: the second arrival replaces the first, the third is late."""
    new, old = (blocks.to_blocks(values(spark, sf_dir, c), 8) for c in ("p_retailprice", "p_size"))
    even = (F.col("tile_row") + F.col("tile_col")) % 2 == 0
    z = zones(spark, sf_dir, wide=True)
    arriving, out, checkpoint = (shared_path(spark, x) for x in ("st-tiles", "st-results", "st-checkpoint"))

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    for tiles, version in ((old.blocks.where(even), 1), (new.blocks, 2), (old.blocks.where(~even), 1)):
        tiles.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema("tile_row int, tile_col int, data binary, version long").parquet(arriving)
        found = stream_tiles(stream, z, "id", MOMENT_OPS, new.grid, 8, "version", kinds="P")
        found.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    last = got.groupBy("id").agg(F.max_by(F.struct(*MOMENT_OPS), "batch").alias("r"))
    return _round(z.select("id").join(last, "id", "left").select("id", *[(F.coalesce("r.count", F.lit(0.0)) if c == "count" else F.col(f"r.{c}")).alias(c) for c in MOMENT_OPS]))


def zones_in_wkb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones as well-known binary."""

    @F.pandas_udf("binary")
    def binary(texts: pd.Series) -> pd.Series:
        return texts.map(to_wkb)

    z = zones(spark, sf_dir).select("id", binary("geometry").alias("geometry"))
    return _round(zonal_stats(values(spark, sf_dir), z, ["count", "mean"], None, "id", kinds="P"))


def shares_as_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares as maps from value to share, without the values being asked for."""
    df = zonal_stats(values(spark, sf_dir), zones(spark, sf_dir), ["frac", "weighted_frac(default_weight=0)"], weights(spark, sf_dir), "id", kinds="P", frac_as_map=True)
    return _round(df.select("id", F.explode("frac").alias("value", "share"), F.col("weighted_frac").alias("w")).select("id", "value", "share", F.col("w")[F.col("value")].alias("weighted_share")))


def line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and mean value along each zone's outline."""
    return _round(zonal_stats(values(spark, sf_dir), zones(spark, sf_dir, line=True), ["count", "mean", "max"], None, "id", kinds="L"))


def nested_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays as they are in nested output, as text."""
    df = zonal_stats(values(spark, sf_dir), zones(spark, sf_dir), ["values", "cell_id"], None, "id", kinds="P")
    return df.select("id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("values", "cell_id")])


def features_as_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON features with their shapes, as the GeoJSON sink writes them."""
    z = zones(spark, sf_dir).where("id % 4 < 3")
    df = zonal_stats(values(spark, sf_dir), z, ["variety", "max"], None, "id", include_geom=True, kinds="P")
    return output.geojson(df, "geometry", "id")


def features_in_shapefiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with statistics written as shapefiles and read back, and statistics of what was read."""
    path = shared_path(spark, "zs-shapes")
    first = zonal_stats(values(spark, sf_dir), zones(spark, sf_dir), ["variety", "max"], None, "id", include_geom=True, kinds="P")
    shapefile.write(first, path)
    back = shapefile.read(spark, path)
    return _round(zonal_stats(values(spark, sf_dir), back, ["count", "mean"], None, ["id", "variety", "max"], kinds="P"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "zonal_mean_count": _stats(["count", "mean"]),
    "zonal_sums_extremes": _stats(["sum", "min", "max"]),
    "zonal_variance": _stats(["variance", "stdev", "coefficient_of_variation"], value="p_retailprice"),
    "zonal_quantiles": _stats(["median", "quantile(q=0.25)", "quantile(q=0.9)"]),
    "zonal_quantiles_float": _stats(["median", "quantile(q=0.25)"], value="p_retailprice"),
    "zonal_wide_runs": _stats(["count", "sum", "mean", "a=count(coverage_weight=area_spherical_km2)", "b=sum(coverage_weight=none,min_coverage_frac=0.5)"], value="p_retailprice", wide=True),
    "zonal_wide_runs_weighted": _stats(["weighted_sum(default_weight=0)", "weighted_mean(default_weight=0)", "weighted_count(default_weight=0)", "a=weighted_sum"], weighted=True, wide=True),
    "zonal_quantiles_skewed": skewed_quantiles,
    "zonal_modes": _stats(["mode", "majority", "minority", "variety"]),
    "zonal_shares": _stats(["unique", "frac", "weighted_frac(default_weight=0)"], weighted=True, flat=True),
    "zonal_weighted": _stats(["weighted_sum(default_weight=0)", "weighted_mean(default_weight=0)", "weighted_variance(default_weight=0)", "weighted_stdev(default_weight=0)"], weighted=True),
    "zonal_weighted_missing": _stats(["weighted_mean", "weighted_sum"], weighted=True),
    "zonal_arrays": _stats(["cell_id", "values", "coverage", "weights(default_weight=-1)", "center_x", "center_y"], weighted=True, flat=True),
    "zonal_extreme_places": _stats(["min_center_x", "min_center_y", "max_center_x", "max_center_y"]),
    "zonal_min_coverage": _stats(["count(min_coverage_frac=0.5)", "variety(min_coverage_frac=0.5)"]),
    "zonal_coverage_weights": _stats(["a=count(coverage_weight=none)", "b=sum(coverage_weight=area_cartesian)", "c=count(coverage_weight=area_spherical_km2)"]),
    "zonal_default_value": _stats(["count(default_value=7)", "sum(default_value=7)"]),
    "zonal_category": _stats(["n=count_of(v=3)", "share=frac_of(v=3)"]),
    "zonal_common_grid": common_resolution,
    "zonal_shares_map": value_shares_map,
    "coverage_cells": coverage_cells,
    "line_lengths": line_lengths,
    "subdivide_areas": subdivided,
    "subdivide_wide": subdivided_wide,
    "zonal_user_function": user_function,
    "coverage_by_clipping": coverage_cells,
    "zonal_grouped_features": grouped_features,
    "zonal_multipolygons": multipolygons,
    "zonal_nodata_scaled": nodata_scaled,
    "zonal_sphere_areas": sphere_areas,
    "zonal_bands": many_bands,
    "zonal_bands_wide": many_bands_wide,
    "zonal_bands_filled": many_bands_filled,
    "zonal_tiles": tiled_raster,
    "zonal_block_variance": _blocks(MOMENT_OPS),
    "zonal_stream_tiles": zones_over_arriving_tiles,
    "zonal_block_weighted": _blocks(["weighted_variance", "weighted_stdev", "weighted_mean", "weighted_count"], weighted=True),
    "zonal_wkb": zones_in_wkb,
    "tile_index": tile_index,
    "zonal_tiles_wide": tiles_of_wide_zones,
    "zonal_frac_as_map": shares_as_maps,
    "zonal_lines": line_statistics,
    "zonal_nested": nested_arrays,
    "features_geojson": features_as_geojson,
    "features_shapefile": features_in_shapefiles,
}

_EDGES = ", ".join(f"({s}, {-1 if i else 1}, {float(a[0])}, {float(a[1])}, {float(b[0])}, {float(b[1])})" for s, rings in SHAPES.items() for i, r in enumerate(rings) for a, b in zip(r, r[1:] + r[:1]))

_ZONES = f"""
p0 AS (SELECT CAST((max(p_partkey) // 50 + 2) // 2 * 2 AS INT) nr FROM part),
vals AS (SELECT CAST(floor(p_partkey / 50) AS INT) r, CAST(p_partkey % 50 AS INT) c, p_size x, p_retailprice y FROM part WHERE p_size % 10 <> 0),
wts AS (SELECT CAST(floor(c_custkey / 25) AS INT) r2, CAST(c_custkey % 25 AS INT) c2, floor(c_acctbal / 1000) w FROM customer WHERE c_acctbal >= 0),
tpl(shape, sg, fx, fy, gx, gy) AS (VALUES {_EDGES}),
z AS (SELECT s_suppkey id, s_suppkey % 4 shape, nr, CASE WHEN s_suppkey % 10 = 9 THEN 1000.0 WHEN s_suppkey % 10 = 8 THEN -0.5 ELSE (s_suppkey * 37 % 368) / 8 END zx,
  (s_suppkey * 53 % (nr * 8 - 16)) / 8 zy, 1 + (s_suppkey % 5) * 0.625 zw, 1 + (s_suppkey % 3) * 0.5 zh FROM supplier, p0),
e AS (SELECT id, CAST(sg AS DOUBLE) sg, CAST(zx + zw * fx AS DOUBLE) u0, CAST(nr - (zy + zh * fy) AS DOUBLE) v0, CAST(zx + zw * gx AS DOUBLE) u1, CAST(nr - (zy + zh * gy) AS DOUBLE) v1, 50 nc, nr FROM z JOIN tpl ON z.shape = tpl.shape)"""

_CELLS = (
    "WITH"
    + _ZONES
    + """,
ev AS (SELECT *, CAST(greatest(floor(least(v0, v1)), 0) AS INT) ra, CAST(least(ceil(greatest(v0, v1)) - 1, nr - 1) AS INT) rb FROM e WHERE v0 <> v1),
r1 AS (SELECT *, unnest(generate_series(ra, rb)) r FROM ev WHERE ra <= rb),
r2 AS (SELECT *, least(greatest(v0, r), r + 1) va, least(greatest(v1, r), r + 1) vb FROM r1),
r3 AS (SELECT id, sg, r, nc, va, vb, u0 + (va - v0) * (u1 - u0) / (v1 - v0) ua, u0 + (vb - v0) * (u1 - u0) / (v1 - v0) ub FROM r2),
c0 AS (SELECT *, CAST(greatest(floor(least(ua, ub)), -1) AS INT) ca, CAST(least(greatest(ceil(greatest(ua, ub)) - 1, floor(least(ua, ub)), -1), nc - 1) AS INT) cb FROM r3),
c1 AS (SELECT *, unnest(generate_series(ca, cb)) c FROM c0 WHERE ca <= cb),
c2 AS (SELECT *, CASE WHEN c = -1 THEN least(ua, 0) ELSE least(greatest(ua, c), c + 1) END pa, CASE WHEN c = -1 THEN least(ub, 0) ELSE least(greatest(ub, c), c + 1) END pb FROM c1),
c3 AS (SELECT id, r, c, nc, pa, pb, sg * (CASE WHEN ua = ub THEN vb - va ELSE (pb - pa) * (vb - va) / (ub - ua) END) dv FROM c2),
k AS (SELECT id, r, c, nc, sum(CASE WHEN c >= 0 THEN dv * (c + 1 - (pa + pb) / 2) ELSE 0 END) a, sum(dv) cv FROM c3 GROUP BY id, r, c, nc),
rn AS (SELECT *, sum(cv) OVER (PARTITION BY id, r ORDER BY c) run, lead(c) OVER (PARTITION BY id, r ORDER BY c) nx FROM k),
cells AS (SELECT id, r, c, a + run - cv cov FROM rn WHERE c >= 0 UNION ALL SELECT id, r, unnest(generate_series(c + 1, coalesce(nx, nc) - 1)) c, run cov FROM rn WHERE abs(run) > 1e-9 AND c + 1 <= coalesce(nx, nc) - 1),
cov AS (SELECT id, r, c, CAST(cov AS FLOAT) fc, CAST(CAST(cov AS FLOAT) AS DOUBLE) cov FROM cells WHERE abs(cov) > 1e-9),
m AS (SELECT cov.*, vals.x, vals.y, wts.w FROM cov LEFT JOIN vals ON cov.r = vals.r AND cov.c = vals.c LEFT JOIN wts ON CAST(floor(cov.r / 2) AS INT) = wts.r2 AND CAST(floor(cov.c / 2) AS INT) = wts.c2),
j AS (SELECT * FROM m WHERE x IS NOT NULL)
"""
)

#: The same cells of the wide zones.
_WIDE = _CELLS.replace("(s_suppkey % 5) * 0.625", "(s_suppkey % 5) * 10.125").replace("(s_suppkey % 3) * 0.5", "(s_suppkey % 3) * 6.5")

_ALL = "SELECT s_suppkey AS id, {} FROM supplier LEFT JOIN g ON s_suppkey = g.id"


def _oracle(grouped: str, columns: str, source: str = "j", cells: str = _CELLS) -> str:
    return f"{cells}, g AS (SELECT id, {grouped} FROM {source} GROUP BY id) " + _ALL.format(columns)


def _quantile_oracle(value: str, names: dict[str, float], whole: bool, cells: str | None = None) -> str:
    cast = (lambda s: f"CAST(trunc({s}) AS INT)") if whole else (lambda s: f"round({s}, 6)")
    parts = ", ".join(f"arg_max(CASE WHEN sr IS NULL THEN x ELSE x + ({q} * sw * (n - 1) - s) * (xr - x) / (sr - s) END, s) FILTER (WHERE s <= {q} * sw * (n - 1)) {n}" for n, q in names.items())
    return f"""{cells or _CELLS}, hist AS (SELECT id, CAST({value} AS DOUBLE) x, sum(cov) wt FROM j GROUP BY id, {value}),
qa AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x) - 1 i, count(*) OVER (PARTITION BY id) n, sum(wt) OVER (PARTITION BY id) sw, coalesce(sum(wt) OVER (PARTITION BY id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) pc FROM hist),
qb AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE i * wt + (n - 1) * pc END s FROM qa),
qc AS (SELECT *, lead(x) OVER (PARTITION BY id ORDER BY x) xr, lead(s) OVER (PARTITION BY id ORDER BY x) sr FROM qb),
g AS (SELECT id, {parts} FROM qc GROUP BY id) """ + _ALL.format(", ".join(f"{cast(n)} AS {n}" for n in names))


_SPHERE = "CAST(6378137.0 * 6378137.0 * pi() / 180 * 1e-6 * abs(sin(radians((SELECT nr FROM p0) - (r + 1.0))) - sin(radians((SELECT nr FROM p0) - CAST(r AS DOUBLE)))) AS FLOAT)"
_LINE = """WITH""" + _ZONES.replace("JOIN tpl ON z.shape = tpl.shape)", "JOIN tpl ON z.shape = tpl.shape AND tpl.sg = 1)") + """,
r0 AS (SELECT *, CAST(greatest(floor(least(v0, v1)), 0) AS INT) ra, CAST(least(greatest(ceil(greatest(v0, v1)) - 1, floor(least(v0, v1))), nr - 1) AS INT) rb FROM e),
r0b AS (SELECT * REPLACE (CASE WHEN ra = nr AND least(v0, v1) = nr THEN nr - 1 ELSE ra END AS ra) FROM r0),
r1 AS (SELECT *, unnest(generate_series(ra, rb)) r FROM r0b WHERE ra <= rb),
r2 AS (SELECT id, r, nc, least(greatest(v0, r), r + 1) va, least(greatest(v1, r), r + 1) vb,
  CASE WHEN v0 = v1 THEN u0 ELSE u0 + (least(greatest(v0, r), r + 1) - v0) * (u1 - u0) / (v1 - v0) END ua,
  CASE WHEN v0 = v1 THEN u1 ELSE u0 + (least(greatest(v1, r), r + 1) - v0) * (u1 - u0) / (v1 - v0) END ub FROM r1),
c0 AS (SELECT *, CAST(greatest(floor(least(ua, ub)), 0) AS INT) ca, CAST(least(greatest(ceil(greatest(ua, ub)) - 1, floor(least(ua, ub))), nc - 1) AS INT) cb FROM r2),
c0b AS (SELECT * REPLACE (CASE WHEN ca = nc AND least(ua, ub) = nc THEN nc - 1 ELSE ca END AS ca) FROM c0),
c1 AS (SELECT *, unnest(generate_series(ca, cb)) c FROM c0b WHERE ca <= cb),
c2 AS (SELECT id, r, c, CASE WHEN ua = ub THEN 0 ELSE least(greatest(ub, c), c + 1) - least(greatest(ua, c), c + 1) END du,
  CASE WHEN ua = ub THEN vb - va ELSE (least(greatest(ub, c), c + 1) - least(greatest(ua, c), c + 1)) * (vb - va) / (ub - ua) END dv FROM c1),
l AS (SELECT id, r, c, sum(sqrt(du * du + dv * dv)) len FROM c2 GROUP BY id, r, c HAVING sum(sqrt(du * du + dv * dv)) > 1e-9)
SELECT id, round(sum(CAST(CAST(len AS FLOAT) AS DOUBLE)), 6) AS length, count(*) AS cells FROM l GROUP BY id"""

ORACLES: dict[str, str] = {
    "zonal_mean_count": _oracle("sum(cov) n, sum(x * cov) s", "round(coalesce(n, 0), 6) AS count, round(s / n, 6) AS mean"),
    "zonal_sums_extremes": _oracle("sum(x * cov) s, min(x) lo, max(x) hi", "round(coalesce(s, 0), 6) AS sum, lo AS min, hi AS max"),
    "zonal_variance": f"{_CELLS}, mu AS (SELECT id, sum(y * cov) / sum(cov) mu FROM j GROUP BY id), g AS (SELECT j.id, any_value(mu) mu, sum(cov * (y - mu) * (y - mu)) / sum(cov) v FROM j JOIN mu ON j.id = mu.id GROUP BY j.id) " + _ALL.format("round(v, 6) AS variance, round(sqrt(v), 6) AS stdev, round(sqrt(v) / mu, 6) AS coefficient_of_variation"),
    "zonal_quantiles": _quantile_oracle("x", {"median": 0.5, "quantile_25": 0.25, "quantile_90": 0.9}, True),
    "zonal_quantiles_float": _quantile_oracle("y", {"median": 0.5, "quantile_25": 0.25}, False),
    "zonal_wide_runs": _oracle(f"sum(cov) n, sum(y * cov) s, sum(CAST(fc * {_SPHERE} AS DOUBLE)) a, sum(CASE WHEN fc >= 0.5 THEN y END) b", "round(coalesce(n, 0), 6) AS count, round(coalesce(s, 0), 6) AS sum, round(s / n, 6) AS mean, round(coalesce(a, 0), 6) AS a, round(coalesce(b, 0), 6) AS b", cells=_WIDE),
    "zonal_wide_runs_weighted": _oracle("sum(x * cov * coalesce(w, 0)) s, sum(cov * coalesce(w, 0)) n, CASE WHEN count(*) = count(w) THEN sum(x * cov * w) END a, 1 AS one", "round(coalesce(s, 0), 6) AS weighted_sum, CASE WHEN n <> 0 THEN round(s / n, 6) END AS weighted_mean, round(coalesce(n, 0), 6) AS weighted_count, round(CASE WHEN one IS NULL THEN 0 ELSE a END, 6) AS a", cells=_WIDE),
    "zonal_quantiles_skewed": _quantile_oracle("y", {"median": 0.5, "low": 0.1, "high": 0.99}, False, _WIDE.replace("p_retailprice y FROM part WHERE p_size % 10 <> 0", "p_retailprice * power(10.0, CAST(p_partkey % 13 - 6 AS DOUBLE)) y FROM part")),
    "zonal_modes": f"{_CELLS}, h AS (SELECT id, x, sum(cov) sc FROM j GROUP BY id, x), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sc DESC, x DESC) up, row_number() OVER (PARTITION BY id ORDER BY sc, x) down FROM h), g AS (SELECT id, max(x) FILTER (WHERE up = 1) m, max(x) FILTER (WHERE down = 1) l, count(*) v FROM rk GROUP BY id) " + _ALL.format('m AS mode, m AS majority, l AS minority, coalesce(v, 0) AS variety'),
    "zonal_shares": f"{_CELLS}, h AS (SELECT id, x, sum(cov) sc, sum(cov * coalesce(w, 0)) sw FROM j GROUP BY id, x) SELECT id, x AS \"unique\", round(sc / sum(sc) OVER (PARTITION BY id), 6) AS frac, CASE WHEN sum(sw) OVER (PARTITION BY id) <> 0 THEN round(sw / sum(sw) OVER (PARTITION BY id), 6) END AS weighted_frac FROM h",
    "zonal_weighted": f"{_CELLS}, t AS (SELECT *, cov * coalesce(w, 0) cw FROM j), mu AS (SELECT id, sum(x * cw) t, sum(cw) n, CASE WHEN sum(cw) <> 0 THEN sum(x * cw) / sum(cw) END mu FROM t GROUP BY id), g AS (SELECT t.id, any_value(mu.t) s, any_value(mu) mu, any_value(n) n, CASE WHEN any_value(n) <> 0 THEN sum(cw * (x - mu) * (x - mu)) / any_value(n) END v FROM t JOIN mu ON t.id = mu.id GROUP BY t.id) " + _ALL.format("round(coalesce(s, 0), 6) AS weighted_sum, round(mu, 6) AS weighted_mean, round(v, 6) AS weighted_variance, round(sqrt(v), 6) AS weighted_stdev"),
    "zonal_weighted_missing": _oracle("CASE WHEN count(*) = count(w) THEN sum(x * cov * w) END s, CASE WHEN count(*) = count(w) AND sum(cov * w) <> 0 THEN sum(x * cov * w) / sum(cov * w) END mu, 1 AS one", "round(mu, 6) AS weighted_mean, round(CASE WHEN one IS NULL THEN 0 ELSE s END, 6) AS weighted_sum"),
    "zonal_arrays": f'{_CELLS} SELECT id, CAST(r * 50 + c AS BIGINT) AS cell_id, x AS "values", round(cov, 6) AS coverage, coalesce(w, -1) AS weights, c + 0.5 AS center_x, (SELECT nr FROM p0) - (r + 0.5) AS center_y FROM j'.replace("c + 0.5 AS", "CAST(c + 0.5 AS DOUBLE) AS").replace("(SELECT nr FROM p0) - (r + 0.5) AS", "CAST((SELECT nr FROM p0) - (r + 0.5) AS DOUBLE) AS"),
    "zonal_extreme_places": f"{_CELLS}, rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x, r, c) lo, row_number() OVER (PARTITION BY id ORDER BY x DESC, r, c) hi FROM j), g AS (SELECT id, CAST(max(c + 0.5) FILTER (WHERE lo = 1) AS DOUBLE) a, CAST((SELECT nr FROM p0) - max(r + 0.5) FILTER (WHERE lo = 1) AS DOUBLE) b, CAST(max(c + 0.5) FILTER (WHERE hi = 1) AS DOUBLE) c, CAST((SELECT nr FROM p0) - max(r + 0.5) FILTER (WHERE hi = 1) AS DOUBLE) d FROM rk GROUP BY id) " + _ALL.format("a AS min_center_x, b AS min_center_y, c AS max_center_x, d AS max_center_y"),
    "zonal_min_coverage": _oracle("sum(cov) n, count(DISTINCT x) v", "round(coalesce(n, 0), 6) AS count, coalesce(v, 0) AS variety", "(SELECT * FROM j WHERE fc >= 0.5)"),
    "zonal_coverage_weights": _oracle(f"CAST(count(*) AS DOUBLE) a, sum(x * cov) b, sum(CAST(fc * {_SPHERE} AS DOUBLE)) c", "coalesce(a, 0) AS a, round(coalesce(b, 0), 6) AS b, round(coalesce(c, 0), 6) AS c"),
    "zonal_default_value": _oracle("sum(cov) n, sum(coalesce(x, 7) * cov) s", "round(coalesce(n, 0), 6) AS count, round(coalesce(s, 0), 6) AS sum", "m"),
    "zonal_category": _oracle("sum(CASE WHEN x = 3 THEN cov ELSE 0 END) k, sum(cov) n", "round(coalesce(k, 0), 6) AS n, round(k / g.n, 6) AS share"),
    "zonal_common_grid": f"{_CELLS}, g AS (SELECT id, sum(CASE WHEN x IS NOT NULL THEN cov END) a, sum(x * cov) b, sum(CASE WHEN w IS NOT NULL THEN cov END) c, sum(w * cov) d FROM m GROUP BY id) " + _ALL.format("round(coalesce(a, 0), 6) AS v_count, round(coalesce(c, 0), 6) AS w_count, round(coalesce(b, 0), 6) AS v_sum, round(coalesce(d, 0), 6) AS w_sum"),
    "zonal_shares_map": f"{_CELLS}, h AS (SELECT id, x, sum(cov) sc FROM j GROUP BY id, x) SELECT id, x AS value, round(sc / sum(sc) OVER (PARTITION BY id), 6) AS share FROM h",
    "coverage_cells": f"{_CELLS} SELECT id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, round(cov, 6) AS coverage, x AS value, w AS weight FROM m",
    "line_lengths": _LINE,
    "subdivide_areas": f"{_CELLS} SELECT id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, round(cov, 6) AS area FROM cov",
    "subdivide_wide": f"{_WIDE} SELECT id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, round(cov, 6) AS area FROM cov",
    "zonal_user_function": _oracle("max(x) - min(x) s", "CAST(s AS DOUBLE) AS spread"),
    "zonal_grouped_features": f"{_CELLS}, mu AS (SELECT id, sum(cov) n, sum(x * cov) / sum(cov) mu FROM j GROUP BY id), g AS (SELECT j.id, any_value(n) n, any_value(mu) mu, sum(cov * (x - mu) * (x - mu)) / any_value(n) v FROM j JOIN mu ON j.id = mu.id GROUP BY j.id) " + _ALL.format("CAST(2 AS BIGINT) AS copies, round(coalesce(n, 0), 6) AS count, round(mu, 6) AS mean, round(v, 6) AS variance"),
    "zonal_nodata_scaled": f"{_CELLS}, p AS (SELECT CAST(floor(p_partkey / 50) AS INT) r, CAST(p_partkey % 50 AS INT) c, p_size * 2.5 - 4 x FROM part WHERE p_size <> 13), g AS (SELECT id, sum(cov) n, sum(x * cov) s, max(x) hi FROM cov JOIN p ON cov.r = p.r AND cov.c = p.c GROUP BY id) " + _ALL.format("round(coalesce(n, 0), 6) AS count, CAST(round(coalesce(s, 0), 6) AS DOUBLE) AS sum, CAST(hi AS DOUBLE) AS max"),
    "zonal_sphere_areas": _oracle(f"sum(CAST(fc * {_SPHERE.replace('1e-6', '1.0')} AS DOUBLE)) s", "round(coalesce(s, 0) / 1e6, 4) AS km2"),
    "zonal_tiles": _oracle("sum(cov) n, sum(x * cov) s", "round(coalesce(n, 0), 6) AS count, round(s / n, 6) AS mean"),
    "zonal_block_variance": f"{_WIDE}, mu AS (SELECT id, sum(y * cov) / sum(cov) mu FROM j GROUP BY id), g AS (SELECT j.id, any_value(mu) mu, sum(cov) n, min(y) lo, max(y) hi, sum(cov * (y - mu) * (y - mu)) / sum(cov) v FROM j JOIN mu ON j.id = mu.id GROUP BY j.id) " + _ALL.format("round(v, 6) AS variance, round(sqrt(v), 6) AS stdev, round(sqrt(v) / mu, 6) AS coefficient_of_variation, round(coalesce(n, 0), 6) AS count, round(mu, 6) AS mean, round(lo, 6) AS min, round(hi, 6) AS max"),
    "zonal_block_weighted": f"{_WIDE}, mu AS (SELECT id, sum(cov * x) n, sum(y * cov * x) / sum(cov * x) mu FROM j GROUP BY id), g AS (SELECT j.id, any_value(mu) mu, any_value(n) n, sum(cov * x * (y - mu) * (y - mu)) / any_value(n) v FROM j JOIN mu ON j.id = mu.id GROUP BY j.id) " + _ALL.format("round(v, 6) AS weighted_variance, round(sqrt(v), 6) AS weighted_stdev, round(mu, 6) AS weighted_mean, CAST(round(coalesce(n, 0), 6) AS DOUBLE) AS weighted_count"),
    "zonal_wkb": _oracle("sum(cov) n, sum(x * cov) s", "round(coalesce(n, 0), 6) AS count, round(s / n, 6) AS mean"),
    "tile_index": f"{_WIDE}, t AS (SELECT id, r, c FROM k WHERE c >= 0 UNION ALL SELECT id, r, unnest(generate_series(c + 1, coalesce(nx, nc) - 1)) FROM rn WHERE abs(run) > 1e-9 AND c + 1 <= coalesce(nx, nc) - 1) SELECT DISTINCT id, CAST(r // 4 AS INT) AS tile_row, CAST(c // 4 AS INT) AS tile_col FROM t",
    "zonal_tiles_wide": f"{_WIDE}, a AS (SELECT cov.id, cov.cov, p_retailprice y FROM cov JOIN part ON r = p_partkey // 50 AND c = p_partkey % 50), g AS (SELECT id, sum(cov) n, sum(y * cov) s, max(y) hi FROM a GROUP BY id) " + _ALL.format("round(coalesce(n, 0), 6) AS count, round(s / n, 6) AS mean, round(hi, 6) AS max"),
    "zonal_frac_as_map": f"{_CELLS}, h AS (SELECT id, x, sum(cov) sc, sum(cov * coalesce(w, 0)) sw FROM j GROUP BY id, x) SELECT id, x AS value, round(sc / sum(sc) OVER (PARTITION BY id), 6) AS share, CASE WHEN sum(sw) OVER (PARTITION BY id) <> 0 THEN round(sw / sum(sw) OVER (PARTITION BY id), 6) END AS weighted_share FROM h",
    "zonal_nested": f"{_CELLS}, g AS (SELECT id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY r, c) v, string_agg(CAST(r * 50 + c AS VARCHAR), ',' ORDER BY r, c) k FROM j GROUP BY id) " + _ALL.format("coalesce(v, '') AS \"values\", coalesce(k, '') AS cell_id"),
    "zonal_lines": _LINE[: _LINE.rindex("SELECT id,")].rstrip() + ", g AS (SELECT id, sum(len) n, sum(len * x) s, max(x) hi FROM (SELECT l.id, x, CAST(CAST(len AS FLOAT) AS DOUBLE) len FROM l JOIN vals ON l.r = vals.r AND l.c = vals.c) GROUP BY id) " + _ALL.format("round(coalesce(n, 0), 6) AS count, round(s / n, 6) AS mean, hi AS max"),
    # no sweep here: overlaps of boxes, and for the diamond the integral over x between its break points
    "coverage_by_clipping": "WITH" + _ZONES + """,
b AS (SELECT z.id, nr, sg, zx + zw * ax x0, zx + zw * bx x1, zy + zh * ay y0, zy + zh * byy y1 FROM z JOIN (VALUES (0, 1, 0, 0, 1, 1), (2, 1, 0, 0, 1, 0.5), (2, 1, 0, 0.5, 0.5, 1), (3, 1, 0, 0, 1, 1), (3, -1, 0.25, 0.25, 0.75, 0.75)) t(shape, sg, ax, ay, bx, byy) ON z.shape = t.shape),
bc AS (SELECT *, unnest(generate_series(CAST(greatest(floor(x0), 0) AS INT), CAST(least(ceil(x1), 50) AS INT) - 1)) c FROM b),
bb AS (SELECT *, unnest(generate_series(CAST(greatest(floor(nr - y1), 0) AS INT), CAST(least(ceil(nr - y0), nr) AS INT) - 1)) r FROM bc),
ba AS (SELECT id, r, c, CAST(sum(sg * greatest(least(x1, c + 1) - greatest(x0, c), 0) * greatest(least(y1, nr - r) - greatest(y0, nr - r - 1), 0)) AS DOUBLE) cov FROM bb GROUP BY id, r, c),
d AS (SELECT id, nr, CAST(zx + zw / 2 AS DOUBLE) mx, CAST(zy + zh / 2 AS DOUBLE) my, CAST(zw / 2 AS DOUBLE) a, CAST(zh / 2 AS DOUBLE) b FROM z WHERE shape = 1),
dc AS (SELECT *, unnest(generate_series(CAST(greatest(floor(mx - a), 0) AS INT), CAST(least(ceil(mx + a), 50) AS INT) - 1)) c FROM d),
dd AS (SELECT *, unnest(generate_series(CAST(greatest(floor(nr - my - b), 0) AS INT), CAST(least(ceil(nr - my + b), nr) AS INT) - 1)) r FROM dc),
dk AS (SELECT *, nr - r - 1 lo, nr - r hi, unnest([c, c + 1, mx, mx - a, mx + a, mx - a * (1 - abs(nr - r - my) / b), mx + a * (1 - abs(nr - r - my) / b), mx - a * (1 - abs(nr - r - 1 - my) / b), mx + a * (1 - abs(nr - r - 1 - my) / b)]) k FROM dd),
dx AS (SELECT DISTINCT id, r, c, mx, my, a, b, lo, hi, least(greatest(k, c), c + 1) k FROM dk),
df AS (SELECT *, greatest(least(my + b * (1 - abs(k - mx) / a), hi) - greatest(my - b * (1 - abs(k - mx) / a), lo), 0) f FROM dx),
dt AS (SELECT id, r, c, (lead(k) OVER w - k) * (f + lead(f) OVER w) / 2 area FROM df WINDOW w AS (PARTITION BY id, r, c ORDER BY k)),
cv AS (SELECT * FROM ba UNION ALL SELECT id, r, c, sum(area) FROM dt GROUP BY id, r, c)
SELECT cv.id, CAST(cv.r AS INT) AS row, CAST(cv.c AS INT) AS col, round(CAST(CAST(cov AS FLOAT) AS DOUBLE), 6) AS coverage, x AS value, w AS weight FROM cv
LEFT JOIN vals ON cv.r = vals.r AND cv.c = vals.c LEFT JOIN wts ON CAST(floor(cv.r / 2) AS INT) = wts.r2 AND CAST(floor(cv.c / 2) AS INT) = wts.c2 WHERE cov > 1e-9""",
    "zonal_multipolygons": """WITH p0 AS (SELECT CAST((max(p_partkey) // 50 + 2) // 2 * 2 AS INT) nr FROM part),
vals AS (SELECT CAST(floor(p_partkey / 50) AS INT) r, CAST(p_partkey % 50 AS INT) c, p_size x FROM part WHERE p_size % 10 <> 0),
b AS (SELECT s_suppkey id, nr, (s_suppkey * 29 % 320) / 8 + dx x0, (s_suppkey * 41 % (nr * 8 - 24)) / 8 y0 FROM supplier, p0, (VALUES (0.0), (6.0)) t(dx)),
o AS (SELECT id, x, greatest(least(x0 + 1.5, c + 1) - greatest(x0, c), 0) * greatest(least(y0 + 2.25, nr - r) - greatest(y0, nr - r - 1), 0) cov FROM b JOIN vals ON c BETWEEN floor(x0) AND floor(x0 + 1.5) AND r BETWEEN floor(nr - y0 - 2.25) AND floor(nr - y0)),
g AS (SELECT id, sum(cov) n, sum(x * cov) s FROM o GROUP BY id) """ + _ALL.format("CAST(round(coalesce(n, 0), 6) AS DOUBLE) AS count, CAST(round(coalesce(s, 0), 6) AS DOUBLE) AS sum"),
    "zonal_bands": f"{_CELLS}, pb AS (SELECT band, CAST(floor(p_partkey / 50) AS INT) r, CAST(p_partkey % 50 AS INT) c, p_size * band % 11 x FROM part, generate_series(1, 4) t(band) WHERE p_size % 10 <> band), jb AS (SELECT id, band, cov, pb.x FROM cov JOIN pb ON cov.r = pb.r AND cov.c = pb.c), mu AS (SELECT id, band, sum(cov) n, sum(x * cov) / sum(cov) mu, count(DISTINCT x) k FROM jb GROUP BY id, band), g AS (SELECT jb.id, jb.band, any_value(n) n, any_value(mu) mu, any_value(k) k, sum(cov * (x - mu) * (x - mu)) / any_value(n) v FROM jb JOIN mu ON jb.id = mu.id AND jb.band = mu.band GROUP BY jb.id, jb.band) SELECT s_suppkey AS id, CAST(t.band AS INT) AS band, round(coalesce(n, 0), 6) AS count, round(mu, 6) AS mean, coalesce(k, 0) AS variety, round(v, 6) AS variance FROM supplier CROSS JOIN generate_series(1, 4) t(band) LEFT JOIN g ON s_suppkey = g.id AND t.band = g.band",
    "zonal_bands_wide": f"{_CELLS}, pb AS (SELECT band, CAST(floor(p_partkey / 50) AS INT) r, CAST(p_partkey % 50 AS INT) c, p_size * band % 11 x FROM part, generate_series(1, 3) t(band) WHERE p_size % 10 <> band), g AS (SELECT id, " + ", ".join(f"sum(CASE WHEN band = {k} THEN cov END) n{k}, sum(CASE WHEN band = {k} THEN cov * pb.x END) s{k}" for k in (1, 2, 3)) + " FROM cov JOIN pb ON cov.r = pb.r AND cov.c = pb.c GROUP BY id) " + _ALL.format(", ".join(f"round(coalesce(n{k}, 0), 6) AS band_{k}_count, round(coalesce(s{k}, 0), 6) AS band_{k}_sum" for k in (1, 2, 3))),
    "features_geojson": f"""{_CELLS}, g AS (SELECT id, count(DISTINCT x) v, max(x) hi FROM j GROUP BY id),
corner(shape, k, fx, fy) AS (VALUES {", ".join(f"({s}, {k}, {float(p[0])}, {float(p[1])})" for s in (0, 1, 2) for k, p in enumerate([*SHAPES[s][0], SHAPES[s][0][0]]))}),
shape AS (SELECT id, string_agg('[' || CAST(CAST(zx + zw * fx AS DOUBLE) AS VARCHAR) || ', ' || CAST(CAST(zy + zh * fy AS DOUBLE) AS VARCHAR) || ']', ', ' ORDER BY k) p FROM z JOIN corner ON z.shape = corner.shape GROUP BY id)
SELECT '{{"type":"Feature","id":' || s.id || ',"geometry":{{"type": "Polygon", "coordinates": [[' || p || ']]}},"properties":{{"variety":' || coalesce(v, 0) || ',"max":' || coalesce(CAST(hi AS VARCHAR), 'null') || '}}}}' AS value FROM shape s LEFT JOIN g ON s.id = g.id""",
}
ORACLES["features_shapefile"] = _oracle("sum(cov) n, sum(x * cov) s, count(DISTINCT x) v, max(x) hi", "coalesce(v, 0) AS variety, hi AS max, round(coalesce(n, 0), 6) AS count, round(s / n, 6) AS mean")
ORACLES["zonal_bands_filled"] = f"{_CELLS}, pb AS (SELECT band, CAST(floor(p_partkey / 50) AS INT) r, CAST(p_partkey % 50 AS INT) c, p_size * band % 11 x FROM part, generate_series(1, 3) t(band) WHERE p_size % 10 <> band), jb AS (SELECT id, t.band, cov, pb.x, coalesce(pb.x, 7) y FROM cov CROSS JOIN generate_series(1, 3) t(band) LEFT JOIN pb ON cov.r = pb.r AND cov.c = pb.c AND t.band = pb.band), g AS (SELECT id, " + ", ".join(f"sum(CASE WHEN band = {k} THEN cov * y END) / sum(CASE WHEN band = {k} THEN cov END) m{k}, max(x) FILTER (WHERE band = {k}) x{k}, count(DISTINCT y) FILTER (WHERE band = {k}) v{k}" for k in (1, 2, 3)) + " FROM jb GROUP BY id) " + _ALL.format(", ".join([*(f"round(m{k}, 6) AS band_{k}_mean" for k in (1, 2, 3)), *(f"x{k} AS band_{k}_max" for k in (1, 2, 3)), *(f"coalesce(v{k}, 0) AS band_{k}_variety" for k in (1, 2, 3))]))
# what counts is the last version of each tile, that is the raster of the blocks
ORACLES["zonal_stream_tiles"] = ORACLES["zonal_block_variance"]
