"""Command line: zonal statistics of Parquet cell tables.

A raster is ``[name:]path[band]`` with its extent and size by ``--grid
xmin,ymin,xmax,ymax,rows,cols`` (one for all, or one for each raster).
"""

from __future__ import annotations

import argparse
import sys

from gridloom.functions.descriptors import parse_descriptor, parse_raster
from gridloom.functions.grid import Box, Grid
from gridloom.plans.bands import Bands, stack
from gridloom.plans.progress import watched
from gridloom.plans.zonal import STRATEGIES, zonal_stats
from gridloom.sources import features as feature_source
from gridloom.sources import output, raster


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("gridloom", description=__doc__, fromfile_prefix_chars="@")
    p.add_argument("-r", "--raster", action="append", required=True)
    p.add_argument("-w", "--weights", action="append", default=[])
    p.add_argument("-g", "--grid", action="append", required=True)
    p.add_argument("-p", "--polygons", required=True)
    p.add_argument("-s", "--stat", action="append", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-f", "--fid")
    p.add_argument("--geometry", default="geometry")
    p.add_argument("--id-name")
    p.add_argument("--id-type")
    p.add_argument("--include-col", action="append", default=[])
    p.add_argument("--include-geom", action="store_true")
    p.add_argument("--nested-output", action="store_true")
    p.add_argument("--nodata", type=float)
    p.add_argument("--strategy", choices=STRATEGIES, default=STRATEGIES[0])
    p.add_argument("--grid-compat-tol", type=float, default=1e-6)
    p.add_argument("--max-cells", type=float, default=30.0, help="millions of cells")
    p.add_argument("--threads", type=int, help="tasks at once on this machine, where no session is given")
    p.add_argument("--progress", action="store_true")
    p.add_argument("--config")
    return p


def _rasters(spark, descriptors: list[str], grids: list[Grid], nodata) -> list:
    out = []
    for i, d in enumerate(descriptors):
        name, path, band = parse_raster(d)
        grid = grids[i % len(grids)]
        cells = spark.read.parquet(path)
        root = name or (f"raster{i}" if len(descriptors) > 1 else "")
        out.append(raster.from_bands(cells, grid, root, only=band or None, nodata=nodata) if "band" in cells.columns else raster.from_table(cells, grid, root, nodata=nodata))
    return out


def _stacked(spark, args, grids: list[Grid], n_weights: int) -> Bands | None:
    """The bands of the only raster as one table, where no statistic names one of them."""
    if len(args.raster) > 1 or n_weights > 1:
        return None
    name, path, band = parse_raster(args.raster[0])
    cells = spark.read.parquet(path)
    if band or "band" not in cells.columns or any(parse_descriptor(s).values for s in args.stat):
        return None
    return stack(cells, grids[0], root=name or "", nodata=args.nodata)


def main(argv: list[str] | None = None, spark=None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if "--config" in argv:
        at = argv.index("--config")
        lines = [x.strip() for x in open(argv[at + 1]) if x.strip() and not x.startswith("#")]
        argv[at : at + 2] = [w for x in lines for w in _option(x)]
    args = parser().parse_args(argv)
    try:
        if args.max_cells <= 0:
            raise ValueError("Invalid value for max-cells")
        if (args.id_name is None) != (args.id_type is None):
            raise ValueError("Must specify both --id-type and --id-name")
        grids = []
        for g in args.grid:
            *box, rows, cols = (float(x) for x in g.split(","))
            grids.append(Grid.of_shape(Box(*box), int(rows), int(cols)))
        if spark is None:
            from pyspark.sql import SparkSession

            builder = SparkSession.builder
            spark = (builder.master(f"local[{args.threads}]") if args.threads else builder).getOrCreate()
        f = feature_source.read(spark, args.polygons, args.geometry)
        cols = [*([args.fid] if args.fid else []), *args.include_col]
        weights = raster.prepare(_rasters(spark, args.weights, grids, None) or None)
        rasters = _stacked(spark, args, grids, len(weights)) or _rasters(spark, args.raster, grids, args.nodata)
        out = zonal_stats(rasters, f, args.stat, weights or None, cols, args.include_geom, args.geometry, strategy=args.strategy, grid_compat_tol=args.grid_compat_tol, max_cells_in_memory=int(args.max_cells * 1e6))
        if args.fid and args.id_name:
            out = output.with_id(out, args.fid, args.id_name, args.id_type)
        write = lambda: output.write(out, args.output, args.nested_output, args.geometry if args.include_geom else None)
        if args.progress:
            watched(spark, write, lambda share, what: print(f"{share:4.0%} {what}", file=sys.stderr))
        else:
            write()
    except Exception as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


def _option(line: str) -> list[str]:
    """A line ``key=value`` of a settings file as command-line words."""
    key, _, value = line.partition("=")
    value = value.strip().strip('"')
    return [f"--{key.strip()}"] if value.lower() == "true" else [f"--{key.strip()}", value]


if __name__ == "__main__":
    sys.exit(main())
