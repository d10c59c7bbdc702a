"""Sinks: flat or nested tables, GeoJSON, dictionaries, pandas."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.sources import shapefile
from gridloom.sources.geometry import to_geojson


def _arrays(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]


def unnest(df: DataFrame) -> DataFrame:
    """Array columns zipped into rows; scalars repeat, empty arrays give no row, unequal lengths are an error."""
    names = _arrays(df)
    if not names:
        return df
    first = F.size(names[0])
    same = reduce(lambda a, b: a & b, [F.size(n) == first for n in names[1:]], F.lit(True))
    zipped = F.when(same, F.arrays_zip(*[F.col(n) for n in names])).otherwise(F.raise_error(F.lit("Array fields have different lengths.")))
    flat = df.select("*", F.explode(zipped).alias("_row"))
    return flat.select(*[F.col("_row").getField(c).alias(c) if c in names else F.col(c) for c in df.columns])


def map_fields(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """New map columns from pairs of array columns ``name -> (keys, values)``, which go."""
    used = {c for pair in fields.values() for c in pair}
    return df.select(*[c for c in df.columns if c not in used], *[F.map_from_arrays(F.col(k), F.col(v)).alias(n) for n, (k, v) in fields.items()])


def union_fields(tables: list[DataFrame]) -> DataFrame:
    """Rows of several results with the union of their columns; a missing one is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def with_id(df: DataFrame, column: str, name: str | None = None, kind: str | None = None) -> DataFrame:
    """An id column renamed and cast; both must be given, or neither."""
    if (name is None) != (kind is None):
        raise ValueError("Must specify both --id-type and --id-name")
    if name is None:
        return df
    return df.select(*[F.col(c).cast({"int32": "int", "int64": "bigint", "text": "string", "float64": "double"}.get(kind, kind)).alias(name) if c == column else F.col(c) for c in df.columns])


def _shapes(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield s.map(lambda g: to_geojson(bytes(g) if isinstance(g, (bytearray, memoryview)) else g) if g is not None else None).astype(object)


def geojson(df: DataFrame, geometry: str | None = None, identity: str | None = None) -> DataFrame:
    """One GeoJSON feature for each row, as text in column ``value``.

    Geometry that is GeoJSON text or null stays as it is; WKT and WKB are converted.
    """
    rest = [c for c in df.columns if c not in (geometry, identity)]
    properties = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    head = F.lit('{"type":"Feature",')
    mark = F.concat(F.lit('"id":'), F.to_json(F.struct(F.col(identity).alias("id"))).substr(F.lit(7), F.length(F.to_json(F.struct(F.col(identity).alias("id")))) - 7), F.lit(",")) if identity else F.lit("")
    shape = F.lit("null")
    if geometry:
        convert = F.pandas_udf(_shapes, "string")
        g = F.col(geometry)
        if isinstance(df.schema[geometry].dataType, T.StringType):
            plain = F.ltrim(g).startswith("{")
            shape = F.coalesce(F.when(plain, g).otherwise(convert(F.when(~plain, g))), F.lit("null"))
        else:
            shape = F.coalesce(convert(g), F.lit("null"))
    return df.select(F.concat(head, mark, F.lit('"geometry":'), shape, F.lit(',"properties":'), properties, F.lit("}")).alias("value"))


def to_writer(df: DataFrame, writer: Callable[[int], object]) -> int:
    """Give the rows to user-defined writers, one for each partition; gives the count of rows.

    ``writer(partition)`` returns an object with ``write(row as a dict)`` and,
    if it likes, ``finish()``. A partition that runs again gets a new writer,
    so a writer should replace what another of its number has left.
    """
    names = df.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, n = writer(TaskContext.get().partitionId()), 0
        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                to.write(dict(zip(names, row, strict=True)))
                n += 1
        getattr(to, "finish", lambda: None)()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return df.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def records(df: DataFrame, array_type: str = "numpy", geometry: str | None = None, identity: str | None = None) -> list[dict]:
    """Features as dictionaries on the driver; arrays as ``numpy``, ``list`` or ``set``."""
    import numpy as np

    cast = {"numpy": np.array, "list": list, "set": set}[array_type]
    out = []
    for r in df.collect():
        d = r.asDict()
        f: dict = {"type": "Feature"}
        if identity:
            f["id"] = d.pop(identity)
        if geometry:
            g = d.pop(geometry)
            f["geometry"] = json.loads(g) if isinstance(g, str) and g.lstrip().startswith("{") else g
        f["properties"] = {k: cast(v) if isinstance(v, list) else v for k, v in d.items()}
        out.append(f)
    return out


def pandas(df: DataFrame, index: str | None = None):
    """Result as a pandas table; the column ``index`` becomes its index."""
    out = df.toPandas()
    return out.set_index(index) if index else out


def write(df: DataFrame, path: str, nested: bool = False, geometry: str | None = None, mode: str = "errorifexists", **options) -> None:
    """Write by extension: ``.csv``, ``.parquet``, ``.orc``, ``*json`` (GeoJSON), ``.shp`` (a folder of parts), or ``PG:``/``jdbc:`` with ``table=``.

    Flat by default: array columns become rows. A shapefile needs a geometry.
    """
    out = df if nested else unnest(df)
    end = path.lower().rsplit(".", 1)[-1]
    if path.startswith(("PG:", "jdbc:")):
        url = "jdbc:postgresql:" + path[3:] if path.startswith("PG:") else path
        out.write.mode(mode).format("jdbc").options(url=url, dbtable=options.pop("table"), **options).save()
    elif end == "csv":
        plain = out.select(*[F.to_json(c).alias(c) if c in _arrays(out) else F.col(c) for c in out.columns])
        plain.write.mode(mode).options(header="true", **options).csv(path)
    elif end in ("parquet", "orc"):
        out.write.mode(mode).options(**options).format(end).save(path)
    elif end == "shp":
        if geometry is None:
            raise ValueError("A shapefile needs a geometry")
        system, place = shapefile._place(path)
        there = system.get_file_info(place).type != fs.FileType.NotFound
        if there and mode in ("error", "errorifexists"):
            raise ValueError(f"{path} exists already")
        if not (there and mode == "ignore"):
            shapefile.write(out, path, geometry, "overwrite" if mode == "overwrite" else "append")
    elif end.endswith("json"):
        geojson(out, geometry).write.mode(mode).options(**options).text(path)
    else:
        raise ValueError(f"Unknown output format: {path}")
