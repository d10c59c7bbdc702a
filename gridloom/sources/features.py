"""Feature sources: tables of attributes with a geometry column."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from gridloom.functions.descriptors import parse_dataset
from gridloom.sources import shapefile
from gridloom.sources.geojson import features as geojson_features


def read(spark: SparkSession, descriptor: str, geometry: str = "geometry", columns: list[str] | None = None, identity: str | None = None, id_name: str | None = None, id_type: str | None = None) -> DataFrame:
    """Features of ``file[layer]``: Parquet, ORC, CSV, shapefiles, GeoJSON lines or a GeoJSON collection.

    Only the columns asked for are read. An id can be renamed and cast on the way.
    """
    path, layer = parse_dataset(descriptor)
    end = path.lower().rstrip("/").rsplit(".", 1)[-1]
    if end in ("parquet", "orc"):
        df = spark.read.format(end).load(path)
    elif end == "csv":
        df = spark.read.option("header", True).csv(path)
    elif end.endswith("json"):
        df = geojson(spark, path, [c for c in [*([identity] if identity else []), *columns] if c not in ("id", geometry)] if columns else None)
    elif end == "shp":
        df = shapefile.read(spark, path, geometry)
    elif layer != "0":
        df = spark.table(layer)
    else:
        raise ValueError(f"Unknown feature source: {descriptor}")
    from gridloom.sources.output import with_id

    wanted = [c for c in dict.fromkeys([*([identity] if identity else []), *(columns or df.columns), geometry]) if c in df.columns]
    df = df.select(*wanted)
    return with_id(df, identity, id_name, id_type) if identity else df


def geojson(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Features of GeoJSON: a collection in each file, or a feature on each line; ``id`` and properties become columns.

    Files of any size are read in ranges by many tasks (``sources/geojson.py``).
    ``names`` are the properties wanted; without, one more pass finds them, as
    any feature may have others.
    """
    f = geojson_features(spark, path).select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.properties").alias("p"), F.get_json_object("value", "$.geometry").alias("geometry"))
    if names is None:
        names = [r[0] for r in f.select(F.explode(F.json_object_keys("p"))).distinct().collect()]
    return f.select("id", *[F.get_json_object("p", f"$['{n}']").alias(n) for n in sorted(names) if n != "id"], "geometry")


def from_records(spark: SparkSession, features) -> DataFrame:
    """Features given as GeoJSON-like dictionaries, one or many, or objects with ``__geo_interface__``."""
    one = lambda f: getattr(f, "__geo_interface__", f)
    features = one(features)
    if isinstance(features, dict):
        features = features["features"] if features.get("type") == "FeatureCollection" else [features]
    rows = [one(f) for f in features]
    names = sorted({k for f in rows for k in (f.get("properties") or {})} - {"id"})
    data = [(f.get("id"), *[(f.get("properties") or {}).get(n) for n in names], g if isinstance(g := f.get("geometry"), (str, type(None))) else json.dumps(g)) for f in rows]
    import pandas as pd

    frame = pd.DataFrame(data, columns=["id", *names, "geometry"]).astype({"geometry": object})
    keep = [c for c in frame.columns if c == "geometry" or frame[c].notna().any()]
    return spark.createDataFrame(frame[keep])


def from_source(spark: SparkSession, source, parts: int = 8) -> DataFrame:
    """Features of a user-defined source, read by the tasks.

    ``source`` can be sent to the executors and has ``schema`` (the properties'
    names and types, as Spark writes them) and ``read(part, parts)``, which
    gives the GeoJSON-like features of one of the parts. Geometry that isn't
    text is written as GeoJSON.
    """
    fields = StructType.fromDDL(source.schema)
    out = StructType([*fields, StructField("geometry", StringType())])
    arrow = to_arrow_schema(out)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in batch.column(0).to_pylist():
                rows: list[dict] = []
                for f in source.read(part, parts):
                    f = getattr(f, "__geo_interface__", f)
                    own, g = {"id": f.get("id"), **(f.get("properties") or {})}, f.get("geometry")
                    rows.append({n: own.get(n) for n in fields.names} | {"geometry": g if isinstance(g, (str, type(None))) else json.dumps(g)})
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spark.range(0, parts, 1, parts).mapInArrow(run, out)


def from_pandas(spark: SparkSession, frame, geometry: str = "geometry", index: str | None = None) -> DataFrame:
    """Features of a pandas table; geometry objects with ``wkb`` are taken as WKB, and ``index`` names a column for the table's index."""
    frame = frame.copy()
    if index:
        frame.insert(0, index, frame.index)
    frame[geometry] = [bytearray(g.wkb) if hasattr(g, "wkb") else g for g in frame[geometry]]
    return spark.createDataFrame(frame)
