"""User functions as statistics: grouped-map over a feature's cells."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class CustomStat:
    """A function ``(values, coverage)`` or ``(values, coverage, weights)`` and its Spark return type.

    Without a type, that of the function's annotation counts (``int``,
    ``float``, ``str``, ``bool``, arrays and lists as arrays of doubles), and
    without one of those, double.

    Values and weights come as masked arrays (missing ones masked), coverage
    as a plain array, cells row by row. The function isn't called for a
    feature without cells; its result is null then.
    """

    def __init__(self, function: Callable, return_type: str | None = None, name: str | None = None):
        signature = inspect.signature(function)
        n = len(signature.parameters)
        if n not in (2, 3):
            raise ValueError("Function must take 2 or 3 arguments")
        said = signature.return_annotation
        said = {"int": int, "float": float, "str": str, "bool": bool, "list": list, "np.ndarray": np.ndarray}.get(said, said)
        known = {int: "bigint", float: "double", str: "string", bool: "boolean", list: "array<double>", np.ndarray: "array<double>"}
        self.function, self.return_type, self.weighted = function, return_type or (known.get(said) if isinstance(said, type) else None) or "double", n == 3
        self.name = name or getattr(function, "__name__", "custom")


def custom_results(cells: DataFrame, stat: CustomStat) -> DataFrame:
    """``fid, result`` of a user function.

    A feature's cells come to one task, as the function needs them together;
    built-in statistics have no such bound.
    """
    function, weighted = stat.function, stat.weighted

    kind = cells.schema["fid"].dataType
    # a key of feature and band is grouped by its parts
    keys = kind.names if isinstance(kind, StructType) else ["fid"]
    if keys != ["fid"]:
        cells = cells.select("fid.*", *[c for c in cells.columns if c != "fid"])
    types = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        masked = lambda s, kind=None: np.ma.masked_array(s.fillna(0).to_numpy(dtype=kind) if kind else s.fillna(0).to_numpy(), s.isna().to_numpy())
        values = masked(pdf["x"])
        if not pdf["x"].isna().any() and values.dtype == object:
            values = np.ma.masked_array(np.array(pdf["x"].tolist()))
        args = [values, pdf["c"].to_numpy()]
        if weighted:
            w = np.ma.masked_array(pdf["w"].to_numpy(dtype=float), pdf["w"].isna().to_numpy())
            args.append(w)
        got = function(*args)
        if isinstance(got, (np.ma.core.MaskedConstant,)):
            got = None
        elif isinstance(got, np.ndarray):
            got = got.tolist()
        elif isinstance(got, np.generic):
            got = got.item()
        elif got is not None and not isinstance(got, (int, float, str, bool, list, tuple)):
            raise TypeError("Unhandled type returned from Python operation")
        return pd.DataFrame({**{k: [x] for k, x in zip(keys, key, strict=True)}, "result": [got]})

    out = cells.groupBy(*keys).applyInPandas(run, f"{types}, result {stat.return_type}")
    return out if keys == ["fid"] else out.select(F.struct(*keys).alias("fid"), "result")
