"""The folder that driver and executors share, and tables cut into it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; where the session has none and runs on
    one machine (tests), a temporary folder is made and set as checkpoint
    folder. On a cluster a missing setting is an error: a folder of one machine
    would lose what the others write.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_base(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs no earlier step. One job, where
    ``checkpoint()`` would run the plan twice.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path  # type: ignore[attr-defined]
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_cut(df: DataFrame) -> None:
    """Delete what :func:`cut` wrote for ``df``."""
    path = df.__dict__.get("_gridloom_path")  # not getattr, which would find a column of that name
    if path:
        drop_path(df.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, for helper columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        c = f"_{name}"
        while c.lower() in taken:
            c = "_" + c
        taken.add(c.lower())
        out.append(c)
    return out


#: Logical operators after which a row's place is the same whenever the plan runs.
_FIXED = ("Project", "Filter", "LocalRelation", "LogicalRelation", "Range", "Union", "Generate", "SubqueryAlias")


def numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    """``df`` with a number for each row that is the same in every branch that reads it.

    Numbers by place are stable only while rows keep their places. A plan
    without shuffles and random parts over files or local rows keeps them; any
    other (cached rows and RDDs too, which may be made anew when an executor is
    lost) is cut first, so that all branches read the same files.
    """
    from pyspark.sql import functions as F

    plan = df._jdf.queryExecution().optimizedPlan()  # type: ignore[attr-defined]
    nodes, fixed = [plan], True
    while nodes and fixed:
        node = nodes.pop()
        fixed = node.getClass().getSimpleName() in _FIXED and all(x.deterministic() for x in _items(node.expressions()))
        nodes += _items(node.children())
    if not fixed:
        df = cut(df, label)
    return df.withColumn(name, F.monotonically_increasing_id())


def _items(seq) -> list:
    """A Scala sequence as a list."""
    return [seq.apply(i) for i in range(seq.size())]
