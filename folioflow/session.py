"""Session helpers: local sessions for tests and benches, worker import path, shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: str = "8", name: str = "folioflow", **conf: str) -> SparkSession:
    """A local session as tests and bench.py use it."""
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
    base = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.host": "127.0.0.1",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from the driver's path (workers elsewhere need it installed or in --py-files)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))]))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors see; only where that is unset (tests) a temporary one is made."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="folioflow-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
    return f"{top.rstrip('/')}/folioflow-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_runs(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """df with each key's rows in one task, one after the other by order, for a fold over batches that keeps state from row to row.

    Keys are dealt by their hash as an expression: a plain repartition(*keys) is left out where a join has dealt its rows by them already, and if that join
    becomes a broadcast at run time, its rows are read where they were written, and a key's are in many tasks.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like name that none of the frames has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain_names(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... so that no name can clash with an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def fields(df: DataFrame) -> str:
    """df's columns as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def quoted(name: str) -> str:
    """A column's name for col() and select(): dots and backticks in it are part of the name."""
    return "`" + name.replace("`", "``") + "`"
