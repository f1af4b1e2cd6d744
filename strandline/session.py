"""Session settings and access to the tables of a directory."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the session's Python workers, once: they needn't have it installed or on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strandline-")) / "strandline.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def build_session(master: str = "local[8]", app: str = "strandline", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the library is tuned for: UTC, adaptive plans, Arrow."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table of the directory; only the named columns reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local master may do without one and gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
        if not shared and not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "strandline-checkpoints"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder: a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession, factor: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)


def latest_rows(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Of the rows with one key, the one with the latest ``at``.

    Rows with a null ``at`` lose against any other; repeated rows collapse into one.  Rows that tie on ``at``
    with different content (the data has none) are decided by the largest remaining values, so the result
    doesn't depend on the order of the input.  Null keys form a key of their own.  max() of a struct is
    combined before the shuffle, so a hot key sends one row per map task.
    """
    rest = [c for c in df.columns if c not in keys and c != at]
    orderable, other = [], []
    for c in rest:
        (other if _has_map(df.schema[c].dataType) else orderable).append(c)
    value = F.max(F.struct(F.col(f"`{at}`"), *[F.col(f"`{c}`") for c in orderable])) if not other else F.max_by(F.struct(*[F.col(f"`{c}`") for c in [at, *rest]]), F.struct(F.col(f"`{at}`"), *[F.col(f"`{c}`") for c in orderable]))
    picked = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(value.alias("__latest"))
    return picked.select(*[(F.col(f"`{c}`") if c in keys else F.col("__latest").getField(c).alias(c)) for c in df.columns])


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def col(name: str) -> Column:
    return F.col(f"`{name}`")
