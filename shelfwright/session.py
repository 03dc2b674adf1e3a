"""Session defaults, table loading and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings training_candidate "
    "assignments match_edges target_predictions review_events raw_rows brand_reference split_plan source_mix size_limits"
).split()

#: Rows of a table that the planner may broadcast.
BROADCAST_ROWS = 250_000

_shipped: set[str] = set()
_made: dict[str, list[str]] = {}


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "shelfwright") -> SparkSession:
    """A session for tests and single-machine runs; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable on the workers, wherever they run; once a session."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="shelfwright-code-"), "shelfwright.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's parquet tables, a file or a folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (only where that is unset, on one machine) a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="shelfwright-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives the loss of executors.

    The files stay until release(), spark.stop() or the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_sweep)
    _sweep_on_stop(spark)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shelfwright_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables made by materialize() that nothing will read any more."""
    for df in frames:
        path = getattr(df, "_shelfwright_path", None)
        if path:
            _remove(df.sparkSession, path)
            for made in _made.values():
                if path in made:
                    made.remove(path)


def bounded(df: DataFrame, table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df as a side of a join, which is not to be broadcast where the table (by materialize()) that it is made of has more rows.

    The planner goes by the size of compressed files and keeps a broadcast that turns out larger, as adaptive execution adds no exchange.
    """
    n = getattr(table, "_shelfwright_rows", None)
    if n is None:
        n = table._shelfwright_rows = table.count()
    return df if n <= rows else df.hint("merge")


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    made = _made.get(spark.sparkContext.applicationId, [])
    while made:
        try:
            _remove(spark, made.pop())
        except Exception:  # the gateway may be gone already
            return


def _sweep_on_stop(spark: SparkSession) -> None:
    """Delete this session's tables before it stops, as nothing can be deleted through it afterwards."""
    if getattr(spark, "_shelfwright_stop", None) is None:
        spark._shelfwright_stop = spark.stop

        def stop() -> None:
            _sweep()
            spark._shelfwright_stop()

        spark.stop = stop
