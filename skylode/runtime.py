"""Session settings and shared intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple] = []
_own: dict[str, str] = {}


def session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skylode")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark's reader alone touches the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of its own; a cluster, whose executors would each write to another disk, an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    return _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='skylode-')}")


def place(spark: SparkSession, name: str = "") -> str:
    """A new path in the shared folder, which :func:`clear` deletes."""
    path = f"{shared_dir(spark)}/skylode/{uuid.uuid4().hex}{name and '-'}{name}"
    if not _written:
        atexit.register(clear)
    # The settings are held too, as a stopped session no longer gives them.
    _written.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))
    return path


def cut(df: DataFrame, name: str = "", **options) -> DataFrame:
    """Writes a table to the shared folder, with ``options`` for the writer, and reads it again.

    The lineage ends there: a lost executor costs no recomputation of what
    came before, and an iterative plan stays as small as its last round. The tables stay until the process ends or :func:`clear` is called.
    """
    spark = df.sparkSession
    path = place(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Deletes every table that :func:`cut` has written; results that still read them can't be read any more. It works after the session has been stopped, too."""
    while _written:
        jvm, conf, path = _written.pop()
        target = jvm.org.apache.hadoop.fs.Path(path)
        try:
            target.getFileSystem(conf).delete(target, True)
        except Exception as e:  # at the end of the process nothing can be done about a store that refuses
            print(f"{path} isn't deleted: {e}", file=sys.stderr)
    for path in _own.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
    _own.clear()
