"""Session set-up, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "loomspark") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of the data set, read with only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Only where the setting is empty (tests, one machine) a local temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/loomspark-{spark.sparkContext.applicationId}"


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all tables this application has materialised; frames read from them end here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _release_at_exit(spark: SparkSession) -> None:
    try:
        if spark._jsc is not None and not spark._jsc.sc().isStopped():
            release(spark)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


_watched: set[str] = set()


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here and survives lost executors.

    The tables lie in a folder of the application, which is deleted when the driver ends, or by ``release``.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _watched:
        _watched.add(app)
        atexit.register(_release_at_exit, spark)
    at = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files a frame reads; of a materialised table its size on disk."""
    spark = df.sparkSession
    total = 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


#: Bytes of a materialised table that are sent to all tasks.
SENT_BYTES = 8_000_000


def sent(df: DataFrame) -> DataFrame:
    """A materialised table marked for broadcast where its files are small enough; larger ones are shuffled."""
    return F.broadcast(df) if table_bytes(df) <= SENT_BYTES else df
