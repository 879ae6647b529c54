"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    On a cluster leave ``master`` unset so that spark-submit decides, and set
    ``spark.checkpoint.dir`` to a folder all executors share.
    """
    builder = SparkSession.builder.appName("granary")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, so Python stages find it from any folder. Once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_granary_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="granary-package-")) / "granary.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._granary_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder: on a cluster a machine-local folder would
    be lost with its machine, so there the setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="granary-")
    sc.setCheckpointDir(folder)
    return folder


#: Shuffled bytes a task should get, and bytes of input files for each shuffle partition.
TASK_BYTES, INPUT_BYTES = 8 << 20, 4 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that the frame reads; 0 where it reads none."""
    sc = df.sparkSession.sparkContext
    total, conf = 0, sc._jsc.hadoopConfiguration()
    files = set(df.inputFiles())
    for folder in {f.rsplit("/", 1)[0] for f in files}:
        path = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(folder))
        total += sum(s.getLen() for s in path.getFileSystem(conf).listStatus(path) if s.getPath().toUri().toString() in files)
    return total


@contextmanager
def small_tasks(df: DataFrame, reads: Sequence[DataFrame] = ()) -> Iterator[None]:
    """While the frame runs, its shuffles are dealt into tasks of a like size, however large its input is.

    Rows of a few columns pack into few bytes but take many times that in hash tables and sorts, so tasks of the usual size
    of shuffled bytes would need most of an executor; and a fixed number of partitions would grow with the input.
    A session that asks for smaller tasks or more partitions keeps its settings. ``reads``: frames behind scalar
    subqueries, whose files Spark does not list with those of ``df``.
    """
    conf = df.sparkSession.conf
    size, count = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"
    before = {key: conf.get(key) for key in (size, count)}
    own = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[size])
    try:
        conf.set(size, str(min(own, TASK_BYTES)))
        conf.set(count, str(max(int(before[count]), -(-sum(map(input_bytes, (df, *reads))) // INPUT_BYTES))))
        yield
    finally:
        for key, value in before.items():
            conf.set(key, value)


def unsent(df: DataFrame) -> DataFrame:
    """Never broadcast this side of a join: its rows grow with the data, and the driver would hold the tables of all steps."""
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps restart from files, not from the whole history."""
    shared_dir(df.sparkSession)
    with small_tasks(df):
        return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table", reads: Sequence[DataFrame] = ()) -> DataFrame:
    """Write the table to the shared folder as Parquet and read it back.

    Cuts lineage like a checkpoint, but later plans prune columns, push filters down and have statistics.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with small_tasks(df, reads):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(df: DataFrame) -> DataFrame:
    """What is read from stored tables as one partition, if their files hold no more than the input of one.

    What is joined or grouped of such frames alone needs no shuffle. Larger ones stay as they are.
    """
    return df.coalesce(1) if input_bytes(df) <= INPUT_BYTES else df
