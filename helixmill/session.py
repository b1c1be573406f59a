"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors of a session, once; Spark serves the file to them."""
    sc = spark.sparkContext
    if getattr(sc, "_helixmill_shipped", None) is None:
        home = Path(__file__).resolve().parent
        made = Path(tempfile.mkdtemp(prefix="helixmill-code-")) / "helixmill_code.zip"
        with zipfile.ZipFile(made, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        sc.addPyFile(str(made))
        sc._helixmill_shipped = str(made)
    return spark


def get_session(cpus: str = "8", app: str = "helixmill") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller's session is used as it is, after ``ship``."""
    return ship(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # small tables still use all threads
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one, removed at the end, only where a local session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder: set spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="helixmill-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


@contextmanager
def working_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own in the shared one, removed on the way out, also after an error."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/helixmill-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there: survives executor loss, ends the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what was cut before: else they stay until the driver happens to collect its garbage."""
    for _ in range(2):
        gc.collect()
        time.sleep(1.2)  # the JVM learns a second or more later that Python has let go
        spark.sparkContext._jvm.System.gc()


def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one compressed value, for tables that are written and read by maps: a written row isn't compressed."""
    for batch in batches:
        if batch.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["packed"])


def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that went into ``pack``."""
    for batch in batches:
        for x in batch.column("packed"):
            yield from pa.ipc.open_stream(x.as_buffer())


PACKED = "packed binary"


#: rows of a few numbers that may go to all tasks
SMALL = 1 << 20


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``SMALL`` rows; a larger one is joined by shuffle.

    A table read back from the shared folder has no statistics, so without the count it would always be shuffled, and
    the larger side with it. Meant for rows of a few numbers, not for texts.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= SMALL else df


def spread(df: DataFrame) -> DataFrame:
    """A file scan as at least as many tasks as there are cores, for work that costs far more than moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
