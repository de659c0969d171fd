"""Session settings, and the shared folder that cut lineages are written to."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A task that writes few folders at a time, directions and years, keeps a file open in each and needs no sort.
    "spark.sql.maxConcurrentOutputFileWriters": "64",
    # Yearly extracts may hold nanosecond timestamps, which arrive as long under this setting.
    "spark.sql.legacy.parquet.nanosAsLong": "true",
}

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("remitra")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, whose
    executors are threads of this machine, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.conf.get("spark.app.id")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="remitra-")
    return _local_dirs[app]


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="remitra-")) / "remitra-package.zip"  # the driver serves it to executors
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


_folder: contextvars.ContextVar[str | None] = contextvars.ContextVar("remitra-staging", default=None)


@contextmanager
def staging(folder: str) -> Iterator[None]:
    """Tables staged within go to ``folder``, so that they can be removed together."""
    token = _folder.set(folder)
    try:
        yield
    finally:
        _folder.reset(token)


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    It cuts the lineage in a way that survives lost executors, keeps column
    pruning for every later reader, and gives the planner the real size, so
    a table is broadcast only if it is below ``autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{_folder.get() or shared_dir(spark) + '/staged'}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def splits_of(spark: SparkSession, most: str) -> Iterator[None]:
    """Tables read within are cut into splits of at most so many bytes, where rows are narrow and each becomes a group in a task's memory."""
    key = "spark.sql.files.maxPartitionBytes"
    given = spark.conf.get(key, None)
    in_bytes = lambda size: spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)
    if given is None or in_bytes(given) > in_bytes(most):
        spark.conf.set(key, most)
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, given)


def side_by_side(spark: SparkSession, actions: dict[str, Callable[[], object]], at_once: int = 8) -> dict:
    """Run independent Spark actions at the same time, so that small jobs fill the cluster together."""
    with ThreadPoolExecutor(max_workers=min(at_once, len(actions))) as pool:
        running = {
            name: pool.submit(contextvars.copy_context().run, inheritable_thread_target(spark)(action))
            for name, action in actions.items()
        }
        return {name: future.result() for name, future in running.items()}


def stage_all(spark: SparkSession, makers: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Stage independent tables."""
    return side_by_side(
        spark, {name: lambda n=name, m=make: stage(m(), n) for name, make in makers.items()}
    )
