"""What the text operators share: reading tables, Arrow helpers, checked broadcasts, summed statistics."""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import remitra
from remitra.session import stage

#: Rows up to which a written table may be broadcast; beyond it a shuffle join takes over.
BROADCAST_ROWS = 500_000
#: Rows in an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 2_000
#: Partial sums meet in this many groups before the driver adds them up.
SUM_SLOTS = 16

WORD = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(remitra.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="remitra-")) / "remitra.zip"  # the driver serves it to executors
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; Arrow batches are kept small for what follows."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a staged table of narrow rows if it has at most ``rows`` of them."""
    return F.broadcast(df) if df.count() <= rows else df


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack_arrays(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        return {key: found[key] for key in found.files}


def summed(df: DataFrame, statistics: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Add up fixed-size arrays that ``statistics`` makes of each partition.

    Partitions are added in ``SUM_SLOTS`` groups on the executors, and the
    driver adds those. What arrives is ``SUM_SLOTS`` times the size of the
    model, whatever the number of rows.
    """
    from pyspark import TaskContext

    def partial(batches):
        found = statistics(batches)
        slot = TaskContext.get().partitionId() % SUM_SLOTS
        yield pa.RecordBatch.from_pydict(
            {"slot": pa.array([slot], pa.int32()), "sums": pa.array([pack_arrays(found)], pa.binary())}
        )

    def add(batches):
        total: dict[int, dict[str, np.ndarray]] = {}
        for batch in batches:
            for slot, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                arrays = unpack_arrays(data)
                if slot in total:
                    for key, value in arrays.items():
                        total[slot][key] = total[slot][key] + value
                else:
                    total[slot] = arrays
        for slot, arrays in total.items():
            yield pa.RecordBatch.from_pydict(
                {"slot": pa.array([slot], pa.int32()), "sums": pa.array([pack_arrays(arrays)], pa.binary())}
            )

    schema = "slot int, sums binary"
    rows = df.mapInArrow(partial, schema).repartition(SUM_SLOTS, "slot").mapInArrow(add, schema).collect()
    out: dict[str, np.ndarray] = {}
    for row in sorted(rows, key=lambda r: r.slot):
        for key, value in unpack_arrays(bytes(row.sums)).items():
            out[key] = out[key] + value if key in out else value
    return out


def staged(df: DataFrame, name: str) -> DataFrame:
    # Mostly hashes and ids, which a stronger codec hardly shrinks.
    return stage(df, f"llm-{name}", "snappy")


def unstaged(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read again; what was made of them has been written."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def as_strings(texts: pa.Array) -> list:
    """``texts.to_pylist()`` without a scalar for each."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def words_of(texts: pa.Array, lower: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of whole texts: distinct ones, each word's number among them, and where each text's words end.

    Words are runs of anything but the six ASCII white-space characters; only A-Z are lower-cased.
    """
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = cut.flatten()
    coded = flat.dictionary_encode()
    numbers, distinct = coded.indices.to_numpy(), as_strings(coded.dictionary)
    offsets = cut.offsets.to_numpy()
    ends = offsets[1:].astype(np.int64) - offsets[0]
    if "" in distinct:  # white space at an end of a text
        real = numbers != distinct.index("")
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        numbers = numbers[real]
    return distinct, numbers, ends
