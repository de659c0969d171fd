"""Published tables in versions: a reader sees all tables of one publication or of the one before, never a mixture.

Tables are written under a folder of their own. Only then is a manifest written,
one file, that names the folder of every table or part of a table; the manifest
with the highest number counts. What no kept manifest names is dropped after
that. A run that fails half way leaves the last manifest, and so all readers, as
they were, and takes its own folder with it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from remitra.session import side_by_side

_MANIFEST = "version long, table string, part string, path string, schema string, note string"
#: Publications that stay readable, for those who opened the one before.
KEPT = 2


@dataclass(frozen=True)
class Part:
    """A table, or one part of it, as a manifest names it; ``note`` is the writer's own."""

    table: str
    part: str
    path: str
    schema: str
    note: str = ""


class Pack:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifests(self) -> list:
        try:
            rows = self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest/*/part-*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return rows.collect()  # a row per table and part of each kept publication

    def current(self) -> list[Part]:
        """Everything in the last publication; nothing before the first."""
        rows = self._manifests()
        last = max((r.version for r in rows), default=None)
        return [Part(r.table, r.part, r.path, r.schema, r.note) for r in rows if r.version == last]

    def new_folder(self) -> str:
        return f"versions/{uuid.uuid4().hex}"

    def read(self, table: str, parts: Iterable[Part] | None = None) -> DataFrame:
        """A published table, or some of its parts."""
        found = [p for p in (self.current() if parts is None else parts) if p.table == table]
        if not found:
            raise ValueError(f"{self.root} holds no {table}")
        schema = T.StructType.fromJson(json.loads(found[0].schema))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p.path}" for p in found])

    def commit(self, parts: Sequence[Part]) -> int:
        """Make ``parts`` the current publication, and drop what is no longer named."""
        rows = self._manifests()
        version = max((r.version for r in rows), default=0) + 1
        entries = [(version, p.table, p.part, p.path, p.schema, p.note) for p in parts]
        manifest = self.spark.createDataFrame(entries, _MANIFEST).coalesce(1)
        manifest.write.mode("errorifexists").json(f"{self.root}/manifest/{version:08d}")
        alive = {p.path for p in parts} | {r.path for r in rows if r.version > version - KEPT}
        self.drop({r.path for r in rows} - alive)
        self.drop({f"manifest/{r.version:08d}" for r in rows if r.version <= version - KEPT})
        return version

    def drop(self, paths: Iterable[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in sorted(paths):
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
            folder.getFileSystem(conf).delete(folder, True)

    def publish(self, tables: Mapping[str, DataFrame], orders: Mapping[str, Sequence[Column]] | None = None) -> int:
        """Write all tables, several at a time, and make them the current publication.

        A table with an order is written in ranges of it, each file sorted, so
        that readers skip files and row groups by their bounds.
        """
        folder, orders = self.new_folder(), orders or {}

        def write(name: str, df: DataFrame) -> Part:
            rows = df.orderBy(*orders[name]) if name in orders else df
            rows.write.parquet(f"{self.root}/{folder}/{name}")
            return Part(name, "", f"{folder}/{name}", df.schema.json())

        try:
            written = side_by_side(self.spark, {name: partial(write, name, df) for name, df in tables.items()})
        except BaseException:
            self.drop([folder])
            raise
        return self.commit(list(written.values()))
