"""Folders that are published by one small file each, which can be made once only: run facts, memberships, raw rows, projections.

Facts are written first, in a folder of the attempt's own; the file that names them comes last. So readers see all of an attempt or
nothing, and of two writers one fails. All files go through Spark's own file systems.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Store:
    """Small files under ``path``, made once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._fs_path(f"{self.path}/{name}"))

    def names(self, folder: str) -> list[str]:
        """Published files (an empty one never is)."""
        where = self._fs_path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where) if f.getLen() > 0) if self._fs.exists(where) else []

    def read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def claim(self, name: str, held: dict) -> None:
        """Makes the file ``name``; fails if there is one.

        The file is written under another name and closed, then renamed without overwriting, so it is seen whole or not at all, and a writer that dies leaves nothing in
        the way. HDFS and viewfs over it do that atomically; a local file system (tests) looks first and renames then; object stores need a committer of their own.
        An empty file of that name can't have been published, and is replaced."""
        jvm, target = self.spark.sparkContext._jvm, self._fs_path(f"{self.path}/{name}")
        draft = self._fs_path(f"{self.path}/.drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        empty = self._fs.exists(target) and self._fs.getFileStatus(target).getLen() == 0
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if empty else rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(target).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), how)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if self.exists(name):
                raise ValueError(f"{name} was published by another writer") from error
            raise


class RunFacts:
    """The tables of a run, all or none: ``runs/<run>.json`` names the attempt's folder and each table's rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)

    def commit(self, run_id: str, tables: dict[str, DataFrame]) -> dict:
        """Writes ``tables``, counts what was written, then publishes them. A run is published once."""
        name = f"runs/{run_id}.json"
        if self.store.exists(name):
            raise ValueError(f"run {run_id} was published before")
        folder, rows = f"facts/{run_id}-{uuid.uuid4().hex}", {}
        for table, df in tables.items():
            df.write.parquet(f"{self.store.path}/{folder}/{table}")
            rows[table] = df.sparkSession.read.schema(df.schema).parquet(f"{self.store.path}/{folder}/{table}").count()
        manifest = {"run_id": run_id, "folder": folder, "rows": rows, "schemas": {t: df.schema.jsonValue() for t, df in tables.items()}}
        self.store.claim(name, manifest)
        return manifest

    def read(self, run_id: str, table: str) -> DataFrame:
        from pyspark.sql.types import StructType

        manifest = self.store.read(f"runs/{run_id}.json")
        schema = StructType.fromJson(manifest["schemas"][table])
        return self.store.spark.read.schema(schema).parquet(f"{self.store.path}/{manifest['folder']}/{table}")


class Projection:
    """What is current in each scope: a replacement writes a folder, then the scope's next head names it. A later generation is never replaced by an earlier one."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)

    def head(self, scope: str) -> dict | None:
        names = self.store.names(f"heads/{scope}")
        return self.store.read(f"heads/{scope}/{names[-1]}") if names else None

    def replace(self, scope: str, rows: DataFrame, run_id: str, generation: int) -> dict:
        before = self.head(scope)
        if before is not None and generation < before["generation"]:
            raise ValueError(f"generation {generation} of scope {scope} is stale; it shows {before['generation']}")
        nth = 0 if before is None else before["nth"] + 1
        folder = f"data/{scope}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.store.path}/{folder}")
        head = {"nth": nth, "generation": generation, "run_id": run_id, "folder": folder, "schema": rows.schema.jsonValue()}
        self.store.claim(f"heads/{scope}/{nth:012d}", head)
        return head

    def read(self, scope: str) -> DataFrame:
        from pyspark.sql.types import StructType

        head = self.head(scope)
        if head is None:
            raise ValueError(f"scope {scope} shows nothing yet")
        return self.store.spark.read.schema(StructType.fromJson(head["schema"])).parquet(f"{self.store.path}/{head['folder']}")


def write_raw(rows: DataFrame, path: str, attempt: str) -> None:
    """The raw rows of one attempt, under a folder of its own; an attempt is never written over."""
    rows.write.mode("error").parquet(f"{path}/attempt={attempt}")
