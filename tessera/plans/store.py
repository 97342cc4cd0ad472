"""Versioned snapshots of the three stored tables.

A version is a folder of Parquet written once; publishing moves a pointer, which is one small file
per version, so readers of an older version are not disturbed and a writer that dies leaves the
store as it was. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed as V
from ..operators import model

_TABLES = {"memories": model.MEMORIES, "tags": model.TAGS, "ledger": model.LEDGER}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The published version; 0 before the first."""
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/published")
        if not fs.exists(folder):
            return 0
        return max([int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()], default=0)

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        version = self.version() if version is None else version
        if version == 0:
            return {name: self.spark.createDataFrame([], schema) for name, schema in _TABLES.items()}
        return {name: self.spark.read.schema(schema).parquet(f"{self.path}/v={version}/{name}") for name, schema in _TABLES.items()}

    def batches(self) -> dict[str, int]:
        """The last batch of each stream that the published version holds."""
        version = self.version()
        if version == 0:
            return {}
        jvm, fs = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/published/{version}"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") or "{}")
        finally:
            stream.close()

    def publish(self, batch: tuple[str, int] | None = None, **tables: DataFrame) -> int:
        """Writes the given tables, and the others as they are, as the next version; then publishes it.

        ``batch``, a stream and its batch, is published with the version, so a batch that is delivered
        again after a failure is known.
        """
        now, nxt = self.read(), self.version() + 1
        for name, schema in _TABLES.items():
            df = tables.get(name, now[name])
            columns = [c.strip().split(" ")[0] for c in schema.replace("array<string>", "array").split(",")]
            writer = df.select(*columns).write.mode("overwrite")
            if name == "memories":
                # nearly every read names its layers: a folder for each of the four, and Bloom filters for keys inside
                writer = writer.partitionBy("scope").option("parquet.bloom.filter.enabled#project_key", "true")
            writer.parquet(f"{self.path}/v={nxt}/{name}")
        jvm, fs = self._fs()
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{self.path}/published"))
        known = json.dumps({**self.batches(), **dict([batch] if batch else [])})
        hidden, shown = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/published/{name}") for name in (f"_{nxt}", nxt))
        out = fs.create(hidden, True)
        out.write(bytearray(known.encode()))
        out.close()
        if not fs.rename(hidden, shown):
            raise RuntimeError(f"version {nxt} is already published")
        return nxt

    def migrate(self) -> int:
        """Makes the first, empty version if there is none; the schema has one version so far."""
        return self.version() or self.publish()

    @property
    def schema_version(self) -> int:
        return model.SCHEMA_VERSION

    def has_active(self) -> bool:
        """Whether a reminder has anything to point to."""
        return not self.read()["memories"].where("status = 'active'").limit(1).isEmpty()


def validate_panel(value: dict) -> dict:
    """Clamps and checks of panel input: limit, offset, importance, log entries, tags, title."""
    out = dict(value)
    out["limit"] = min(max(int(value.get("limit", 30)), 1), 200)
    out["offset"] = min(max(int(value.get("offset", 0)), 0), 1_000_000)
    if value.get("importance") is not None:
        out["importance"] = min(max(int(value["importance"]), 0), 5)
    if value.get("entries") is not None:
        out["entries"] = min(max(int(value["entries"]), 1), 200)
    if value.get("tags") is not None:
        out["tags"] = [str(t)[:40] for t in value["tags"]][:32]
    if value.get("title") is not None:
        out["title"] = str(value["title"])[:200]
    if value.get("scope") is not None and value["scope"] not in V.SCOPES:
        raise ValueError(f"unknown scope {value['scope']!r}")
    return out
