"""A cache of tokenised rows that knows what it was made from.

The name of a cached table is a digest of the recipe, its settings, the columns and every input file with size and time of change.
Rows are written to a folder of their own and count from the moment a manifest of that name is moved into place; what a
failed or concurrent writer left behind has no manifest and is never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def input_digest(source: DataFrame) -> str:
    """A digest of the files that hold the rows of ``source``, whatever their order.

    ``source`` is a table as it was read. Only what the file system says of the files is read; the driver gets one row.
    """
    facts = [F.col(f"_metadata.{c}").cast("string") for c in ("file_path", "file_size", "file_modification_time")]
    files = source.select(*[c.alias(f"f{k}") for k, c in enumerate(facts)]).distinct()
    digest = F.md5(F.concat_ws("|", "f0", "f1", "f2"))
    halves = [F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)") for start in (1, 16)]
    row = files.agg(F.count("*"), *[F.sum(h) for h in halves]).first()
    return hashlib.sha256(json.dumps([str(v) for v in row]).encode()).hexdigest()


def cache_name(source: DataFrame, recipe: str, settings: dict | None = None) -> str:
    parts = [recipe, json.dumps(settings or {}, sort_keys=True, default=str), source.schema.json(), input_digest(source)]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


class TokenCache:
    """Cached tables in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def lookup(self, name: str) -> DataFrame | None:
        """The table of that name, if it was committed."""
        path, system = self._path(f"manifests/{name}")
        if not system.exists(path):
            return None
        with_manifest = self.spark.read.text(f"{self.folder}/manifests/{name}", wholetext=True)
        manifest = json.loads(with_manifest.first()["value"])
        return self.spark.read.schema(manifest["schema"]).parquet(f"{self.folder}/{manifest['data']}")

    def commit(self, name: str, df: DataFrame) -> DataFrame:
        """Write the table, then its manifest under another name, and move that into place; the first writer to do so wins."""
        data = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{data}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        draft, system = self._path(f"drafts/{uuid.uuid4().hex}")
        out = system.create(draft)
        out.write(bytearray(json.dumps({"data": data, "schema": schema}).encode()))
        out.close()
        final, _ = self._path(f"manifests/{name}")
        system.mkdirs(final.getParent())
        if not system.exists(final):
            system.rename(draft, final)
        return self.lookup(name)

    def cached(
        self, source: DataFrame, recipe: str, build: Callable[[DataFrame], DataFrame], settings: dict | None = None
    ) -> DataFrame:
        """``build(source)``, from the cache if recipe, settings, columns and files are those of a table there."""
        name = cache_name(source, recipe, settings)
        found = self.lookup(name)
        return self.commit(name, build(source)) if found is None else found
