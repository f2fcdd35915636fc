"""A folder of Parquet tables whose builds rewrite only what changed.

A table is dealt into buckets by a hash of its key.  A bucket lies in a folder of its own
for each version, and a manifest names the folders that make up a snapshot.  A build
writes new versions of the buckets it touches, then one more line of the manifest, so
readers see the old snapshot or the new one; a build that dies leaves folders that no
manifest names, and the next one takes other names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 2
_MANIFEST = "snapshot long, schema_version int, config string, model string, files map<string, array<string>>, schemas map<string, string>"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Tables:
    """Snapshots of named tables under ``path``."""

    #: The column that deals each table into buckets, and one that deals a bucket further.
    KEYS: dict[str, str] = {}
    WITHIN: dict[str, str] = {}
    #: Columns that a table must have, where it is named here.
    COLUMNS: dict[str, str] = {}

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def outdated(self, manifest: dict) -> str:
        """What keeps this code from using a snapshot; empty if nothing does."""
        if manifest["schema_version"] != SCHEMA_VERSION:
            return f"has schema version {manifest['schema_version']}, not {SCHEMA_VERSION}"
        kinds = {name: {f["name"] for f in json.loads(kind)["fields"]} for name, kind in (manifest["schemas"] or {}).items()}
        missing = sorted(f"{name}.{c}" for name, own in kinds.items() for c in self.COLUMNS.get(name, "").split() if c not in own)
        return f"lacks {', '.join(missing)}" if missing else ""

    def manifests(self, check: bool = True) -> list[dict]:
        """All snapshots there are, the latest first.  If that one is outdated it is an error,
        but for those who write the next."""
        at, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(at):
            return []
        rows = self.spark.read.json(f"{self.path}/manifest", schema=_MANIFEST).orderBy(F.desc("snapshot")).collect()  # one for each kept build
        if rows and check and (why := self.outdated(rows[0].asDict())):
            raise ValueError(f"the index at {self.path} {why}; rebuild it")
        return [r.asDict() for r in rows]

    def manifest(self, check: bool = True) -> dict | None:
        return next(iter(self.manifests(check)), None)

    def files(self, name: str) -> list[str]:
        """The folders of a table in the latest snapshot."""
        own = self.manifest()
        return own["files"].get(name, []) if own else []

    def read(self, name: str, folders: list[str], schema: str) -> DataFrame:
        """A table in the given folders, with the columns that are folder names."""
        kind = T.StructType.fromJson(json.loads(schema))
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/{f}" for f in folders])

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table of the latest snapshot, or some buckets of it."""
        own = self.manifest()
        if own is None:
            raise FileNotFoundError(f"no index at {self.path}")
        if name not in own["schemas"]:
            raise KeyError(f"the index has no table {name}")
        folders = [f for f in own["files"].get(name, []) if buckets is None or int(f.split("/")[0].removeprefix("bucket=")) in buckets]
        return self.read(name, folders, own["schemas"][name]).drop("bucket", "version")

    def write_buckets(self, name: str, rows: DataFrame) -> tuple[list[str], str]:
        """Write ``rows`` as new versions of their buckets: the folders, and the schema."""
        version = f"v{uuid.uuid4().hex[:12]}"
        within = [self.WITHIN[name]] if name in self.WITHIN else []
        dealt = rows.withColumns({"bucket": bucket_of(F.col(self.KEYS[name]), self.buckets), "version": F.lit(version)})
        columns = [*[c for c in rows.columns if c not in within], "bucket", "version", *within]
        dealt = dealt.select(*columns)
        # Rows of a bucket are dealt into as many files as their size asks for.
        dealt.repartition("bucket", *within).sortWithinPartitions("bucket", *within, *self.SORTED.get(name, ())).write.mode("append").partitionBy("bucket", "version", *within).parquet(f"{self.path}/{name}")
        at, fs = self._fs(f"{self.path}/{name}")
        made = [s.getPath() for s in fs.globStatus(self._fs(f"{self.path}/{name}/bucket=*/version={version}")[0]) or []]
        return sorted(f"{p.getParent().getName()}/{p.getName()}" for p in made), json.dumps(json.loads(dealt.schema.json()))

    SORTED: dict[str, tuple[str, ...]] = {}

    def commit(self, files: dict[str, list[str]], schemas: dict[str, str], config: str, model: str) -> None:
        """One more line of the manifest."""
        last = self.manifest(check=False)
        row = json.dumps({"snapshot": last["snapshot"] + 1 if last else 0, "schema_version": SCHEMA_VERSION, "config": config, "model": model, "files": files, "schemas": schemas})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/manifest")

    def write(self, tables: dict[str, DataFrame], config: str = "", model: str = "") -> None:
        """Write ``tables`` whole as the next snapshot, which has no others."""
        made = {name: self.write_buckets(name, df) for name, df in tables.items()}
        self.commit({n: f for n, (f, _) in made.items()}, {n: s for n, (_, s) in made.items()}, config, model)

    def replace(self, touched: dict[str, set[int]], rows: dict[str, DataFrame], config: str, model: str) -> None:
        """The next snapshot: each table in ``rows`` has them in its ``touched`` buckets, in
        place of what was there; all else is as before."""
        last = self.manifest()
        files, schemas = dict(last["files"]), dict(last["schemas"])
        for name, df in rows.items():
            made, schemas[name] = self.write_buckets(name, df)
            files[name] = sorted(made + [f for f in files.get(name, []) if int(f.split("/")[0].removeprefix("bucket=")) not in touched[name]])
        self.commit(files, schemas, config, model)

    def expire(self, keep: int = 2) -> int:
        """Delete the folders that none of the last ``keep`` snapshots names, and return how
        many; not while a build or a reader of an older snapshot runs."""
        found, gone = self.manifests(), 0
        for name in {n for m in found for n in m["files"]}:
            used = {f for m in found[:keep] for f in m["files"].get(name, [])}
            at, fs = self._fs(f"{self.path}/{name}/bucket=*/version=*")
            for status in fs.globStatus(at) or []:
                p = status.getPath()
                if f"{p.getParent().getName()}/{p.getName()}" not in used:
                    fs.delete(p, True)
                    gone += 1
        return gone
