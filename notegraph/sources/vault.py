"""Notes from a folder of markdown files, and evaluation cases."""

from __future__ import annotations

import datetime
import functools
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import EngineConfig
from ..functions.markdown import normalised_text


def is_conflict_name(name: Column, config: EngineConfig = EngineConfig()) -> Column:
    """File names that sync programs give to conflicting copies."""
    return functools.reduce(lambda a, b: a | b, [name.rlike(p) for p in config.conflict_patterns])


def skip_reason(path: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Why a file is no note, or null: folder, hidden, suffix or conflict.  ``path`` is
    relative, with forward slashes."""
    parts = F.split(path, "/")
    folders, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    hidden = F.exists(folders, lambda f: f.startswith(".")) if config.skip_hidden else F.lit(False)
    suffixed = functools.reduce(lambda a, b: a | b, [F.lower(name).endswith(s) for s in config.suffixes])
    return (
        F.when(F.exists(folders, lambda f: f.isin(*config.skip_dirs)), "folder").when(hidden, "hidden").when(name.startswith("."), "hidden")
        .when(~suffixed, "suffix").when(is_conflict_name(name, config), "conflict")
    )


def scan(spark: SparkSession, root: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(path, size, mtime, content_hash, text, skip_reason) of every file under ``root``, but
    for folders that are never entered.

    The hash is that of the raw bytes.  A folder that all executors can open is read by
    ``VaultSource``; other stores by Spark's reader, which leaves out names that start with
    an underscore or a dot.
    """
    scheme, _, local = root.rpartition("://")
    if scheme in ("", "file"):
        spark.dataSource.register(VaultSource)
        reader = spark.read.format("vault").option("skipdirs", "/".join(config.skip_dirs)).option("skiphidden", str(config.skip_hidden)).option("suffixes", "/".join(config.suffixes))
        rows = reader.load(local)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), "^" + "/".join(_quote(p) for p in ("/" + local).rstrip("/").split("/")) + "/", "")
        rows = files.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.lit(False).alias("placeholder"), "content")
    rows = rows.withColumn("skip_reason", F.coalesce(skip_reason(F.col("path"), config), F.when(F.col("placeholder"), "placeholder")))
    note = F.col("skip_reason").isNull()
    return rows.select("path", "size", "mtime", F.when(note, F.sha2("content", 256)).alias("content_hash"), F.when(note, normalised_text(F.col("content"))).alias("text"), "skip_reason")


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_-" else "\\" + c for c in text)


def notes(spark: SparkSession, root: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    return scan(spark, root, config).where("skip_reason IS NULL").drop("skip_reason")


def assert_outside(target: str, root: str) -> None:
    """An index must not lie in the folder it indexes."""
    a, b = os.path.realpath(target), os.path.realpath(root)
    if a == b or a.startswith(b + os.sep):
        raise ValueError(f"{target} lies in {root}")


# File attributes, where the system has them, of files whose content is elsewhere.
OFFLINE, RECALL_ON_OPEN, RECALL_ON_DATA_ACCESS = 0x1000, 0x40000, 0x400000


def is_placeholder(status: os.stat_result) -> bool:
    """Whether reading the file would fetch it from a sync service first."""
    return bool(getattr(status, "st_file_attributes", 0) & (OFFLINE | RECALL_ON_OPEN | RECALL_ON_DATA_ACCESS))


class _Folder(InputPartition):
    """A folder to walk, or with ``deep`` false the files that lie in it alone."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _VaultReader(DataSourceReader):
    def __init__(self, root: str, skip_dirs: set[str], skip_hidden: bool, suffixes: tuple[str, ...]):
        self.root, self.skip_dirs, self.skip_hidden, self.suffixes = root, skip_dirs, skip_hidden, suffixes

    def _entered(self, name: str) -> bool:
        return name not in self.skip_dirs and not (self.skip_hidden and name.startswith("."))

    def partitions(self) -> list[_Folder]:
        with os.scandir(self.root) as entries:
            folders = sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and self._entered(e.name))
        return [_Folder(self.root, False), *(_Folder(f, True) for f in folders)]

    def read(self, partition: _Folder):
        for folder, folders, names in os.walk(partition.path):
            folders[:] = sorted(d for d in folders if partition.deep and self._entered(d))
            for name in sorted(names):
                path = os.path.join(folder, name)
                if not os.path.isfile(path):
                    continue
                status = os.stat(path)
                away, content = is_placeholder(status), None
                if name.lower().endswith(self.suffixes) and not name.startswith(".") and not away:
                    with open(path, "rb") as handle:
                        content = handle.read()
                mtime = datetime.datetime.fromtimestamp(status.st_mtime, datetime.timezone.utc)
                yield os.path.relpath(path, self.root).replace(os.sep, "/"), status.st_size, mtime, away, content


class VaultSource(DataSource):
    """``spark.read.format("vault")``: files of a shared folder, pruned while walking.

    The driver lists the first level alone; a task walks each folder of it.  Only files
    with a note's suffix are opened.
    """

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "path string, size long, mtime timestamp, placeholder boolean, content binary"

    def reader(self, schema) -> _VaultReader:
        config = EngineConfig()
        listed = lambda name, default: tuple(self.options[name].split("/")) if name in self.options else default
        return _VaultReader(self.options["path"], set(listed("skipdirs", config.skip_dirs)), self.options.get("skiphidden", str(config.skip_hidden)) == "True", listed("suffixes", config.suffixes))


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """(q, expect) from JSON lines; blank lines and those with # are skipped, expect defaults
    to none.  A bad line is an error that names its file and line."""
    # Lines are numbered within their file: a file of cases is one split, as it is read whole.
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))
    lines = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    case = F.from_json("value", "q string, expect array<string>, why string", {"mode": "PERMISSIVE"})
    rows = lines.select("file", "n", "value", case.alias("c"))
    bad = F.col("c").isNull() | F.col("c.q").isNull()
    where = F.concat(F.lit("line "), F.col("n") + 1, F.lit(" of "), "file", F.lit(" is no case with a q: "), "value")
    return rows.select(F.when(bad, F.raise_error(where)).otherwise(F.col("c.q")).alias("q"), F.coalesce("c.expect", F.array().cast("array<string>")).alias("expect"))
