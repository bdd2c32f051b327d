"""Versioned graph snapshots on a shared file system.

A version is a manifest that names, for each table, the folders of parquet files
it is made of: a base and the changes since. No folder is ever changed. A version
counts once its manifest ``v<n>/_COMPLETE`` is written; that file is created
exclusively, so of two writers on the same version one fails, a writer that dies
half-way leaves the last version in place, and readers keep the one they opened.

``append`` writes the changes of a graph only, so its cost is that of the changes.
Rows of a change stand for those of the same key in older folders, where a
table has rows that can be replaced. ``fold`` merges many changes into one and,
once they have grown to a share of the base, into the base, so every row is
rewritten a number of times that grows with the logarithm of the table.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gregaria.graph import Graph
from gregaria.operators.relational import FEW_ROWS, arg_max
from gregaria.schema import BASE, CLUSTER, DERIVED, REPLACED

WRITERS = 6
MAX_CHANGES = 8
FOLD_SHARE = 0.25  # of the base's rows in its changes, for both to be written anew

DEAD_MS = 600_000  # after which a manifest without content is taken for that of a dead writer

Part = dict  # {"path": folder, "rows": number of rows}


class ConcurrentWrite(RuntimeError):
    """Another writer has stored a version meanwhile."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _manifest(spark: SparkSession, root: str, version: int) -> dict[str, list[Part]] | None:
    """The parts of each table; None for a version that isn't complete."""
    fs, where = _fs(spark, f"{root}/v{version}/_COMPLETE")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["tables"]
    except ValueError:  # its writer died between creation and content
        return None
    finally:
        stream.close()


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, where = _fs(spark, root)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(name[1:]) for name in names if name.startswith("v") and name[1:].isdigit())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions below ``root``, oldest first."""
    return [n for n in _numbers(spark, root) if _manifest(spark, root, n) is not None]


def _commit(spark: SparkSession, root: str, parent: int | None, tables: dict[str, list[Part]]) -> int:
    """The version number under which ``tables`` are stored, if ``parent`` is still the newest one."""
    numbers = _numbers(spark, root)
    newest = next((n for n in reversed(numbers) if _manifest(spark, root, n) is not None), None)
    if newest != parent:
        raise ConcurrentWrite(f"version {newest} of {root} was stored after {parent}")
    version = (numbers or [0])[-1] + 1
    fs, where = _fs(spark, f"{root}/v{version}/_COMPLETE")
    for begun in (n for n in numbers if parent is None or n > parent):
        path = _fs(spark, f"{root}/v{begun}/_COMPLETE")[1]
        if fs.exists(path) and time.time() * 1000 - fs.getFileStatus(path).getModificationTime() < DEAD_MS:
            raise ConcurrentWrite(f"version {begun} of {root} is being stored by another writer")
    try:
        out = fs.create(where, False)
    except Exception as error:
        raise ConcurrentWrite(f"version {version} of {root} is being stored by another writer") from error
    out.write(bytearray(json.dumps({"parent": parent, "tables": tables}).encode()))
    out.close()
    return version


def _clustered(df: DataFrame, name: str) -> DataFrame:
    """Range-partitioned and sorted, with date as second key, so that one hot key still spreads over partitions."""
    if name not in CLUSTER:
        return df
    keys = [CLUSTER[name], *(c for c in ("creation_ms", "join_ms", "id", "person_id") if c in df.columns and c != CLUSTER[name])][:2]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


class _Writer:
    """Tables written into a new folder, which goes again if that fails."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root}/data/{uuid.uuid4().hex}"

    def __enter__(self) -> _Writer:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is not None:
            fs, where = _fs(self.spark, self.folder)
            fs.delete(where, True)

    def write(self, tables: dict[str, DataFrame], clustered: bool) -> dict[str, Part]:
        def one(item: tuple[str, DataFrame]) -> tuple[str, Part]:
            name, df = item
            path = f"{self.folder}/{name}"
            (_clustered(df, name) if clustered else df).write.mode("overwrite").parquet(path)
            return name, {"path": path, "rows": self.spark.read.schema(df.schema).parquet(path).count()}

        with ThreadPoolExecutor(WRITERS) as pool:  # several small jobs at once
            return dict(pool.map(one, tables.items()))


def _schema(name: str) -> str:
    return (BASE | DERIVED)[name]


def _last_changes(spark: SparkSession, name: str, parts: list[Part]) -> DataFrame:
    """The rows of several changes, of each key those of the last one that has it."""
    read = lambda i, part: spark.read.schema(_schema(name)).parquet(part["path"]).withColumn("_turn_no", F.lit(i))
    if len(parts) == 1:
        return read(0, parts[0]).drop("_turn_no")
    changes = reduce(DataFrame.unionByName, (read(i, part) for i, part in enumerate(parts)))
    return arg_max(changes, REPLACED[name], [F.col("_turn_no").desc()]).drop("_turn_no")


def _table(spark: SparkSession, name: str, parts: list[Part]) -> DataFrame:
    base, changes = parts[0], [p for p in parts[1:] if p["rows"]]
    reader = spark.read.schema(_schema(name))
    if name not in REPLACED or not changes:
        return reader.parquet(base["path"], *(p["path"] for p in changes))
    last = _last_changes(spark, name, changes)
    keys = last.select(*REPLACED[name])
    keys = F.broadcast(keys) if sum(p["rows"] for p in changes) <= FEW_ROWS else keys
    return reader.parquet(base["path"]).join(keys, REPLACED[name], "left_anti").unionByName(last)


def _opened(spark: SparkSession, root: str, version: int, parts: dict[str, list[Part]]) -> Graph:
    return Graph(spark, {name: _table(spark, name, parts[name]) for name in BASE | DERIVED}, origin=(root, version))


def save(graph: Graph, root: str) -> Graph:
    """The whole graph with its derived tables as the next version, and that version opened."""
    spark = graph.spark
    parent = (versions(spark, root) or [None])[-1]
    with _Writer(spark, root) as writer:
        parts = writer.write({name: graph.tables[name] for name in BASE}, True)
        stored = Graph(spark, {name: spark.read.schema(schema).parquet(parts[name]["path"]) for name, schema in BASE.items()})
        parts |= writer.write(stored.derived(), True)
        stored.release()
        tables = {name: [part] for name, part in parts.items()}
        version = _commit(spark, root, parent, tables)
    return _opened(spark, root, version, tables)


def append(graph: Graph, root: str) -> Graph:
    """The changes of a graph, made from the newest version below ``root``, as the next version, and that version opened."""
    spark = graph.spark
    if graph.origin is None or graph.origin[0] != root:
        raise ValueError("the graph was not opened from this folder")
    parent = graph.origin[1]
    with _Writer(spark, root) as writer:
        fresh = writer.write(graph.changes, False)
        tables = {name: [*parts, *([fresh[name]] if name in fresh and fresh[name]["rows"] else [])] for name, parts in _manifest(spark, root, parent).items()}
        version = _commit(spark, root, parent, tables)
    return _opened(spark, root, version, tables)


def fold(spark: SparkSession, root: str, max_changes: int = MAX_CHANGES) -> Graph:
    """The newest version with tables of more than ``max_changes`` changes merged, as a further version if there are any."""
    graph = open_version(spark, root)
    version = graph.origin[1]
    tables = _manifest(spark, root, version)
    many = {name: parts for name, parts in tables.items() if len(parts) - 1 > max_changes}
    if not many:
        return graph
    grown = {name for name, parts in many.items() if sum(p["rows"] for p in parts[1:]) >= FOLD_SHARE * parts[0]["rows"]}

    def changes(name: str) -> DataFrame:
        parts = many[name][1:]
        return _last_changes(spark, name, parts) if name in REPLACED else spark.read.schema(_schema(name)).parquet(*(p["path"] for p in parts))

    with _Writer(spark, root) as writer:
        merged = writer.write({name: graph.tables[name] if name in grown else changes(name) for name in many}, True)
        tables |= {name: [merged[name]] if name in grown else [many[name][0], merged[name]] for name in many}
        version = _commit(spark, root, version, tables)
    return _opened(spark, root, version, tables)


def open_version(spark: SparkSession, root: str, version: int | None = None) -> Graph:
    """The newest complete version, or the given one."""
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no complete version {'' if version is None else version} below {root}")
    version = known[-1] if version is None else version
    return _opened(spark, root, version, _manifest(spark, root, version))


def open_or_build(spark: SparkSession, root: str, build) -> Graph:
    """The stored graph if there is one, else what ``build()`` gives, stored."""
    return open_version(spark, root) if versions(spark, root) else save(build(), root)


def compact(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Removes all but the newest ``keep`` versions, and the folders that only those named.

    Folders of no complete version go too, so no writer may be at work, other
    than the caller's own, which has stored its version.
    """
    known = versions(spark, root)
    kept = known[-keep:]
    fs, data = _fs(spark, f"{root}/data")
    named = {part["path"].rsplit("/", 2)[-2:][0] for n in kept for parts in _manifest(spark, root, n).values() for part in parts}
    for version in _numbers(spark, root):
        if known and version < kept[0]:
            fs.delete(_fs(spark, f"{root}/v{version}")[1], True)
    if kept and fs.exists(data):
        for status in fs.listStatus(data):
            if status.getPath().getName() not in named:
                fs.delete(status.getPath(), True)
