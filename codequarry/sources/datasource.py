"""Archives and recorded remote trees as Spark data sources.

``spark.dataSource.register(ZipSource)``, then ``spark.read.format("zip_files").load("/data/repos")``. A partition is a run of
entries of one archive, told from its directory, so one huge archive is read by many tasks; a filter on ``path`` or ``repo_key`` is
pushed down and spares reading what it leaves out. Files are reached through ``pyarrow.fs``, by path or URI.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from .repos import RepoError, check_url, error_code, safe_zip_path

SCHEMA = "repo_key string, path string, size long, text string"
#: Entries of an archive or a tree in a partition, and rows in a batch.
ENTRIES, ROWS = 2000, 500


def _open(location: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(location) if "://" in location else (fs.LocalFileSystem(), location)


def _files(location: str, suffix: str) -> list[str]:
    """The files with ``suffix`` at a path, below a folder, or that match a pattern in their folder."""
    system, path = _open(location)
    prefix = location[: len(location) - len(path)] if "://" in location else ""
    folder, _, pattern = path.rpartition("/")
    if "*" in pattern or "?" in pattern:
        found = [i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.is_file and fnmatchcase(i.base_name, pattern)]
    else:
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise RepoError("not-found", location)
        found = [path] if info.is_file else [i.path for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.is_file and i.base_name.lower().endswith(suffix)]
    return sorted(prefix + f for f in found)


@dataclass
class Entries(InputPartition):
    location: str
    repo_key: str
    names: tuple[tuple[str, str], ...]  # as the archive or the tree has it, as it is shown


def pushed(filters: Iterable[Filter], columns: tuple[str, ...]) -> tuple[list, list[Filter]]:
    """Tests of (repo_key, path) for the filters that are understood, and the filters that Spark must apply itself."""
    tests, rest = [], []
    for f in filters:
        column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        at = columns.index(column) if column in columns else None
        if at is None or not isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith):
            rest.append(f)
        elif isinstance(f, EqualTo):
            tests.append(lambda row, at=at, v=f.value: row[at] == v)
        elif isinstance(f, In):
            tests.append(lambda row, at=at, v=frozenset(f.value): row[at] in v)
        elif isinstance(f, StringStartsWith):
            tests.append(lambda row, at=at, v=f.value: row[at].startswith(v))
        else:
            tests.append(lambda row, at=at, v=f.value: row[at].endswith(v))
    return tests, rest


class _Reader(DataSourceReader):
    """``listed`` gives (location, repo_key, [(inner name, path)]); ``contents`` reads some of them."""

    def __init__(self, options: dict[str, str]):
        self.options, self.tests = {k.lower(): v for k, v in options.items()}, []
        self.entries = int(self.options.get("entriesperpartition", ENTRIES))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.tests, rest = pushed(filters, ("repo_key", "path"))
        return rest

    def partitions(self) -> list[InputPartition]:
        out = []
        for location, key, names in self.listed():
            kept = [n for n in names if all(t((key, n[1])) for t in self.tests)]
            out += [Entries(location, key, tuple(kept[i : i + self.entries])) for i in range(0, len(kept), self.entries)]
        return out or [Entries("", "", ())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for path, size, data in self.contents(partition) if partition.names else ():
            try:
                rows.append((partition.repo_key, path, size, data.decode("utf-8")))
            except UnicodeDecodeError:
                rows.append((partition.repo_key, path, size, None))
            if len(rows) == ROWS:
                yield self._batch(rows)
                rows = []
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["repo_key", "path", "size", "text"])

    def listed(self) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
        raise NotImplementedError

    def contents(self, partition: Entries) -> Iterator[tuple[str, int, bytes]]:
        raise NotImplementedError


class ZipReader(_Reader):
    def listed(self) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
        for location in _files(self.options["path"], ".zip"):
            with self._archive(location) as z:
                last: dict[str, str] = {}  # of equal names the last stays
                for info in z.infolist():
                    if not (info.is_dir() or info.filename.startswith("__MACOSX/") or info.filename.rsplit("/", 1)[-1].startswith("._")):
                        last[safe_zip_path(info.filename)] = info.filename
            if not last:
                raise RepoError("empty-zip", location)
            yield location, self.options.get("repokey") or re.sub(r"(?i)\.zip$", "", location.rsplit("/", 1)[-1]), [(inner, path) for path, inner in last.items()]

    def contents(self, partition: Entries) -> Iterator[tuple[str, int, bytes]]:
        with self._archive(partition.location) as z:
            for inner, path in partition.names:
                data = z.read(inner)
                yield path, len(data), data

    @staticmethod
    def _archive(location: str) -> zipfile.ZipFile:
        system, path = _open(location)
        file = system.open_input_file(path)
        try:  # zipfile seeks before the start of a tiny file, which Arrow's files refuse
            return zipfile.ZipFile(io.BytesIO(file.readall()) if file.size() < 128 else file)
        except zipfile.BadZipFile as e:
            raise RepoError("bad-zip", str(e)) from e


class RecordedReader(_Reader):
    """A folder per repository: ``tree.json``, a recorded tree or flat manifest with its ``url`` and ``status``, and the contents below ``files/``."""

    def listed(self) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
        below = self.options.get("subdir", "").strip("/")
        below += "/" if below else ""
        for listing in _files(self.options["path"], "tree.json"):
            system, path = _open(listing)
            body = json.loads(system.open_input_file(path).readall())
            if "url" in body:
                check_url(body["url"])
            if code := error_code(int(body.get("status", 200)), body.get("remaining")):
                raise RepoError(code, listing)
            if body.get("truncated"):
                raise RepoError("truncated", listing)
            names = [e["path"] for e in body.get("tree", ()) if e.get("type") == "blob"] + [f["name"].lstrip("/") for f in body.get("files", ())]
            root = listing.removesuffix("tree.json")
            key = self.options.get("repokey") or root.rstrip("/").rsplit("/", 1)[-1]
            yield root, key, [(f"files/{safe_zip_path(n)}", n.removeprefix(below)) for n in names if n.startswith(below)]

    def contents(self, partition: Entries) -> Iterator[tuple[str, int, bytes]]:
        system, root = _open(partition.location)
        known = [i for i in system.get_file_info([root + inner for inner, _ in partition.names])]
        for info, (_, path) in zip(known, partition.names, strict=True):
            if info.is_file:  # what was not recorded is not there
                data = system.open_input_file(info.path).readall()
                yield path, len(data), data


class _Source(DataSource):
    def schema(self) -> str:
        return SCHEMA


class ZipSource(_Source):
    """Format ``zip_files``: options ``path`` (archive, folder or pattern), ``repoKey``, ``entriesPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "zip_files"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ZipReader(dict(self.options))


class RecordedSource(_Source):
    """Format ``recorded_files``: options ``path`` (folder of recorded repositories), ``repoKey``, ``subDir``, ``entriesPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "recorded_files"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return RecordedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Both formats, with filters pushed down (the setting holds for the session)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ZipSource, RecordedSource):
        spark.dataSource.register(source)
