"""Repositories as ``files`` tables: local directories, ZIP archives, recorded remote trees.

One reader per kind behind ``read_repo``; all give (repo_key, path, size, language, text, content_hash).
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import paths
from ..functions.tokens import fnv1a
from ..schemas import LIMITS, SCHEMAS


class RepoError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _finish(rows: DataFrame) -> DataFrame:
    """Adds size, language and hash to (repo_key, path, text), in one pass over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [None if t is None else fnv1a(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes, pa.string())], names=[*b.schema.names, "content_hash"])

    typed = rows.select("repo_key", "path", F.coalesce("size", F.octet_length("text").cast("long")).alias("size"), "text", paths.language(F.col("path")).alias("language"))
    schema = "repo_key string, path string, size long, text string, language string, content_hash string"
    return typed.mapInArrow(run, schema).select(*[c.split()[0] for c in SCHEMAS["files"].split(", ")])


def scan_local(root: str, limits=LIMITS) -> list[tuple[str, int]]:
    """(path, size) of the files below a directory: skipped names in any case, bounded depth and number, unreadable ones left out."""
    if not os.path.isdir(root):
        raise RepoError("not-found-dir", root)
    out: list[tuple[str, int]] = []
    seen = 0
    stack = [("", 0)]
    while stack:
        rel, depth = stack.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            if seen >= (limits.scan_entries or float("inf")):
                return sorted(out)
            try:
                e.name.encode("utf-8")
                is_dir = e.is_dir(follow_symlinks=False)
                size = 0 if is_dir else e.stat(follow_symlinks=False).st_size
            except (OSError, UnicodeEncodeError):
                continue
            path = f"{rel}/{e.name}" if rel else e.name
            if is_dir:
                if e.name.lower() in X.SKIP_DIRS:
                    continue
                seen += 1
                if depth + 1 < limits.scan_depth:
                    stack.append((path, depth + 1))
            else:
                seen += 1
                out.append((path, size))
    return sorted(out)


def read_local(spark: SparkSession, root: str, repo_key: str) -> DataFrame:
    """A directory that all executors see. Listing and reading are Spark's; names are filtered before contents are read."""
    if "://" not in root and not os.path.isdir(root):
        raise RepoError("not-found-dir", root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.expr("path").substr(F.locate(base + "/", F.col("path")) + len(base) + 1, F.lit(1 << 20))
    rel = F.call_function("url_decode", F.replace(rel, F.lit("+"), F.lit("%2B")))
    listed = raw.withColumn("rel", rel)
    skip = F.exists(F.slice(F.split("rel", "/"), F.lit(1), F.size(F.split("rel", "/")) - 1), lambda s: F.lower(s).isin(*X.SKIP_DIRS))
    fits = F.col("length") <= LIMITS.read_bytes if LIMITS.read_bytes else F.lit(True)
    kept = listed.filter(~skip & (F.size(F.split("rel", "/")) <= LIMITS.scan_depth) & fits & ~paths.is_binary(F.col("rel")))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return _finish(kept.select(F.lit(repo_key).alias("repo_key"), F.col("rel").alias("path"), F.col("length").alias("size"), text.alias("text")).filter("text IS NOT NULL"))


def read_bytes(spark: SparkSession, root: str) -> DataFrame:
    """S3: (path, size, content) of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), "content")


def safe_zip_path(raw: str) -> str:
    """S6 for one name; raises ``zip-insecure``."""
    import re

    p = raw.replace("\\", "/")
    parts = [s for s in p.split("/") if s not in ("", ".")]
    device = re.compile(X.DEVICE_NAME.removeprefix("(?i)"), re.IGNORECASE)
    if p.startswith("/") or re.match("[A-Za-z]:", p) or ".." in parts or any(device.match(s) for s in parts) or not parts:
        raise RepoError("zip-insecure", raw)
    return "/".join(parts)


def zip_entries(data: bytes) -> list[tuple[str, bytes]]:
    """The files of an archive in order; directories and what macOS adds are skipped, the last of equal names stays."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise RepoError("bad-zip", str(e)) from e
    out: dict[str, bytes] = {}
    for info in z.infolist():
        if info.is_dir() or info.filename.startswith("__MACOSX/") or info.filename.rsplit("/", 1)[-1].startswith("._"):
            continue
        out[safe_zip_path(info.filename)] = z.read(info)
    if not out:
        raise RepoError("empty-zip", "no files")
    return list(out.items())


def read_zip(spark: SparkSession, path: str, repo_key: str | None = None) -> DataFrame:
    """Archives at a path or glob, one task each; the key is ``repo_key`` or the archive's name."""
    raw = spark.read.format("binaryFile").load(path)
    key = F.lit(repo_key) if repo_key else F.regexp_replace(paths.basename(F.col("path")), r"(?i)\.zip$", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for p, content in zip_entries(data):
                    try:
                        rows.append((name, p, len(content), content.decode("utf-8")))
                    except UnicodeDecodeError:
                        rows.append((name, p, len(content), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["repo_key", "path", "size", "text"])

    return _finish(raw.select(key.alias("repo_key"), "content").mapInArrow(run, "repo_key string, path string, size long, text string"))


ALLOWED_HOSTS = ("api.github.com", "raw.githubusercontent.com", "data.jsdelivr.com", "cdn.jsdelivr.net")
TIMEOUT_S = 15


def check_url(url: str) -> None:
    """Only https to known hosts."""
    u = urlparse(url)
    if u.scheme != "https" or u.hostname not in ALLOWED_HOSTS:
        raise RepoError("network", f"host not allowed: {url}")


def error_code(status: int, remaining: str | None = None) -> str | None:
    """What a response's status means; None if it is fine."""
    if status < 400:
        return None
    if status == 403 and remaining == "0" or status == 429:
        return "rate-limit"
    return {404: "not-found", 401: "private", 403: "private"}.get(status, "network")


def remote_tree(responses: DataFrame, sub_dir: str = "") -> DataFrame:
    """Entries (repo_key, path, type, size, sha) from recorded tree listings (repo_key, body), submodules left out.

    A listing that says it is truncated raises; ``sub_dir`` keeps what is below it, relative to it.
    """
    schema = "truncated boolean, tree array<struct<path:string,type:string,size:long,sha:string>>"
    body = responses.select("repo_key", F.from_json("body", schema).alias("b"))
    whole = F.when(F.col("b.truncated"), F.raise_error(F.lit("truncated"))).otherwise(F.col("b.tree"))
    e = body.select("repo_key", F.explode(whole).alias("e")).select("repo_key", "e.*").filter(F.col("type").isin("blob", "tree"))
    e = _below(e, sub_dir)
    return e.select("repo_key", "path", F.when(F.col("type") == "tree", "dir").otherwise("file").alias("type"), "size", "sha")


def manifest_tree(responses: DataFrame, sub_dir: str = "") -> DataFrame:
    """Entries from recorded flat manifests ``{"files": [{"name": "/path", "size": n}]}``."""
    body = responses.select("repo_key", F.explode(F.from_json("body", "files array<struct<name:string,size:long>>")["files"]).alias("f"))
    e = body.select("repo_key", F.regexp_replace("f.name", "^/", "").alias("path"), F.lit("file").alias("type"), F.col("f.size").alias("size"))
    return _below(e, sub_dir)


def _below(entries: DataFrame, sub_dir: str) -> DataFrame:
    prefix = sub_dir.strip("/") + "/"
    return entries if prefix == "/" else entries.filter(F.col("path").startswith(prefix)).withColumn("path", F.col("path").substr(F.lit(len(prefix) + 1), F.lit(1 << 20)))


def remote_files(tree: DataFrame, contents: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Files from recorded contents (repo_key, path, text), those missing there from ``fallback``."""
    t = tree.filter("type = 'file'").select("repo_key", "path", "size").join(contents.select("repo_key", "path", "text"), ["repo_key", "path"], "left")
    if fallback is not None:
        t = t.join(fallback.select("repo_key", "path", F.col("text").alias("text2")), ["repo_key", "path"], "left").withColumn("text", F.coalesce("text", "text2"))
    return _finish(t.filter("text IS NOT NULL").select("repo_key", "path", "size", "text"))


def search_repos(responses: DataFrame, most: int = 10) -> DataFrame:
    """The most starred repositories of recorded search results (query, body)."""
    schema = "items array<struct<full_name:string,description:string,stargazers_count:long,language:string>>"
    e = responses.select("query", F.explode(F.from_json("body", schema)["items"]).alias("r")).select("query", F.col("r.full_name").alias("full_name"), F.coalesce("r.description", F.lit("")).alias("description"), F.col("r.stargazers_count").alias("stars"), F.col("r.language").alias("language"))
    return e.orderBy(F.desc("stars"), "full_name").limit(most)


def route_input(inputs: DataFrame, column: str = "input") -> DataFrame:
    """(input, kind, owner, repo, branch, sub_dir, query): a repository's URL, ``owner/repo``, or words to search for.

    ``invalid`` is a URL of the host that isn't a repository's; an empty input gives no row.
    """
    seg = r"[A-Za-z0-9_.-]+"
    i = F.trim(F.col(column))
    ssh = rf"(?i)^git@github\.com:({seg})/({seg})$"
    url = rf"(?i)^(?:https?://)?(?:www\.)?github\.com/({seg})/({seg})(?:/tree/([^/\s#?]+)((?:/[^\s#?]*)?))?/?(?:[?#].*)?$"
    short = rf"^({seg})/({seg})$"
    kind = F.when(i.rlike(ssh) | i.rlike(url), "url").when(i.rlike(r"(?i)github\.com"), "invalid").when(i.rlike(short), "owner-repo").otherwise("search")
    pick = lambda k: F.when(i.rlike(ssh), F.regexp_extract(i, ssh, k)).when(i.rlike(url), F.regexp_extract(i, url, k)).when(F.col("kind") == "owner-repo", F.regexp_extract(i, short, k))
    part = lambda k: F.when((F.col("kind") == "url") & i.rlike(url), F.nullif(F.regexp_extract(i, url, k), F.lit("")))
    repo = F.when(F.col("kind") == "owner-repo", pick(2)).otherwise(F.regexp_replace(pick(2), r"(?i)\.git$", ""))
    out = inputs.filter(i != "").withColumn("kind", kind)
    return out.select(column, "kind", pick(1).alias("owner"), repo.alias("repo"), part(3).alias("branch"), F.nullif(F.regexp_replace(part(4), "^/|/$", ""), F.lit("")).alias("sub_dir"), F.when(F.col("kind") == "search", i).alias("query"))


READERS = {"local": read_local, "zip": read_zip}


def read_repo(spark: SparkSession, kind: str, location: str, repo_key: str) -> DataFrame:
    """One entry for each kind of source."""
    if kind not in READERS:
        raise RepoError("invalid-input", kind)
    return READERS[kind](spark, location, repo_key)
