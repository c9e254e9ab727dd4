"""Git repositories as tables, by the git command.

``spark.read.format("dagbag_git")`` with options ``addresses`` (one a line) and
``table`` reads

* ``commits``: address, sha, time, message, author_name, author_mail, parents
* ``diffs``: address, sha, parent, path, old_object_id, object_id (files that differ
  between a commit and each of its parents, a null one for commits without)
* ``trees``: address, sha, path, object_id (every file of every commit; only needed
  where a commit's tree is asked for by itself)
* ``blobs``: address, object_id, content (every file content once)
* ``blame``: address, path, author_name, author_mail, n_lines (at HEAD)

An address is a ``file:///`` URL of a repository, an ``http`` URL, or
``owner/name`` on GitHub; the latter two are cloned once, bare, into ``cache``, a
folder that all executors mount.
Reading runs git in every task, so :func:`ingest` writes the tables once as
Parquet, and analyses read those.
"""

from __future__ import annotations

import fcntl
import os
import re
import subprocess
import tempfile
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dagbag.operators.changes import Changes
from dagbag.operators.history import History
from dagbag.plans.lineage import shared_dir

SCHEMAS = {
    "commits": "address string, sha string, time bigint, message string, author_name string, author_mail string, parents array<string>",
    "diffs": "address string, sha string, parent string, path string, old_object_id string, object_id string",
    "trees": "address string, sha string, path string, object_id string",
    "blobs": "address string, object_id string, content binary",
    "blame": "address string, path string, author_name string, author_mail string, n_lines bigint",
}
#: Commits (of diffs and trees) or objects (of blobs) that one task reads.
SHARE = 500


def _git(path: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", path, *args], input=data, capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} in {path}: {done.stderr.decode(errors='replace')[:500]}")
    return done.stdout


def _stream(path: str, *args: str, data: bytes | None = None, end: bytes = b"\0") -> Iterator[bytes]:
    """What git writes, piece by piece, without holding all of it."""
    with tempfile.TemporaryFile() as given:  # a file can't block as a pipe may
        given.write(data or b"")
        given.seek(0)
        run = subprocess.Popen(["git", "-c", "safe.directory=*", "-C", path, *args], stdin=given, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        rest = b""
        while chunk := run.stdout.read(1 << 20):
            *whole, rest = (rest + chunk).split(end)
            yield from whole
        if rest:
            yield rest
        if run.wait():
            raise RuntimeError(f"git {args[0]} in {path} failed")


def local_repository(address: str, cache: str | None = None) -> str:
    """Folder of a repository; one that isn't local is cloned under a lock."""
    if address.startswith("file://"):
        return address[len("file://") :]
    if not cache:
        raise ValueError(f"{address} has to be cloned: name a folder that all executors mount as cache")
    url = address if address.startswith("http") else f"https://github.com/{address}.git"
    os.makedirs(cache, exist_ok=True)
    target = os.path.join(cache, re.sub(r"[^A-Za-z0-9._-]+", "_", address))
    with open(target + ".lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(target + ".ready"):
            subprocess.run(["git", "clone", "--bare", "--quiet", url, target], check=True)
            open(target + ".ready", "w").close()
    return target


def has_head(path: str) -> bool:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", path, "rev-parse", "-q", "--verify", "HEAD"], capture_output=True).returncode == 0


def _commits(address: str, path: str) -> Iterator[tuple]:
    # the message comes last, whatever bytes it has
    for entry in _stream(path, "log", "-z", "--format=%H%x1f%P%x1f%ct%x1f%an%x1f%ae%x1f%B", "HEAD"):
        sha, parents, seconds, name, mail, message = entry.decode(errors="replace").split("\x1f", 5)
        yield address, sha, int(seconds), message.rstrip("\n"), name, mail, parents.split()


def _diffs(address: str, path: str, part: int, of: int) -> Iterator[tuple]:
    mine, trees, empty = [], {}, _git(path, "hash-object", "-t", "tree", "--stdin").decode().strip()
    for i, entry in enumerate(_stream(path, "log", "--format=%H %T %P", "HEAD", end=b"\n")):
        sha, tree, *parents = entry.decode().split()
        if i % of == part:
            mine.append((sha, tree, parents))
        trees[sha] = tree
    pairs = [(sha, p, trees[p] if p else empty, tree) for sha, tree, parents in mine for p in parents or [None]]
    if not pairs:
        return
    # "old new" of each pair, a line feed, then for each file ":modes ids status", NUL, path, NUL
    at, meta = -1, None
    for piece in _stream(path, "diff-tree", "--stdin", "-r", "-z", "--raw", "--no-renames", "--no-abbrev", data="".join(f"{a} {b}\n" for _, _, a, b in pairs).encode()):
        if meta is None:
            *heads, meta = piece.split(b"\n")
            at += len(heads)
            if not meta.startswith(b":"):
                meta = None
            continue
        _, new_mode, old, new, status = meta[1:].split()
        sha, parent, _, _ = pairs[at]
        if not (meta[1:7] == b"160000" or new_mode == b"160000"):  # commits of other repositories
            side = lambda x: None if set(x) == {ord("0")} else x.decode()
            yield address, sha, parent, piece.decode(errors="replace"), side(old), side(new)
        meta = None


def _trees(address: str, path: str, part: int, of: int) -> Iterator[tuple]:
    for i, sha in enumerate(_git(path, "rev-list", "HEAD").decode().split()):
        if i % of == part:
            for entry in _git(path, "ls-tree", "-r", "-z", sha).split(b"\0"):
                if entry:
                    head, name = entry.split(b"\t", 1)
                    _, kind, object_id = head.split()
                    if kind == b"blob":
                        yield address, sha, name.decode(errors="replace"), object_id.decode()


def _blobs(address: str, path: str, part: int, of: int) -> Iterator[tuple]:
    """One process for all: header, content and a line feed of each object."""
    ids = sorted({x.split(b" ")[0].decode() for x in _stream(path, "rev-list", "--objects", "HEAD", end=b"\n")})
    mine = [x for x in ids if int(x[:8], 16) % of == part]
    if not mine:
        return
    kinds = _git(path, "cat-file", "--batch-check=%(objectname) %(objecttype)", data="\n".join(mine).encode() + b"\n").decode().splitlines()
    with tempfile.TemporaryFile() as given:
        given.write("".join(k.split()[0] + "\n" for k in kinds if k.endswith(" blob")).encode())
        given.seek(0)
        run = subprocess.Popen(["git", "-c", "safe.directory=*", "-C", path, "cat-file", "--batch"], stdin=given, stdout=subprocess.PIPE)
        while head := run.stdout.readline():
            object_id, _, size = head.decode().split()
            yield address, object_id, run.stdout.read(int(size))
            run.stdout.read(1)
        if run.wait():
            raise RuntimeError(f"git cat-file in {path} failed")


def _blame(address: str, path: str) -> Iterator[tuple]:
    for name in filter(None, _git(path, "ls-tree", "-r", "-z", "--name-only", "HEAD").decode(errors="replace").split("\0")):
        counts: dict[tuple[str, str], int] = {}
        author = ""
        for line in _git(path, "blame", "--line-porcelain", "HEAD", "--", name).decode(errors="replace").split("\n"):
            if line.startswith("author "):
                author = line[7:]
            elif line.startswith("author-mail "):
                key = (author, line[12:].strip("<>"))
                counts[key] = counts.get(key, 0) + 1
        for (who, mail), n in sorted(counts.items()):
            yield address, name, who, mail, n


class _Part(InputPartition):
    def __init__(self, address: str, part: int, of: int):
        super().__init__(None)
        self.address, self.part, self.of = address, part, of


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options.get("table", "commits")
        self.addresses = [a.strip() for a in options.get("addresses", "").split("\n") if a.strip()]
        self.cache = options.get("cache")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for a in self.addresses:
            of = 1
            if self.table in ("diffs", "trees", "blobs"):
                path = local_repository(a, self.cache)
                of = 1 + (int(_git(path, "rev-list", "--count", "HEAD")) if has_head(path) else 0) // SHARE
            out += [_Part(a, i, of) for i in range(of)]
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        path = local_repository(partition.address, self.cache)
        if not has_head(path):
            return
        if self.table == "commits":
            yield from _commits(partition.address, path)
        elif self.table == "diffs":
            yield from _diffs(partition.address, path, partition.part, partition.of)
        elif self.table == "trees":
            yield from _trees(partition.address, path, partition.part, partition.of)
        elif self.table == "blobs":
            yield from _blobs(partition.address, path, partition.part, partition.of)
        else:
            yield from _blame(partition.address, path)


class GitDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dagbag_git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_table(spark: SparkSession, addresses: list[str], table: str, cache: str | None = None) -> DataFrame:
    if cache is None and not all(a.startswith("file://") for a in addresses):
        shared = shared_dir(spark)
        if not shared.startswith(("file:", "/")):
            raise ValueError("name a folder that all executors mount as cache")
        cache = urlparse(shared).path + "/git"
    spark.dataSource.register(GitDataSource)
    reader = spark.read.format("dagbag_git").option("addresses", "\n".join(addresses)).option("table", table)
    return (reader.option("cache", cache) if cache else reader).load()


def ingest(spark: SparkSession, addresses: list[str], folder: str, tables: tuple[str, ...] = tuple(SCHEMAS), cache: str | None = None) -> None:
    """Write the tables as Parquet, so that git runs once."""
    for table in tables:
        read_table(spark, addresses, table, cache).write.mode("overwrite").parquet(f"{folder}/{table}")


_TABLES = ("commits", "trees", "blobs", "blame", "diffs")


class Repositories:
    """Tables of repositories, and histories over their commits.

    A node is the struct (address, sha); sha null is the virtual root that every
    commit without parents hangs from.
    """

    def __init__(self, commits: DataFrame, trees: DataFrame | None = None, blobs: DataFrame | None = None, blames: DataFrame | None = None, diffs: DataFrame | None = None):
        self.commits, self.trees, self.blobs, self.blames, self.diffs = commits, trees, blobs, blames, diffs

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Repositories:
        return cls(*[spark.read.parquet(f"{folder}/{t}") for t in _TABLES])

    @classmethod
    def of(cls, spark: SparkSession, addresses: list[str], cache: str | None = None) -> Repositories:
        return cls(*[read_table(spark, addresses, t, cache) for t in _TABLES])

    def history(self, roots: DataFrame | None = None) -> History:
        """Every commit has itself, once.  ``roots(address)`` adds the root of
        repositories without commits."""
        node = lambda sha: F.struct(F.col("address"), sha.alias("sha"))
        none = F.lit(None).cast("string")
        own = self.commits.select(node(F.col("sha")).alias("node"))
        addresses = self.commits.select("address") if roots is None else self.commits.select("address").unionByName(roots.select("address"))
        nodes = own.unionByName(addresses.distinct().select(node(none).alias("node")))
        parents = F.when(F.size("parents") > 0, F.col("parents")).otherwise(F.array(none))
        edges = self.commits.select("address", "sha", F.explode(parents).alias("parent")).select(node(F.col("parent")).alias("src"), node(F.col("sha")).alias("dst"))
        values = nodes.select("node", F.col("node").alias("key"), F.lit(1).cast("bigint").alias("val"))
        return History.from_frames(nodes, edges, values, ["key"], normal=True)

    def _single(self, h: History, *columns: str) -> History:
        """One key a commit, from its row; the root has none."""
        rows = h.nodes().join(self.commits, (F.col("node.address") == F.col("address")) & (F.col("node.sha") == F.col("sha")))
        names = ["key"] if len(columns) == 1 else list(columns)
        values = rows.select("node", *[F.col(c).alias(n) for c, n in zip(columns, names)], F.lit(1).cast("bigint").alias("val"))
        return History.from_frames(h.nodes(), h.edges(), values, names, normal=True)

    def message(self, h: History) -> History:
        return self._single(h, "message")

    def author(self, h: History) -> History:
        return self._single(h, "author_name", "author_mail")

    def time(self, h: History) -> History:
        return self._single(h, "time")

    def date(self, h: History) -> History:
        return self.time(h).tmap(lambda t: F.timestamp_seconds(t))

    def resources(self, h: History, suffix: str | None = None) -> History:
        """(path, resource) of every file of the commits that are a node's keys;
        ``suffix`` filters paths where they are read."""
        if self.trees is None:
            return self.resource_changes(suffix).states()
        trees = self.trees if suffix is None else self.trees.filter(F.col("path").endswith(suffix))
        rows = h.values().join(trees, (F.col("key.address") == F.col("address")) & (F.col("key.sha") == F.col("sha")))
        values = rows.select("node", "path", F.struct("address", "object_id").alias("resource"), "val")
        return History.from_frames(h.nodes(), h.edges(), values, ["path", "resource"])

    def resource_changes(self, suffix: str | None = None) -> Changes:
        """:meth:`resources` of the whole history in change form: rows are the files that
        commits change, not those that they have."""
        diffs = self.diffs if suffix is None else self.diffs.filter(F.col("path").endswith(suffix))
        end = lambda c: F.struct(F.col("address"), F.col(c).alias("sha"))
        sides = F.array(*[F.struct(F.col(c).alias("object_id"), F.lit(v).cast("bigint").alias("val")) for c, v in (("old_object_id", -1), ("object_id", 1))])
        rows = diffs.select("address", F.struct(end("parent").alias("src"), end("sha").alias("dst")).alias("node"), "path", F.explode(sides).alias("s")).filter("s.object_id is not null")
        rows = rows.select("node", "path", F.struct("address", "s.object_id").alias("resource"), "s.val")
        h = self.history()
        none = rows.filter(F.lit(False)).select(F.col("node.src").alias("node"), "path", "resource", "val")
        return Changes.from_frames(h.nodes(), h.edges(), none, rows, History.from_frames(h.nodes(), h.edges(), none, ["path", "resource"]))

    def tree(self, address: str, sha: str, suffix: str = "") -> DataFrame:
        """(path, resource) of one commit."""
        found = self.trees.filter((F.col("address") == address) & (F.col("sha") == sha) & F.col("path").endswith(suffix))
        return found.select("path", F.struct("address", "object_id").alias("resource"))

    def tree_diff(self, address: str, last: str | None, current: str | None) -> DataFrame:
        """(path, old_object_id, new_object_id) of changed files; a null commit is empty."""
        side = lambda sha, name: self.trees.filter((F.col("address") == address) & (F.col("sha") == F.lit(sha))).select("path", F.col("object_id").alias(name))
        both = side(last, "old_object_id").join(side(current, "new_object_id"), "path", "full_outer")
        return both.filter(~F.col("old_object_id").eqNullSafe(F.col("new_object_id")))

    def removed_and_added(self, address: str, last: str | None, current: str | None) -> tuple[DataFrame, DataFrame]:
        """(path, object_id) of the old and of the new side of the changes."""
        d = self.tree_diff(address, last, current)
        side = lambda c: d.filter(F.col(c).isNotNull()).select("path", F.col(c).alias("object_id"))
        return side("old_object_id"), side("new_object_id")

    def contents(self) -> DataFrame:
        """(resource, content): every distinct file content as text."""
        return self.blobs.select(F.struct("address", "object_id").alias("resource"), F.decode("content", "UTF-8").alias("content"))

    def line_counts(self) -> DataFrame:
        """(resource, n_lines); a line feed at the end starts no line, an empty file has none."""
        text = F.regexp_replace("content", "\\n\\z", "")
        return self.contents().select("resource", F.when(F.length("content") == 0, 0).otherwise(F.size(F.split(text, "\n"))).cast("bigint").alias("n_lines"))

    def blame(self, path: str) -> DataFrame:
        """(address, author_name, author_mail, n_lines) of a file at HEAD."""
        return self.blames.filter(F.col("path") == path).drop("path")

    def attributes(self) -> DataFrame:
        """(node, attributes): the usual facts of a commit as a map of strings."""
        from dagbag.functions import text

        facts = {
            "date": text.iso_instant(F.col("time")), "fix": text.is_fix(F.col("message")).cast("string"), "issue": text.mentions_issue(F.col("message")).cast("string"),
            "address": F.col("address"), "sha": F.col("sha"), "parents": F.size("parents").cast("string"), "name": F.col("author_name"), "mail": F.col("author_mail"),
        }
        return self.commits.select(F.struct("address", "sha").alias("node"), F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v)]).alias("attributes"))
