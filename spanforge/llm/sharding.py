"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. When a tier holds `fan_in` shards or more, runs of alike
size are merged into files of up to the target size. Each change is one atomic commit of a versioned manifest: the
next manifest is written aside and renamed to a name that must not exist yet. A manifest names parts, immutable lists of
up to PART shards each; a commit writes the parts that it changes and one line for every other, and planning reads only parts
with shards to merge. Of two writers one fails, reads the
manifest again and commits on top of it; a merge whose shards another writer has replaced is given up. Readers see the
shards of one manifest, whole. Shards that the last manifest doesn't need stay for a retention time, so that readers
of older manifests go on; vacuum() deletes them afterwards.
"""

from __future__ import annotations

import functools
import json
import math
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import delete, fresh, new_path, size_in_bytes

MOST_GROUPS = 512  # merges of one job
ARRIVAL = 8 << 20  # bytes of an arrival's shards, about
TRIES = 20
PART = 1000  # shards of a manifest's part
NAMED = 100_000  # shards whose paths the driver names and whose numbers are broadcast, at most
SHARD = "__shard"


@dataclass
class Change:
    """Paths that leave a manifest, and shards that come at its end."""

    gone: set[str]
    added: list[dict]


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


def plain(path: str) -> str:
    """A path without the ways in which a local scheme is spelled."""
    return path.removeprefix("file:").lstrip("/")


class ShardStore:
    """A folder of shards and manifests on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64 << 20, fan_in: int = 8, small_bytes: int = 1 << 20, retain_ms: int = 3_600_000):
        self.spark, self.root, self.target, self.fan_in, self.small, self.retain_ms = spark, root.rstrip("/"), target_bytes, fan_in, small_bytes, retain_ms
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.named, self._known = NAMED, {}

    # -- manifests

    def _fs(self):
        return self.hadoop.Path(self.root).getFileSystem(self.conf)

    def _manifests(self) -> list[tuple[int, int]]:
        """(version, time of its commit) of each manifest."""
        folder = self.hadoop.Path(f"{self.root}/_manifests")
        fs = self._fs()
        if not fs.exists(folder):
            return []
        return sorted((int(s.getPath().getName()[9:-5]), s.getModificationTime()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("manifest-"))

    def versions(self) -> list[int]:
        return [v for v, _ in self._manifests()]

    def head(self, version: int | None = None) -> dict:
        """version, schema and parts (name, n: shards, small: those to be merged some day) of a manifest; the last one by default."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "schema": None, "parts": []}
            version = known[-1]
        return json.loads(self._text(f"manifest-{version:012d}.json"))

    def manifest(self, version: int | None = None) -> dict:
        """A manifest with all its shards (path, bytes, rows) in their order: a shard's place is its number."""
        head = self.head(version)
        return {**head, "shards": [s for p in head["parts"] for s in self._part(p["name"])]}

    def _text(self, name: str) -> str:
        stream = self._fs().open(self.hadoop.Path(f"{self.root}/_manifests/{name}"))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        out = self._fs().create(self.hadoop.Path(f"{self.root}/_manifests/{name}"), False)
        out.write(bytearray(text.encode()))
        out.close()

    def _part(self, name: str) -> list[dict]:
        """A part's shards. Parts never change, so the last ones that were read are kept."""
        if name not in self._known:
            while len(self._known) >= 64:
                self._known.pop(next(iter(self._known)))
            self._known[name] = [{k: v for k, v in json.loads(x).items() if k != "i"} for x in self._text(name).splitlines()]
        return self._known[name]

    def _new_parts(self, shards: list[dict]) -> list[dict]:
        """Parts of PART shards, written."""
        out = []
        for i in range(0, len(shards), PART):
            own, name = shards[i : i + PART], f"part-{uuid.uuid4().hex}.json"
            self._write(name, "".join(json.dumps({"i": k, **s}) + "\n" for k, s in enumerate(own)))
            out.append({"name": name, "n": len(own), "small": sum(self._mergeable(s) for s in own)})
        return out

    def _mergeable(self, s: dict) -> bool:
        return s["bytes"] < self.target * 3 // 4

    def to_merge(self, head: dict) -> list[dict]:
        """The shards that may be merged, out of the parts that have some."""
        return [s for p in head["parts"] if p["small"] for s in self._part(p["name"]) if self._mergeable(s)]

    def commit(self, before: dict, change: Change, schema: str | None) -> dict:
        """The next manifest's head, if `before` is still the last one. Shards keep their order."""
        lists: list[dict | list[dict]] = []  # parts that stay, and shards to be written
        for p in before["parts"]:
            changed = change.gone and p["small"] and any(s["path"] in change.gone for s in self._part(p["name"]))
            lists.append([s for s in self._part(p["name"]) if s["path"] not in change.gone] if changed else p)
        tail = []
        if lists and change.added and (len(lists[-1]) if isinstance(lists[-1], list) else lists[-1]["n"]) + len(change.added) <= PART:  # small arrivals don't make a part each
            last = lists.pop()
            tail = last if isinstance(last, list) else self._part(last["name"])
        parts, new = [], []
        for own in (*lists, [*tail, *change.added]):
            own = self._new_parts(own) if isinstance(own, list) else [own]
            new += [p for p in own if p not in before["parts"]]
            parts += own
        head = {"version": before["version"] + 1, "schema": schema or before["schema"], "parts": parts}
        aside = f".{uuid.uuid4().hex}.json"
        self._write(aside, json.dumps(head))
        from_, final = (self.hadoop.Path(f"{self.root}/_manifests/{n}") for n in (aside, f"manifest-{head['version']:012d}.json"))
        context = self.hadoop.FileContext.getFileContext(self._fs().getUri(), self.conf)
        kind = getattr(self.hadoop, "Options$Rename")
        try:
            context.rename(from_, final, self.spark.sparkContext._gateway.new_array(kind, 0))
        except Py4JJavaError as e:
            for name in (aside, *(p["name"] for p in new)):
                delete(self.spark, f"{self.root}/_manifests/{name}")
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                raise CommitConflict(f"version {head['version']} is there already") from e
            raise
        return head

    def _commit(self, folder: str, change: Change, schema: str | None = None) -> dict:
        """Commit a change on top of the last manifest, again after each conflict; the folder goes if shards that leave are no longer there, or if it fails."""
        done = None
        try:
            for _ in range(TRIES):
                before = self.head()
                if change.gone and not change.gone <= {s["path"] for s in self.to_merge(before)}:
                    return before
                try:
                    done = self.commit(before, change, schema)
                    return done
                except CommitConflict:
                    continue
            raise CommitConflict(f"{TRIES} other commits came first")
        finally:
            if done is None:
                delete(self.spark, folder)

    # -- data

    def _written(self, df: DataFrame, rows_per_shard: int = 0) -> tuple[str, list[dict]]:
        """A folder of new shards, in the order of their tasks; a write that fails leaves none."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        try:
            df.write.option("maxRecordsPerFile", rows_per_shard).parquet(folder)
            return folder, self._listed(folder)
        except Exception:
            delete(self.spark, folder)
            raise

    def _listed(self, folder: str) -> list[dict]:
        """The shards below a folder that a finished write left, with bytes and rows (from footers)."""
        fs, out = self._fs(), {}
        walk = fs.listFiles(self.hadoop.Path(folder), True)
        while walk.hasNext():
            s = walk.next()
            p = s.getPath()
            if p.getName().startswith("part-"):
                out[plain(p.toString())] = {"path": p.toString(), "bytes": s.getLen(), "rows": 0}
        if out:
            counted = self.spark.read.parquet(*[s["path"] for s in out.values()]).groupBy(F.col("_metadata.file_path").alias("p")).count().collect()
            for r in counted:  # one row a shard, as in the manifest
                out[plain(r["p"])]["rows"] = r["count"]
        return sorted((s for s in out.values() if s["rows"]), key=lambda s: s["path"].rsplit("/", 1)[-1].split("-")[1] + s["path"].rsplit(".c", 1)[-1])

    def append(self, df: DataFrame, rows_per_shard: int | None = None) -> dict:
        """Write an arrival as small shards (of ARRIVAL bytes about, by default) and commit them; an empty arrival commits its schema alone."""
        if rows_per_shard is None:
            rows_per_shard = max(1000, ARRIVAL * df.count() // max(1, size_in_bytes(df)))
        folder, shards = self._written(df, rows_per_shard)
        return self._commit(folder, Change(set(), shards), df.schema.json())

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(1, size) / self.small, self.fan_in))) if size > self.small else 0

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Groups of shards to merge: of one tier each, up to the target size, tiers of fan_in shards or more."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if self._mergeable(s):
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        groups = []
        for _, own in sorted(tiers.items()):
            if len(own) < self.fan_in:
                continue
            group, size = [], 0
            for s in own:
                if group and size + s["bytes"] > self.target:
                    groups.append(group)
                    group, size = [], 0
                group.append(s)
                size += s["bytes"]
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> dict:
        """One round: merge every group of the plan and commit.

        A group is read and written by one task, which nothing is shuffled for; groups go to jobs of several waves of
        tasks, each of which commits for itself. A job's merges are given up if another writer has replaced their shards.
        """
        now = self.head()
        groups = self.plan(self.to_merge(now))
        size = max(16, min(MOST_GROUPS, 4 * self.spark.sparkContext.defaultParallelism))
        for i in range(0, len(groups), size):
            some = groups[i : i + size]
            one = [self.spark.read.schema(self._schema(now)).parquet(*[s["path"] for s in g]).coalesce(1) for g in some]
            folder, merged = self._written(functools.reduce(DataFrame.union, one))
            now = self._commit(folder, Change({s["path"] for g in some for s in g}, merged))
        return now

    def vacuum(self, retain_ms: int | None = None) -> int:
        """Delete the shards, and then the manifests, that ended more than retain_ms ago; how many shards went.

        A version ends when the next one is committed. Only what some manifest names is deleted, so a write that
        hasn't committed yet is safe.
        """
        known = self._manifests()
        limit = self.spark._jvm.java.lang.System.currentTimeMillis() - (self.retain_ms if retain_ms is None else retain_ms)
        old = [v for (v, _), (_, ended) in zip(known[:-1], known[1:], strict=True) if ended <= limit]
        parts = lambda versions: {p["name"] for v in versions for p in self.head(v)["parts"]}
        ended, live = parts(old), parts([v for v, _ in known if v not in old])
        named = lambda names: {s["path"] for n in names for s in self._part(n)}
        gone = named(ended - live) - named(live - ended)  # what a part in both names is live
        for path in gone:
            delete(self.spark, path)
        for name in (*(f"manifest-{v:012d}.json" for v in old), *(ended - live)):
            delete(self.spark, f"{self.root}/_manifests/{name}")
        return len(gone)

    @staticmethod
    def _schema(manifest: dict) -> StructType:
        return StructType.fromJson(json.loads(manifest["schema"]))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a manifest, with the shard's number in it (__shard).

        The numbers come from the manifest's parts. Of at most NAMED shards the driver names the paths, and the numbers are
        broadcast; of more, the folders are read, and the numbers are joined, which drops what the manifest doesn't name.
        """
        m = self.head(version)
        schema = self._schema(m)
        count = sum(p["n"] for p in m["parts"])
        if not count:
            return self.spark.createDataFrame([], schema).withColumn(SHARD, F.lit(0).cast("long"))
        key = fresh("path", schema.names)
        starts = [sum(p["n"] for p in m["parts"][:k]) for k in range(len(m["parts"]))]
        begin = self.spark.createDataFrame([(p["name"], a) for p, a in zip(m["parts"], starts, strict=True)], "part string, start long")  # a row for each part
        listed = self.spark.read.schema("i long, path string").json([f"{self.root}/_manifests/{p['name']}" for p in m["parts"]]).select("i", "path", F.col("_metadata.file_name").alias("part"))
        bare = lambda c: F.regexp_replace(c, "^file:/*|^/*", "")
        numbers = listed.join(F.broadcast(begin), "part").select(bare("path").alias(key), (F.col("start") + F.col("i")).alias(SHARD))
        few = count <= self.named
        paths = [s["path"] for p in m["parts"] for s in self._part(p["name"])]
        paths = paths if few else sorted({x.rsplit("/", 1)[0] for x in paths})
        rows = self.spark.read.schema(schema).parquet(*paths).select("*", bare("_metadata.file_path").alias(key))
        return rows.join(F.broadcast(numbers) if few else numbers, key).drop(key)


def shard(df: DataFrame, root: str | None = None, rows_per_shard: int | None = None, **settings) -> ShardStore:
    """Append df as one arrival and compact until nothing is left to merge.

    Every row is kept, with nulls, repeats and all columns; an empty table gives a manifest without shards. The
    column __shard is this module's own and must not be among df's.
    """
    if SHARD in {c.lower() for c in df.columns}:
        raise ValueError(f"column {SHARD} is reserved")
    store = ShardStore(df.sparkSession, root or new_path(df.sparkSession, "shards"), **settings)
    now = store.append(df, rows_per_shard)
    while store.plan(store.to_merge(now)):  # each round leaves fewer shards
        now = store.compact()
    return store


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shard and text_sha256: where each document lies in the last manifest, read back from its shard. Null texts have no digest."""
    store = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), rows_per_shard=1000)
    return store.read().select("doc_id", F.col(SHARD).alias("shard"), F.sha2("text", 256).alias("text_sha256"))
