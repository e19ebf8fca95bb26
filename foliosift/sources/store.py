"""The store's tables published together: versioned Parquet files and one small manifest per version.

A version names the files of every table. A load writes new files first, in a folder that no version
names yet, and at last puts the next manifest in place by one rename that fails if another load
was faster. Readers take the newest manifest, so they see all of a load or nothing of it, and a load
that fails leaves what was there. ``clean`` deletes files that no kept version names.

A repeated load merges: rows are known by their key and compared by a digest of their other
columns. Unchanged rows stay where they are, a changed row keeps its id, a new one is numbered after
the last id. Only files with changed rows are written anew; a load that changes nothing publishes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliosift.sources import sinks

MANIFESTS, DATA = "_manifests", "data"
#: The column of a row's digest, stored with it so that a merge reads no other.
DIGEST = "_digest"


class Conflict(RuntimeError):
    """Another load published first; this one changed nothing and can be tried again."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._jvm = spark, root.rstrip("/"), spark._jvm

    # the few calls to the file system

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path(folder))) if fs.exists(self._path(folder)) else []

    def _put(self, name: str, text: str) -> None:
        """Writes beside, then renames; a name that is taken is a conflict."""
        beside = self._path(f"{MANIFESTS}/.{uuid.uuid4().hex}")
        out = self._fs().create(beside, False)
        out.write(text.encode())
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(beside, self._path(f"{MANIFESTS}/{name}"), no_options)
        except Exception as e:
            self._fs().delete(beside, False)
            raise Conflict(f"{name} is there already") from e

    def _text(self, name: str) -> str:
        return "".join(r[0] for r in self.spark.read.text(f"{self.root}/{MANIFESTS}/{name}", wholetext=True).collect())  # one small file

    def _delete(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    # versions

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names(MANIFESTS) if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """{version, tables: {name: {files, schema, rows, last_id}}}; version 0 has no tables."""
        known = self.versions()
        if version is None:
            version = max(known, default=0)
        return json.loads(self._text(f"{version:012d}.json")) if version in known else {"version": 0, "tables": {}}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as the newest, or a given, version has it."""
        return self._rows(self.manifest(version)["tables"][table]).drop(DIGEST)

    def _rows(self, entry: dict, files: list[str] | None = None) -> DataFrame:
        schema, files = StructType.fromJson(json.loads(entry["schema"])), entry["files"] if files is None else files
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in files]) if files else self.spark.createDataFrame([], schema)

    def counts(self, version: int | None = None) -> dict[str, int]:
        return {name: t["rows"] for name, t in self.manifest(version)["tables"].items()}

    def _write(self, rows: DataFrame, folder: str) -> list[str]:
        rows.write.parquet(f"{self.root}/{folder}")
        return [f"{folder}/{n}" for n in self._names(folder) if n.endswith(".parquet")]

    def _publish(self, base: dict, tables: dict[str, dict]) -> int:
        version = base["version"] + 1
        self._put(f"{version:012d}.json", json.dumps({"version": version, "tables": base["tables"] | tables}))
        return version

    # loads

    def replace(self, tables: dict[str, tuple[DataFrame, StructType, list[str]]]) -> int:
        """Puts whole tables in place of what they had; others stay. Of each: its rows, its schema and
        its key; rows are numbered by the key. Returns the version."""
        base, new = self.manifest(), {}
        for name, (rows, schema, key) in tables.items():
            shaped = _digested(sinks.loaded(_one_per_key(rows, schema, key), schema, *key), key)
            files = self._write(shaped, f"{DATA}/{uuid.uuid4().hex}/{name}")
            new[name] = self._counted({"files": files, "schema": shaped.schema.json()})
        return self._publish(base, new)

    def merge(self, tables: dict[str, tuple[DataFrame, StructType, list[str]]]) -> dict[str, dict[str, int]]:
        """Merges rows into the tables, all in one version. Returns what was done: new, changed and
        unchanged rows, and files written anew, of each table."""
        base, new, told = self.manifest(), {}, {}
        for name, (rows, schema, key) in tables.items():
            if name not in base["tables"]:
                shaped = _digested(sinks.loaded(_one_per_key(rows, schema, key), schema, *key), key)
                new[name] = self._counted({"files": self._write(shaped, f"{DATA}/{uuid.uuid4().hex}/{name}"), "schema": shaped.schema.json()})
                told[name] = {"new": new[name]["rows"], "changed": 0, "unchanged": 0, "rewritten_files": 0}
                continue
            entry, told[name] = self._merged(name, base["tables"][name], rows, schema, key)
            if entry:
                new[name] = entry
        if new:
            self._publish(base, new)
        return told

    def _merged(self, name: str, entry: dict, rows: DataFrame, schema: StructType, key: list[str]) -> tuple[dict | None, dict[str, int]]:
        incoming = _digested(sinks.shaped(_one_per_key(rows, schema, key).drop("id"), schema), key)
        file = F.regexp_extract(F.col("_metadata.file_path"), f"({DATA}/[^/]+/[^/]+/[^/]+)$", 1)
        old = self._rows(entry).select(*[F.col(k).alias(f"_old_{k}") for k in key], F.col("id").alias("_old_id"), F.col(DIGEST).alias("_old_digest"), file.alias("_file"))
        same = [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in key]
        joined = incoming.join(old, same, "left")
        state = F.when(F.col("_old_id").isNull(), "new").when(F.col(DIGEST) == F.col("_old_digest"), "unchanged").otherwise("changed")
        folder = f"{DATA}/{uuid.uuid4().hex}"
        # what differs, kept beside: the rest of the load reads no row that stays as it is
        counts = {r["state"]: r["count"] for r in joined.groupBy(state.alias("state")).count().collect()}  # three rows at most
        done = {s: counts.get(s, 0) for s in ("new", "changed", "unchanged")} | {"rewritten_files": 0}
        if not done["new"] and not done["changed"]:
            return None, done
        kept = [c for c in incoming.columns if c != "id"]
        self._write(joined.where(state != "unchanged").select(*kept, "_old_id", "_file"), f"{folder}/differs")
        differs = self.spark.read.parquet(f"{self.root}/{folder}/differs")
        changed = differs.where("_old_id IS NOT NULL")
        touched = sorted(r["_file"] for r in changed.select("_file").distinct().collect())  # names of files
        files = [f for f in entry["files"] if f not in touched]
        if touched:
            before = self._rows(entry, touched)
            rest = before.join(changed.select(F.col("_old_id").alias("id")), "id", "left_anti")
            again = changed.select(*[(F.col("_old_id") if c == "id" else F.col(c)).alias(c) for c in before.columns])
            files += self._write(rest.select(before.columns).unionByName(again), f"{folder}/{name}")
        if done["new"]:
            numbered = sinks.numbered(differs.where("_old_id IS NULL").drop("_old_id", "_file"), *key, after=entry["last_id"])
            files += self._write(numbered.select(*self._rows(entry, []).columns), f"{folder}/{name}-new")
        self._delete(f"{folder}/differs")
        return self._counted({"files": files, "schema": entry["schema"]}), done | {"rewritten_files": len(touched)}

    def _counted(self, entry: dict) -> dict:
        n, last = self._rows(entry).agg(F.count(F.lit(1)), F.coalesce(F.max("id"), F.lit(0))).first()
        return entry | {"rows": n, "last_id": last}

    def clean(self, keep: int = 1, busy: Callable[[str], bool] = lambda folder: False) -> list[str]:
        """Deletes all but the last ``keep`` manifests, and the folders under ``data`` that none of
        these names; ``busy`` tells folders of a load that still runs. Returns the folders."""
        known = self.versions()
        for version in known[:-keep] if keep else known:
            self._delete(f"{MANIFESTS}/{version:012d}.json")
        named = {f.split("/")[1] for v in known[-keep:] for t in self.manifest(v)["tables"].values() for f in t["files"]}
        gone = [n for n in self._names(DATA) if n not in named and not busy(n)]
        for n in gone:
            self._delete(f"{DATA}/{n}")
        return gone


def _digested(rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds the digest of what is neither key, id nor the time of loading."""
    told = [c for c in rows.columns if c not in (*key, "id", "created_at", DIGEST)]
    return rows.withColumn(DIGEST, F.sha2(F.to_json(F.struct(*told), {"ignoreNullFields": "false"}), 256))


def _one_per_key(rows: DataFrame, schema: StructType, key: list[str]) -> DataFrame:
    """Equal rows count once; rows that share a key but differ can't be told apart, and raise."""
    have = [f.name for f in schema.fields if f.name in rows.columns and f.name != "id"]
    once = rows.select(have).distinct()
    twice = once.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several rows have the key {[twice[0][k] for k in key]}")
    return once
