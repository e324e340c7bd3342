"""Versioned rule packs: tables that are never changed in place, and a manifest for each version that says which of them it is made of.

A commit writes new tables into folders of their own and then creates the next version's manifest, which fails if another writer
was faster. So a version is there as a whole or not at all, readers keep what they began with, and a revision and its activation are
one step.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.drafts import pack_findings
from tallyloom.operators.profiles import replay_profile
from tallyloom.operators.tasks import replay_summary, revised

PROFILES = "fingerprint string, strategy string, fields string, grammar string, revision int, profile string"


class Conflict(Exception):
    """Another writer has made the version that a commit was to make."""


class Version(NamedTuple):
    number: int
    meta: dict
    #: Folders of the tables by name.
    tables: dict[str, str]


class PackStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, number: int) -> str:
        return f"{self.path}/_manifests/{number:08d}.json"

    def current(self) -> Version:
        """The newest version; number 0, without tables, for a store that is empty. Manifests that aren't written out don't count."""
        folder = self._path(f"{self.path}/_manifests")
        names = sorted((f.getPath().getName() for f in self.fs.listStatus(folder)), reverse=True) if self.fs.exists(folder) else []
        for name in names:
            if name.endswith(".json") and (found := self.version(int(name.removesuffix(".json")))):
                return found
        return Version(0, {}, {})

    def version(self, number: int) -> Version | None:
        stream = self.fs.open(self._path(self._manifest(number)))
        try:
            held = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        except ValueError:
            return None
        finally:
            stream.close()
        return Version(number, held["meta"], held["tables"])

    def table(self, version: Version, name: str, schema: str) -> DataFrame:
        if name in version.tables:
            return self.spark.read.schema(schema).parquet(version.tables[name])
        return self.spark.createDataFrame([], schema)

    def commit(self, base: Version, meta: dict, tables: dict[str, DataFrame]) -> Version:
        """The version after `base`, with new meta and the given tables; all other tables are base's. Raises Conflict if base isn't the newest."""
        folders = dict(base.tables)
        for name, rows in tables.items():
            folders[name] = f"{self.path}/{name}/{uuid.uuid4().hex}"
            rows.write.parquet(folders[name])
        number = base.number + 1
        body = json.dumps({"meta": meta, "tables": folders}, ensure_ascii=False).encode()
        if not self._create(self._manifest(number), body):
            for name in tables:
                self.fs.delete(self._path(folders[name]), True)
            raise Conflict(f"version {number} is there already")
        return Version(number, meta, folders)

    def _create(self, name: str, body: bytes) -> bool:
        """Makes a file that wasn't there; whether it did. Hadoop's local file system looks before it creates, so links do it there."""
        path = self._path(name)
        if self.fs.getScheme() == "file":
            own = path.toUri().getPath()
            os.makedirs(os.path.dirname(own), exist_ok=True)
            new = f"{own}.{uuid.uuid4().hex}"
            try:
                with open(new, "xb") as f:
                    f.write(body)
                os.link(new, own)
            except FileExistsError:
                return False
            finally:
                os.unlink(new)
            return True
        try:
            out = self.fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        out.write(body)
        out.close()
        return True

    def update(self, change: Callable[[Version], tuple[dict, dict[str, DataFrame]]], tries: int = 10) -> Version:
        """Commits what change(newest version) gives, again from the newest one whenever another writer was faster."""
        for _ in range(tries):
            base = self.current()
            try:
                return self.commit(base, *change(base))
            except Conflict:
                continue
        raise Conflict(f"other writers were faster {tries} times")


# ---- life cycle ----


def profile_rows_of(spark: SparkSession, profiles: list[dict]) -> DataFrame:
    """Profiles as rows, the whole of each as JSON."""
    named = [(p["fingerprint"], p["strategy"], json.dumps(sorted(p["fields"]) if isinstance(p.get("fields"), dict) else [], ensure_ascii=False), p.get("grammar"), None, json.dumps(p, ensure_ascii=False)) for p in profiles]
    return spark.createDataFrame(named, PROFILES)


def pack_of(store: PackStore, version: Version) -> dict | None:
    """The active pack of a version, with its profiles; None if none is active. A pack's profiles are few by nature."""
    if not version.meta.get("active"):
        return None
    rows = store.table(version, "profiles", PROFILES).orderBy("fingerprint", "revision", "profile").collect()
    pack = version.meta["active"]
    return pack | {"version": str(version.number), "parser_policy": pack["parser_policy"] | {"format_profiles": [json.loads(r.profile) for r in rows]}}


def activate(store: PackStore, pack: dict, profiles: list[dict] | None = None) -> Version:
    """Makes a pack the active one, with the store's profiles or with the given ones in their place; a pack with errors is refused."""
    wrong = [e for e in pack_findings(pack | {"version": "1"})[0] if profiles is None or not e.startswith("parser_policy.format_profiles")]
    if wrong:
        raise ValueError(f"invalid pack: {', '.join(wrong)}")
    tables = {} if profiles is None else {"profiles": profile_rows_of(store.spark, profiles).withColumn("revision", F.lit(1))}
    return store.update(lambda base: (base.meta | {"active": pack}, tables))


def learn(store: PackStore, docs: DataFrame, key: str, profile: dict, expected: DataFrame) -> tuple[Version, dict]:
    """Replays a profile over samples, and if all of them pass, puts it into its slot and activates that, in one commit.

    Returns the newest version and the replay's summary; without samples, or with one that fails, nothing changes."""
    summary = replay_summary(replay_profile(docs, key, profile, expected)).first().asDict()
    if not summary["ok"]:
        return store.current(), summary

    def change(base: Version) -> tuple[dict, dict[str, DataFrame]]:
        held = store.table(base, "profiles", PROFILES)
        return base.meta, {"profiles": revised(held, profile_rows_of(store.spark, [profile])).select(*held.columns)}

    return store.update(change), summary
