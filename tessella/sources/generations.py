"""Published generations of tables: a reader sees a whole generation or the one before.

    root/staging/<id>/<table>       what a writer is at
    root/generations/<id>/<table>   moved there in one step, with manifest.json and COMMIT.json
    root/CURRENT.json               the generation that readers use
    root/writer.lease               at most one writer

A generation counts when COMMIT.json holds the hash of manifest.json; the manifest has rows, bytes and
a digest of each table, taken from what was staged and not from what was meant. Nothing that is
committed is ever changed. What a writer leaves behind when it stops, at whatever step, is either
ignored by readers or finished by recover(). Rows stay in Spark: the driver writes the small files only.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

VERSION = "1.0.0"
LIMBS = 8  # of a SHA-256, 32 bits each


class LeaseHeld(RuntimeError):
    """Another writer has the lease."""


class NotCommitted(RuntimeError):
    """There is no such generation, or it isn't whole."""


def content_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table: SHA-256 of the rows' SHA-256, added up limb by limb. The order of rows and files is no matter; repeated rows count."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    limb = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"l{k}") for k in range(LIMBS)]
    found = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), *limb).head()
    text = ",".join(str(int(found[f"l{k}"] or 0)) for k in range(LIMBS))
    return found["n"], hashlib.sha256(f"{found['n']},{text}".encode()).hexdigest()


def _canonical(value: dict) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")) + "\n"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Lease:
    """The right to write under a root. A lease whose heartbeat is older than `ttl` seconds may be taken over, once."""

    spark: SparkSession
    root: str
    run_id: str
    ttl: float = 3600
    nonce: str = field(default_factory=lambda: uuid.uuid4().hex)
    now: Callable[[], float] = time.time

    @property
    def path(self) -> str:
        return f"{self.root}/writer.lease"

    def _text(self) -> str:
        return _canonical({"nonce": self.nonce, "run_id": self.run_id, "heartbeat_at": self.now()})

    def acquire(self) -> Lease:
        if not files.create(self.spark, self.path, self._text()):
            held = files.read_json(self.spark, self.path) or {}
            if self.now() - held.get("heartbeat_at", 0) <= self.ttl:
                raise LeaseHeld(f"{self.path}: {held.get('run_id')}")
            # Only one writer can move the old lease away.
            if not files.move(self.spark, self.path, f"{self.root}/stale/{held.get('nonce', 'unknown')}-{self.nonce}") or not files.create(self.spark, self.path, self._text()):
                raise LeaseHeld(f"{self.path}: taken over meanwhile")
        self.check()
        return self

    def check(self) -> None:
        """Fails if the lease is another's by now."""
        if (files.read_json(self.spark, self.path) or {}).get("nonce") != self.nonce:
            raise LeaseHeld(f"{self.path}: lost")

    def renew(self) -> None:
        self.check()
        files.replace(self.spark, self.path, self._text())

    def release(self) -> None:
        """Removes the lease if it is still this writer's, and never another's."""
        if (files.read_json(self.spark, self.path) or {}).get("nonce") == self.nonce:
            files.delete(self.spark, self.path)


def manifest_of(spark: SparkSession, root: str, generation: str) -> dict:
    """The manifest of a committed generation."""
    base = f"{root}/generations/{generation}"
    text, commit = files.read_text(spark, f"{base}/manifest.json"), files.read_json(spark, f"{base}/COMMIT.json")
    if not text or not commit or commit.get("manifest_sha256") != _sha(text) or commit.get("generation_id") != generation:
        raise NotCommitted(f"{base} isn't committed")
    return json.loads(text)


def committed(spark: SparkSession, root: str) -> list[dict]:
    """The manifests of all committed generations, oldest first."""
    found = []
    for name in files.names(spark, f"{root}/generations"):
        try:
            found.append(manifest_of(spark, root, name))
        except NotCommitted:
            pass
    return sorted(found, key=lambda m: (m["number"], m["generation_id"]))


def current(spark: SparkSession, root: str) -> dict | None:
    """The manifest that readers use: the pointer's, or the last committed one where the pointer is gone or broken."""
    pointer = files.read_json(spark, f"{root}/CURRENT.json") or {}
    try:
        found = manifest_of(spark, root, pointer.get("generation_id", ""))
        if pointer.get("manifest_sha256") == _sha(_canonical(found)):
            return found
    except NotCommitted:
        pass
    return (committed(spark, root) or [None])[-1]


def read(spark: SparkSession, root: str, table: str, generation: str | None = None) -> DataFrame:
    """A table of a committed generation, the current one by default."""
    m = manifest_of(spark, root, generation) if generation else current(spark, root)
    if m is None or table not in m["tables"]:
        raise NotCommitted(f"{root} has no committed table {table}")
    return spark.read.parquet(f"{root}/generations/{m['generation_id']}/{table}")


def verify(spark: SparkSession, root: str, generation: str | None = None) -> dict[str, bool]:
    """Whether each table of a generation still has the rows and digest of its manifest."""
    m = manifest_of(spark, root, generation) if generation else current(spark, root)
    if m is None:
        raise NotCommitted(f"{root} has no generation")
    return {name: content_digest(read(spark, root, name, m["generation_id"])) == (t["rows"], t["sha256"]) for name, t in m["tables"].items()}


def _point(spark: SparkSession, root: str, m: dict) -> None:
    files.replace(spark, f"{root}/CURRENT.json", _canonical({"schema_version": VERSION, "generation_id": m["generation_id"], "state": "current", "manifest_sha256": _sha(_canonical(m))}))


def recover(spark: SparkSession, root: str, lease: Lease) -> dict[str, list[str]]:
    """Under a lease: removes what was never committed, and points at the last commit where the pointer is broken or behind it on account of a stop.

    A pointer that someone has put back on purpose (promote) stays."""
    lease.check()
    done = {"removed": [], "pointed": []}
    for name in files.names(spark, f"{root}/staging"):
        files.delete(spark, f"{root}/staging/{name}")
        done["removed"].append(name)
    whole = committed(spark, root)
    for name in set(files.names(spark, f"{root}/generations")) - {m["generation_id"] for m in whole}:
        files.delete(spark, f"{root}/generations/{name}")
        done["removed"].append(name)
    pointer = files.read_json(spark, f"{root}/CURRENT.json") or {}
    intent = files.read_json(spark, f"{root}/INTENT.json") or {}
    known = {m["generation_id"]: m for m in whole}
    target = known.get(intent.get("generation_id")) or known.get(pointer.get("generation_id")) or (whole[-1] if whole else None)
    if target and (pointer.get("generation_id"), pointer.get("manifest_sha256")) != (target["generation_id"], _sha(_canonical(target))):
        _point(spark, root, target)
        done["pointed"].append(target["generation_id"])
    files.delete(spark, f"{root}/INTENT.json")
    return done


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], run_id: str, checks: dict[str, Callable[[DataFrame], bool]] | None = None, facts: dict | None = None, step: Callable[[str], None] | None = None, ttl: float = 3600) -> dict:
    """Publishes tables as the next generation and returns its manifest.

    A generation is named by its number and the run, so each call makes a new one. checks: of staged
    tables; where one is false nothing is published. facts go to the manifest. step is called with the
    name of each step before it; what it raises stops the writer there, as a lost driver would.
    """
    say = step or (lambda name: None)
    say("lease")
    lease = Lease(spark, root, run_id, ttl).acquire()
    say("recover")
    recover(spark, root, lease)
    number = max([m["number"] for m in committed(spark, root)], default=0) + 1
    generation = f"g{number:08d}-{run_id}"
    staged, found = f"{root}/staging/{generation}", {}
    for name, df in sorted(tables.items()):
        say(f"stage {name}")
        lease.renew()
        df.write.mode("overwrite").parquet(f"{staged}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{staged}/{name}")
        if checks and name in checks and not checks[name](back):
            files.delete(spark, staged)
            lease.release()
            raise ValueError(f"{name} fails its check; nothing is published")
        rows, digest = content_digest(back)
        fs, p = files._at(spark, f"{staged}/{name}")
        found[name] = {"rows": rows, "sha256": digest, "bytes": fs.getContentSummary(p).getLength(), "schema": df.schema.simpleString()}
    m = {"schema_version": VERSION, "generation_id": generation, "number": number, "run_id": run_id, "parent": (current(spark, root) or {}).get("generation_id"), "facts": facts or {}, "tables": found}
    say("move")
    lease.renew()
    if not files.move(spark, staged, f"{root}/generations/{generation}"):
        raise RuntimeError(f"{generation} is there already")
    say("manifest")
    files.create(spark, f"{root}/generations/{generation}/manifest.json", _canonical(m))
    say("intent")
    files.create(spark, f"{root}/INTENT.json", _canonical({"generation_id": generation}), overwrite=True)
    say("commit")
    lease.check()
    if not files.create(spark, f"{root}/generations/{generation}/COMMIT.json", _canonical({"schema_version": VERSION, "generation_id": generation, "manifest_sha256": _sha(_canonical(m))})):
        raise RuntimeError(f"{generation} is committed already")
    say("point")
    _point(spark, root, m)
    say("release")
    files.delete(spark, f"{root}/INTENT.json")
    lease.release()
    return m


def promote(spark: SparkSession, root: str, generation: str, run_id: str, eligible: Callable[[dict], bool] | None = None) -> dict:
    """Points readers at a committed generation, an older one too. eligible: of its manifest."""
    lease = Lease(spark, root, run_id).acquire()
    try:
        m = manifest_of(spark, root, generation)
        if eligible and not eligible(m):
            raise ValueError(f"{generation} isn't eligible")
        _point(spark, root, m)
        return m
    finally:
        lease.release()
