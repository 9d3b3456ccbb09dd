"""Profiles in a versioned store whose buckets split as it grows.

Linear hashing deals clients into n buckets: with 2^k <= n < 2^(k+1) a client's bucket is its hash
modulo 2^(k+1) if that is below n, else modulo 2^k. One more bucket splits one old one and moves no
other client, and buckets keep about ROWS rows. Updates are appended as small deltas; `fold` merges
deltas into new copies of the buckets they touch, and of those it splits. So a batch reads and folds
the buckets of its own clients, whose size does not depend on the size of the store. Every change is a
new version of the manifest: readers keep theirs, `read(version=...)` answers from an older one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profiles import latest_cells, profile_rows
from ..schemas import PROFILE
from .manifest import Conflict, Manifest

ROWS = 500_000
KEPT_VERSIONS = 32

_STORED = T.StructType(PROFILE.fields + [T.StructField("updated_at", T.DoubleType())])


def bucket_of(ip: str, n: int) -> Column:
    """The client's bucket of `n`."""
    low = 1 << (n.bit_length() - 1)
    wide = F.pmod(F.xxhash64(ip), F.lit(2 * low))
    return F.when(wide < n, wide).otherwise(F.pmod(F.xxhash64(ip), F.lit(low))).cast("int")


def parent(bucket: int) -> int:
    """The bucket that was split to make this one."""
    return bucket - (1 << (bucket.bit_length() - 1))


class VersionedProfiles:
    """A profile store below a folder; `rows` is the size buckets grow to."""

    def __init__(self, spark: SparkSession, path: str, rows: int = ROWS):
        self.spark, self.path, self.rows = spark, path.rstrip("/"), rows
        # base: bucket -> its folder and rows; a delta knows the number of buckets it was dealt into
        self.manifest = Manifest(spark, self.path, {"n": 1, "base": {}, "deltas": []})

    def version(self) -> int:
        return self.manifest.read()[0]

    def _write(self, rows: DataFrame, label: str, n: int) -> tuple[str, dict[str, int]]:
        """Write rows by bucket; returns the folder and the rows of each bucket it has."""
        name = f"{label}-{uuid.uuid4().hex}"
        (rows.withColumn("bucket", bucket_of("ip", n)).hint("rebalance", F.col("bucket"))
         .write.partitionBy("bucket").parquet(f"{self.path}/{name}"))
        stored = self.spark.read.schema("bucket int").parquet(f"{self.path}/{name}")
        return name, {str(r["bucket"]): r["count"] for r in stored.groupBy("bucket").count().collect()}

    def append(self, updates: DataFrame, batch_id, written_at: float | None = None) -> int:
        """Store updates (any subset of the cells, plus `updated_at`) as one batch; again replaces it.

        `updated_at` orders updates inside the batch; between batches the time of writing does."""
        now = F.unix_micros(F.current_timestamp()) / F.lit(1e6)
        stamp = now if written_at is None else F.lit(float(written_at))
        n = self.manifest.read()[1]["n"]
        name, counts = self._write(profile_rows(latest_cells(updates)).withColumn("updated_at", stamp), "delta", n)
        delta = {"name": name, "batch": str(batch_id), "n": n, "rows": counts}
        return self.manifest.commit(lambda state: {
            **state, "deltas": [*(d for d in state["deltas"] if d["batch"] != str(batch_id)), delta]})

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).parquet(*[f"{self.path}/{f}" for f in folders])

    def folders(self, state: dict, clients: DataFrame | None = None, without_batch=None) -> list[str]:
        """Bucket folders to read for all clients or for those named."""
        deltas = [d for d in state["deltas"] if d["batch"] != str(without_batch)]
        wanted = None
        if clients is not None:
            kinds = sorted({state["n"], *(d["n"] for d in deltas)})
            row = clients.select(*[F.collect_set(bucket_of("ip", n)).alias(str(n)) for n in kinds]).first()
            wanted = {n: set(row[str(n)]) for n in kinds}  # no more buckets than the store has
        hit = lambda n, bucket: wanted is None or int(bucket) in wanted[n]
        return ([f"{b['name']}/bucket={k}" for k, b in state["base"].items() if hit(state["n"], k)]
                + [f"{d['name']}/bucket={k}" for d in deltas for k in d["rows"] if hit(d["n"], k)])

    def read(self, version: int | None = None, without_batch=None, clients: DataFrame | None = None) -> DataFrame:
        """Current profiles, or those of a version; with `clients` (column `ip`) theirs alone."""
        state = self.manifest.read(version)[1]
        stored = self._read(self.folders(state, clients, without_batch))
        if clients is not None:
            stored = stored.join(clients.select("ip").distinct(), "ip", "left_semi")
        return latest_cells(stored.select("ip", *[c for c in stored.columns if c != "ip"])).select(*PROFILE.names)

    def fold(self, without_batch=None) -> int:
        """Merge all deltas but one into their buckets, and split as many as the size asks for."""
        version, state = self.manifest.read()
        deltas = [d for d in state["deltas"] if d["batch"] != str(without_batch)]
        if not deltas:
            return version
        n, base = state["n"], state["base"]
        rows = sum(b["rows"] for b in base.values()) + sum(sum(d["rows"].values()) for d in deltas)
        grown = max(n, min(2 * n, -(-rows // self.rows)))
        added = self._read([f"{d['name']}/bucket={k}" for d in deltas for k in d["rows"]])
        touched = {r["b"] for r in added.select(bucket_of("ip", n).alias("b")).distinct().collect()}
        touched |= {parent(b) for b in range(n, grown)}
        old = {k: b for k, b in base.items() if int(k) in touched}
        merged = latest_cells(added.unionByName(self._read([f"{b['name']}/bucket={k}" for k, b in old.items()])),
                              F.max("updated_at").alias("updated_at"))
        name, counts = self._write(merged, "base", grown)
        gone = {d["name"] for d in deltas}

        def folded(now: dict) -> dict:
            if now["n"] != n or any(now["base"].get(k) != base.get(k) for k in map(str, touched)):
                raise Conflict("another fold has changed these buckets")
            left = {k: b for k, b in now["base"].items() if int(k) not in touched}
            return {"n": grown, "base": left | {k: {"name": name, "rows": c} for k, c in counts.items()},
                    "deltas": [d for d in now["deltas"] if d["name"] not in gone]}

        version = self.manifest.commit(folded)
        self.manifest.vacuum(lambda s: {b["name"] for b in s["base"].values()} | {d["name"] for d in s["deltas"]},
                             KEPT_VERSIONS)
        return version
