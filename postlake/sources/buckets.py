"""Stored postings, their observations and their keys in buckets, changed batch by batch.

Each table is dealt to buckets by a hash: postings and observations by the posting's id, keys by
themselves. A batch reads only the buckets that its keys and postings fall into, and writes only those
it changes, each as a new version under the batch's number. What counts is the manifest, one small table
that names the version of every bucket in force; writing it ends a batch. So a batch that fails
leaves the old state, one that is repeated changes nothing, and nothing rewrites whole tables.

The keys of a posting are kept beside it: a batch looks its own keys up, and only of postings that it
changes are the keys made anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake import schemas
from postlake.operators.match import OBSERVED, stored_keys, wanted_keys, with_application
from postlake.operators.merge import Stored, upsert_postings
from postlake.session import cut
from postlake.sources.tables import _fs, read_snapshot, snapshots, write_snapshot

KEY = "high long, low long, first_seen_at timestamp, job_id string"
FORMS = {"jobs": schemas.JOB, "observations": schemas.OBSERVATION, "keys": KEY}
_MANIFEST = "name string, bucket int, batch long"


@dataclass(frozen=True)
class Store:
    """The folder of a store and its number of buckets, which never changes."""

    spark: SparkSession
    root: str
    buckets: int = 1024
    #: Files a bucket may be written in, so that a key shared by very many postings is not one task.
    spread: int = 8

    def _of(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def bucket(self, name: str) -> Column:
        return {"jobs": self._of("id"), "observations": self._of("job_id"), "keys": self._of("high")}[name]

    def batches(self) -> list[int]:
        """The numbers of finished batches."""
        return snapshots(self.spark, f"{self.root}/manifest")

    def manifest(self) -> DataFrame:
        return read_snapshot(self.spark, f"{self.root}/manifest", _MANIFEST)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some buckets of it."""
        rows = self.manifest().where(F.col("name") == name).collect()  # one row for each bucket at most
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.root}/{name}/batch={r['batch']}/bucket={r['bucket']}" for r in rows if wanted is None or r["bucket"] in wanted]
        if not paths:
            return self.spark.createDataFrame([], FORMS[name])
        return self.spark.read.schema(FORMS[name]).parquet(*paths)

    def _write(self, name: str, rows: DataFrame, number: int) -> None:
        salt = F.pmod(F.xxhash64("job_id" if name == "keys" else "bucket"), F.lit(self.spread))
        dealt = rows.withColumn("bucket", self.bucket(name)).repartition("bucket", salt)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/batch={number}")

    def _written(self, name: str, number: int) -> list[int]:
        folder = f"{self.root}/{name}/batch={number}"
        fs, path = _fs(self.spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []
        return [int(n.split("=")[1]) for n in names if n.startswith("bucket=")]

    def commit(self, number: int, parts: dict[str, tuple[DataFrame, list[int] | None]]) -> None:
        """Write the rows of the changed buckets (None: of all) and put them in force."""
        gone, new = [], []
        for name, (rows, changed) in parts.items():
            self._write(name, rows, number)
            new += [(name, b, number) for b in self._written(name, number)]
            gone += [(name, b) for b in (range(self.buckets) if changed is None else changed)]
        old = self.manifest()
        kept = old.join(self.spark.createDataFrame(gone, "name string, bucket int"), ["name", "bucket"], "left_anti") if gone else old
        write_snapshot(kept.union(self.spark.createDataFrame(new, _MANIFEST)).coalesce(1), f"{self.root}/manifest", number)

    def load(self, jobs: DataFrame, observations: DataFrame, number: int = 1) -> None:
        """Start a store from whole tables."""
        if number in self.batches():
            return
        jobs, observations = jobs.select(*_names("jobs")), observations.select(*_names("observations"))
        self.commit(number, {"jobs": (jobs, None), "observations": (observations, None), "keys": (stored_keys(jobs, observations), None)})

    def match(self, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(batch_seq, job_id) of rows that a stored posting matches, and (job_id) of the postings that
        hold the observations of these rows, looked up in the kept keys."""
        wanted = cut(wanted_keys(incoming, *range(7)), "wanted")
        places = [r["b"] for r in wanted.select(self.bucket("keys").alias("b")).distinct().collect()]
        kept = self.read("keys", places).join(wanted.select("high", "low").distinct(), ["high", "low"], "left_semi")
        best = kept.groupBy("high", "low").agg(F.min(F.struct("first_seen_at", "job_id")).alias("hit"))
        hits = cut(wanted.join(best, ["high", "low"]), "hits")
        first = hits.groupBy("batch_seq").agg(F.min(F.struct("step", "hit")).alias("first"))
        observed = hits.where(F.col("step") == OBSERVED).select("hit.job_id").distinct()
        return cut(first.select("batch_seq", "first.hit.job_id"), "matched"), observed

    def store(self, incoming: DataFrame, priorities: DataFrame, number: int) -> Stored | None:
        """Store a batch (see `upsert_postings`); None if it has been stored before."""
        if any(n >= number for n in self.batches()):
            return None
        incoming = cut(with_application(incoming).drop("apply_usable", "explicit"), "incoming")
        matched, observed = self.match(with_application(incoming))
        near = matched.select("job_id").union(observed).union(incoming.select(F.col("id").alias("job_id"))).distinct()
        places = [r["b"] for r in near.select(self._of("job_id").alias("b")).distinct().collect()]
        jobs, observations = self.read("jobs", places), self.read("observations", places)
        done = upsert_postings(jobs, observations, incoming, priorities, matched)
        new_jobs, new_observations = cut(done.jobs, "jobs"), cut(done.observations, "observations")
        actions = cut(done.actions, "actions")

        changed = cut(actions.select("job_id").union(observed).distinct(), "changed")
        touched = [r["b"] for r in changed.select(self._of("job_id").alias("b")).distinct().collect()]
        of = lambda rows, key: rows.join(changed.select(F.col("job_id").alias(key)), key, "left_semi")
        before = stored_keys(of(jobs, "id"), of(observations, "job_id")).distinct()
        after = stored_keys(of(new_jobs, "id"), of(new_observations, "job_id")).distinct()
        same = ["high", "low", "job_id"]
        gone, added = cut(before.join(after, same, "left_anti"), "keys-gone"), cut(after.join(before, same, "left_anti"), "keys-added")
        key_places = [r["b"] for r in gone.union(added).select(self.bucket("keys").alias("b")).distinct().collect()]
        keys = self.read("keys", key_places).join(gone, same, "left_anti").union(added)
        parts = {
            "jobs": (new_jobs.where(self.bucket("jobs").isin(touched)).select(*_names("jobs")), touched),
            "observations": (new_observations.where(self.bucket("observations").isin(touched)).select(*_names("observations")), touched),
            "keys": (keys, key_places),
        }
        self.commit(number, {n: p for n, p in parts.items() if p[1]})
        return Stored(self.read("jobs"), self.read("observations"), actions)


def _names(name: str) -> list[str]:
    return [c.split()[0] for c in FORMS[name].replace("\n", " ").split(",")]
