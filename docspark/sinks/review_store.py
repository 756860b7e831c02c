"""Stored records under review, with versions: a state in buckets, a log of changes, commits that exclude each other.

A store is a folder::

    commits/00000003.json   what the third commit made of the store
    log/<writer>-<batch>-*  what became of each request of one batch
    state/<folder>/bucket=7 whole records, as they were when their bucket was last compacted

Each record has a version, 0 when it is stored first and one more with each
change. A batch of requests is held against the state as it is; a request may
carry the version that its sender saw and is refused (409) if the record has
another one. The batch is written to the log in full, then committed by a file
whose name is the next number. Where another writer was first, that file is
there already: the batch is decided again, against what the other one left, so
of two requests on one record only one goes through. A writer numbers its
batches; one that was committed before changes nothing and gives its old
answers, so a stream may hand a batch in again after a failure.

Reading merges: records of the buckets take the newest change of their id in
the log, which is small between two compactions (Spark broadcasts it only if its
size allows, else joins by id). ``compact`` writes the buckets again that the
log touches, and no other; old files stay for readers of older commits until
``vacuum``.

Defined results: a null id, action or version in a request is no such record
(404), a refusal for want of a known action (400), and no check of the version;
of several requests on one id in a batch the first by ``req`` that may go
through does; an empty batch is a commit without changes; null ids in the state
and repeated ids are refused (ValueError) when the store is made.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.operators import review
from docspark.sinks import shared

CHANGED = ["review_status", "reviewed_by", "reviewed_at", "decision_note"]
LOG = "req long, id long, status int, version long, review_status string, reviewed_by string, reviewed_at timestamp, decision_note string"
ATTEMPTS = 20


class Conflict(Exception):
    """Other writers came first, again and again."""


class ReviewStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- commits ----------------------------------------------------------------------------------

    def _number(self) -> int:
        done = [n for n in shared.names(self.spark, f"{self.path}/commits") if n.endswith(".json")]
        if not done:
            raise ValueError(f"no store at {self.path}")
        return int(done[-1].split(".")[0])

    def _file(self, number: int) -> str:
        return f"{self.path}/commits/{number:08d}.json"

    def _snapshot(self, number: int | None = None) -> dict:
        number = self._number() if number is None else number
        return json.loads(shared.read_text(self.spark, self._file(number))) | {"number": number}

    def _commit(self, snapshot: dict) -> bool:
        body = {k: v for k, v in snapshot.items() if k != "number"}
        return shared.put_new(self.spark, self._file(snapshot["number"]), json.dumps(body))

    # --- state ------------------------------------------------------------------------------------

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col("id")), F.lit(buckets)).cast("int")

    def _written(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        """Rows by bucket, sorted by id within it; the folder that holds each bucket that has rows."""
        name = uuid.uuid4().hex
        placed = rows.withColumn("bucket", self._bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket", "id")
        placed.write.partitionBy("bucket").parquet(f"{self.path}/state/{name}")
        return {n.removeprefix("bucket="): name for n in shared.names(self.spark, f"{self.path}/state/{name}") if n.startswith("bucket=")}

    def create(self, rows: DataFrame, buckets: int = 16) -> ReviewStore:
        """The store's first commit: ``rows`` (id and whatever else a record has), all of version 0."""
        rows = rows.withColumns({c: F.lit(None).cast(T._parse_datatype_string(LOG)[c].dataType) for c in CHANGED if c not in rows.columns})
        rows = rows.withColumn("id", F.col("id").cast("long")).withColumn("version", F.lit(0).cast("long"))
        first = {"number": 0, "schema": rows.schema.json(), "buckets": buckets, "places": self._written(rows, buckets), "log": [], "writers": {}, "batch": None}
        odd = self._state(first).groupBy("id").count().where("id IS NULL OR count > 1").limit(1).collect()
        if odd:
            raise ValueError(f"ids must be there and differ: {odd[0]['id']}")
        if not self._commit(first):
            raise Conflict(f"there is a store at {self.path}")
        return self

    def _state(self, at: dict, only: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(at["schema"]))
        wanted = at["places"] if only is None else [str(b) for b in only]
        paths = [f"{self.path}/state/{at['places'][b]}/bucket={b}" for b in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _log(self, at: dict) -> DataFrame:
        paths = [f"{self.path}/log/{name}" for name in at["log"]]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def _merged(self, at: dict, only: list[int] | None = None) -> DataFrame:
        state = self._state(at, only)
        if not at["log"]:
            return state
        newest = self._log(at).where("status = 200").groupBy("id").agg(F.max_by(F.struct("version", *CHANGED), "version").alias("__new"))
        joined = state.join(newest, "id", "left")
        take = lambda c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)
        return joined.select(*[take(c) if c in ("version", *CHANGED) else F.col(c) for c in state.columns])

    def read(self, number: int | None = None) -> DataFrame:
        """All records as they are, or as they were after a commit."""
        return self._merged(self._snapshot(number))

    def of(self, ids: DataFrame) -> DataFrame:
        """The records of some ids (id), from the buckets that may hold them."""
        at = self._snapshot()
        buckets = sorted(r["b"] for r in ids.select(self._bucket(at["buckets"]).alias("b")).distinct().collect())  # a number for each bucket at most
        return self._merged(at, [b for b in buckets if str(b) in at["places"]]).join(ids.select("id"), "id", "left_semi")

    def files(self) -> dict[int, list[str]]:
        """The state's files of each bucket."""
        at = self._snapshot()
        folders = {int(b): f"{self.path}/state/{name}/bucket={b}" for b, name in at["places"].items()}
        return {b: [f"{f}/{n}" for n in shared.names(self.spark, f)] for b, f in folders.items()}

    # --- changes ----------------------------------------------------------------------------------

    def apply(self, requests: DataFrame, writer: str, batch: int, reviewer: str = "admin", now: Column | None = None) -> DataFrame:
        """What became of each request (req, id, action, decision_note and, if there, version) of the writer's batch."""
        for _ in range(ATTEMPTS):
            at = self._snapshot()
            if at["writers"].get(writer, -1) >= batch:
                return self._answered(at, writer, batch)
            name = f"{writer}-{batch}-{uuid.uuid4().hex}"
            self._decided(at, requests, reviewer, now).write.parquet(f"{self.path}/log/{name}")
            new = at | {"number": at["number"] + 1, "log": [*at["log"], name], "writers": at["writers"] | {writer: batch}, "batch": [writer, batch, name]}
            if self._commit(new):
                return self.spark.read.schema(LOG).parquet(f"{self.path}/log/{name}")
            shared.remove(self.spark, f"{self.path}/log/{name}")
        raise Conflict(f"{writer} {batch}")

    def _decided(self, at: dict, requests: DataFrame, reviewer: str, now: Column | None) -> DataFrame:
        known = self._merged(at).select("id", "review_status", F.col("version").alias("now"))
        carried = F.col("version").cast("long") if "version" in requests.columns else F.lit(None).cast("long")
        asked = requests.select("req", F.col("id").cast("long").alias("id"), "action", "decision_note", carried.alias("seen"))
        held = asked.join(known, "id", "left")
        # a request with another version than the record's decides nothing, so it is put aside before the others are looked at
        stale = F.coalesce(F.col("seen") != F.col("now"), F.lit(False))
        marked = held.withColumn("review_status", F.when(stale & F.col("review_status").isNotNull(), "stale").otherwise(F.col("review_status")))
        done = review.decided(marked, reviewer, now)
        return done.select(F.col("req").cast("long").alias("req"), "id", F.col("status").cast("int").alias("status"), F.when(F.col("status") == 200, F.col("now") + 1).alias("version"), *CHANGED)

    def _answered(self, at: dict, writer: str, batch: int) -> DataFrame:
        """The answers of a batch that was committed before."""
        for number in range(at["number"], -1, -1):
            said = self._snapshot(number)["batch"]
            if said and said[:2] == [writer, batch]:
                return self.spark.read.schema(LOG).parquet(f"{self.path}/log/{said[2]}")
        raise ValueError(f"{writer} has handed in later batches than {batch}, but not this one")

    def compact(self) -> list[int]:
        """Writes the buckets that the log touches again, with its changes; their numbers."""
        for _ in range(ATTEMPTS):
            at = self._snapshot()
            rows = self._log(at).where("status = 200").select(self._bucket(at["buckets"]).alias("b")).distinct().collect()  # a number for each bucket at most
            touched = sorted(r["b"] for r in rows)
            if not at["log"]:
                return []
            places = self._written(self._merged(at, touched), at["buckets"]) if touched else {}
            if self._commit(at | {"number": at["number"] + 1, "log": [], "places": at["places"] | places, "batch": None}):
                return touched
            for name in set(places.values()):
                shared.remove(self.spark, f"{self.path}/state/{name}")
        raise Conflict("compaction")

    def vacuum(self) -> list[str]:
        """Removes folders of records that the newest commit does not use; older commits cannot be read then."""
        used = set(self._snapshot()["places"].values())
        gone = [n for n in shared.names(self.spark, f"{self.path}/state") if n not in used]
        for n in gone:
            shared.remove(self.spark, f"{self.path}/state/{n}")
        return gone
