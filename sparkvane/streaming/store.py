"""A durable collection: an append-only operation log, immutable segments, a manifest
written last.

Every commit is one Parquet folder and a small JSON file with its sequence number and the
checksums of its files, which makes it durable. Manifests have a number each and are never
overwritten: the highest one holds, and what it no longer names goes only after it is
written, older manifests first. Recovery takes the longest run of sound commits after the
manifest's. Opening changes nothing; what a writer finds beyond that run it moves to
``quarantine``. A file is damaged if its length or checksum is another than noted; whatever
else goes wrong while reading is an error. The live records are those whose last operation
is an insert. One writer at a time; readers see the files that were there when they planned.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.functions.distance import Metric
from sparkvane.operators import ann, filtered, search
from sparkvane.plans.filters import Filter
from sparkvane.plans.planner import Plan, plan

#: Segments beyond which the two smallest are merged, records of a log beyond which it is sealed,
#: and the share of dead records beyond which all is compacted.
SEGMENTS, SEAL_ROWS, DEAD_SHARE = 8, 10_000, 0.3
#: Bytes of vectors that a file should hold.
FILE_BYTES = 256 << 20
_ROWS = "op string, id long, vector array<float>, metadata string, seq long"


class StoreError(ValueError):
    pass


class DuplicateId(StoreError):
    pass


class MissingId(StoreError):
    pass


class WrongDimension(StoreError):
    pass


def last_operations(log: DataFrame) -> DataFrame:
    """The live records of ``(seq, op, id, vector, metadata)`` rows: the last operation of each
    id by ``seq``, if it is an insert. Combined before it is shuffled."""
    rest = [c for c in log.columns if c != "id"]
    last = log.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("last"))
    return last.where("last.op = 'insert'").select("id", *[F.col(f"last.{c}").alias(c) for c in rest if c != "op"])


class SyncPolicy:
    """When a commit's note is flushed to the disk: ``per_op`` (each), ``group:<ms>`` (the first one
    after so many milliseconds) or ``none`` (left to the file system)."""

    def __init__(self, text: str):
        kind, _, ms = text.partition(":")
        if kind not in ("none", "per_op", "group") or (kind == "group") != ms.isdigit():
            raise StoreError(f"no such sync policy: {text}")
        self.label, self.kind, self.ms, self.last = text, kind, int(ms or 0), float("-inf")

    def due(self, now: float) -> bool:
        if self.kind == "none" or (self.kind == "group" and 1000 * (now - self.last) < self.ms):
            return False
        self.last = now
        return True


class Collection:
    def __init__(self, spark: SparkSession, path: str, dim: int, metric: Metric | str = Metric.L2, max_segments: int = SEGMENTS, seal_rows: int = SEAL_ROWS, sync: str = "per_op"):
        """Open the collection at ``path``; its first commit creates it. On reopening, the manifest's
        dimension and metric hold, whatever the caller passes."""
        self.spark, self.path, self.max_segments, self.seal_rows, self.sync = spark, path.rstrip("/"), max_segments, seal_rows, SyncPolicy(sync)
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fresh = {"generation": 0, "dim": dim, "metric": Metric(metric).value, "seq": 0, "segments": [], "index": None, "created": time.time(), "checkpointed": None}
        state = self._latest()
        if state is None and (self._names("segments") or any(_number(x) for x in self._names("log"))):
            raise StoreError("there are data but no manifest")
        self._created = state is not None
        self.manifest = state or fresh
        self.dim, self.metric = self.manifest["dim"], Metric(self.manifest["metric"])
        for s in self._named():
            if self._files(s["path"]) != {n: x[0] for n, x in s["files"].items()}:
                raise StoreError(f"{s['path']} is damaged")
        self.log: list[dict] = []
        self.replayed = self._recover()

    # files

    def _at(self, name: str):
        return self._Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(folder))) if self._fs.exists(self._at(folder)) else []

    def _latest(self) -> dict | None:
        """The sound manifest of the highest generation. One of a lower generation is there only
        while its files are too."""
        found, damage = [], None
        for name in self._names("") if self._fs.exists(self._Path(self.path)) else []:
            if name == "manifest.json" or (name.startswith("manifest-") and name.endswith(".json")):
                try:
                    found.append(self._read_json(name))
                except StoreError as e:
                    if name == "manifest.json":  # of the former layout: its generation can't be known
                        raise
                    damage = e
        if damage and not found:
            raise damage
        return max(found, key=lambda m: m["generation"], default=None)

    def _read_json(self, name: str) -> dict:
        try:
            stream = self._fs.open(self._at(name))
            try:
                raw = bytes(stream.readAllBytes())
            finally:
                stream.close()
        except Py4JJavaError as e:
            if "ChecksumException" in str(e):  # the file system's own checksum
                raise StoreError(f"{name} is damaged: {str(e)[:300]}") from e
            raise
        try:
            data = json.loads(raw)
            body = data["body"]
            if data["check"] != _check(body):
                raise ValueError("checksum")
        except (ValueError, KeyError, TypeError) as e:
            raise StoreError(f"{name} is damaged: {e}") from e
        return body

    def _write_json(self, name: str, body: dict, sync: bool = True) -> None:
        """A file of a new name, whole or not at all."""
        tmp = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._at(tmp))
        stream.write(bytearray(json.dumps({"check": _check(body), "body": body}).encode()))
        if sync:
            stream.hsync()
        stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(tmp), self._at(name)):
            raise StoreError(f"{name} can't be written")

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], _ROWS)
        return self.spark.read.schema(_ROWS).parquet(*[f"{self.path}/{n}" for n in names])

    def _write(self, rows: DataFrame, name: str) -> None:
        if self._fs.exists(self._at(name)):
            self._fs.delete(self._at(name), True)  # of a write that was never noted
        rows.select("op", F.col("id").cast("long"), F.col("vector").cast("array<float>"), "metadata", F.col("seq").cast("long")).write.option("maxRecordsPerFile", max(1, FILE_BYTES // (4 * self.dim + 64))).parquet(f"{self.path}/{name}")

    def _files(self, name: str) -> dict[str, int]:
        """Length by file."""
        if not self._fs.exists(self._at(name)):
            return {}
        return {x.getPath().getName(): x.getLen() for x in self._fs.listStatus(self._at(name)) if x.getPath().getName().endswith(".parquet")}

    def _sums(self, name: str) -> dict[str, list[int]]:
        """Length and checksum by file."""
        if not self._files(name):
            return {}
        got = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.path}/{name}")
        rows = got.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.crc32("content").alias("sum")).collect()  # a row a file
        return {r.name: [r.length, r.sum] for r in rows}

    def _sound(self, entry: dict) -> bool:
        if self._files(entry["path"]) != {n: x[0] for n, x in entry["files"].items()}:
            return False
        try:
            return self._sums(entry["path"]) == entry["files"]
        except Exception as e:  # noqa: BLE001 - only the file system's own checksum is proof of damage
            if "ChecksumException" in str(e):
                return False
            raise

    def _named(self) -> list[dict]:
        m = self.manifest
        return [*m["segments"], *([m["index"]] if m.get("index") else [])]

    def _recover(self) -> dict:
        """The longest run of sound commits; nothing is changed."""
        seq, reason = self.manifest["seq"], None
        names = set(self._names("log"))
        while True:
            name = f"{seq + 1:012d}"
            if f"{name}.json" not in names:
                reason = "gap" if any((_number(x) or 0) > seq + 1 for x in names if x.endswith(".json")) else None
                break
            try:
                entry = self._read_json(f"log/{name}.json")
            except StoreError as e:
                reason = f"commit {seq + 1}: {str(e)[:200]}"
                break
            if entry["seq"] != seq + 1 or not self._sound(entry):
                reason = f"commit {seq + 1}: checksum"
                break
            seq += 1
            self.log.append(entry)
        return {"applied": len(self.log), "truncated": reason}

    def _take_over(self) -> None:
        """Before a write: the first manifest is there, and nothing is beyond the last sound commit."""
        if not self._created:
            self._write_json(_manifest(0), self.manifest)
            self._created = True
        left = [x for x in self._names("log") if (_number(x) or 0) > self.seq]
        if left:
            place = f"quarantine/{uuid.uuid4().hex}"
            self._fs.mkdirs(self._at(place))
            for x in sorted(left, key=lambda x: not x.endswith(".json")):  # notes first
                if not self._fs.rename(self._at(f"log/{x}"), self._at(f"{place}/{x}")):
                    raise StoreError(f"log/{x} can't be moved")

    # reading

    @property
    def seq(self) -> int:
        return self.log[-1]["seq"] if self.log else self.manifest["seq"]

    def _paths(self) -> list[str]:
        return [s["path"] for s in [*self.manifest["segments"], *self.log]]

    def operations(self) -> DataFrame:
        return self._read(self._paths())

    def live(self) -> DataFrame:
        """``id``, ``vector``, ``metadata`` (VARIANT) of the live records."""
        return last_operations(self.operations()).select("id", "vector", F.try_parse_json("metadata").alias("metadata"))

    def count(self) -> int:
        return self.live().count()

    def get(self, id: int) -> DataFrame:
        return last_operations(self.operations().where(F.col("id") == id))

    def search(self, query, k: int = 10, where: Filter | str | dict | None = None, ef: int = ann.EF_SEARCH) -> DataFrame:
        """``(id, distance)`` of the ``k`` live records nearest to a query, among those that pass the
        filter, nearest first and ties by id.

        With a saved index and no filter, its candidates that no later operation touches and the
        exact nearest of later inserts are merged; if fewer than ``k`` remain, and in all other
        cases, the exact search answers.
        """
        if len(query) != self.dim:
            raise search.DimensionError(f"the query has {len(query)} dimensions, not {self.dim}")
        where = _filter(where)
        index = self.manifest.get("index")
        if where.must or k <= 0 or not index:
            return filtered.search(self.live(), query, k, where, self.metric)[0]
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "qid long, query array<double>")
        later = self.operations().where(F.col("seq") > index["seq"])
        near = ann.search_index(self.index(), one, 2 * k, self.metric, max(ef, 2 * k)).select("id", "distance")
        fresh = search.top_k(last_operations(later).select("id", "vector"), query, k, self.metric)
        kept = near.join(later.select("id").distinct(), "id", "left_anti").unionByName(fresh).orderBy("distance", "id").limit(k)
        rows = kept.collect()  # at most k
        if len(rows) < min(k, index["rows"]):
            return filtered.search(self.live(), query, k, where, self.metric)[0]
        return self.spark.createDataFrame(rows, kept.schema).orderBy("distance", "id")

    def search_batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``(qid, id, distance, rank)`` of all ``queries(qid, query)``, exact."""
        return search.knn_batch(self.live().select("id", "vector"), queries, k, self.metric)

    def explain_filter(self, where: Filter | str | dict | None = None, k: int = 10) -> Plan:
        """How :meth:`search` would run: the plan's arm, exact matches and their limit."""
        return plan(self.live(), _filter(where), k)

    def stats(self) -> DataFrame:
        m = self.manifest
        live, held = self.count(), self.operations().count()
        size = [sum(x[0] for e in es for x in e["files"].values()) for es in (m["segments"], self.log)]
        row = (live, len(m["segments"]), sum(e["rows"] for e in self.log), len(self.log), m["generation"], m["checkpointed"], self.path, self.metric.value, self.dim, self.replayed["applied"], self.replayed["truncated"], size[0], size[1], self.sync.label, 1 - live / held if held else 0.0, bool(m.get("index")))
        return self.spark.createDataFrame([row], "len long, segments int, buffer long, log_commits int, generation int, last_checkpoint_unix double, storage_dir string, metric string, dim int, replay_applied int, replay_truncated string, segment_bytes long, wal_bytes long, wal_policy string, tombstone_ratio double, indexed boolean")

    # writing

    def _commit(self, rows: DataFrame, check=None) -> int:
        """Rows are written, then checked as they are there, then noted, which makes them durable."""
        self._take_over()
        n = self.seq + 1
        name = f"log/{n:012d}"
        self._write(rows.withColumn("seq", F.lit(n)), name)
        written = self._read([name])
        if check:
            try:
                check(written)
            except StoreError:
                self._fs.delete(self._at(name), True)
                raise
        entry = {"seq": n, "path": name, "rows": written.count(), "files": self._sums(name)}
        self._write_json(f"{name}.json", entry, self.sync.due(time.monotonic()))
        self.log.append(entry)
        if sum(e["rows"] for e in self.log) >= self.seal_rows:
            self.checkpoint()
        return n

    def _live_among(self, ids: DataFrame) -> DataFrame:
        """Those of ``ids`` that are live; only files whose ids reach into their range are read."""
        low, high = ids.agg(F.min("id"), F.max("id")).first()
        if low is None:
            return ids.limit(0)
        ops = self.operations().where(F.col("id").between(low, high)).join(ids.select("id").distinct(), "id", "left_semi")
        return last_operations(ops).select("id")

    def insert(self, rows: DataFrame) -> int:
        """``id``, ``vector`` and, if there is one, ``metadata`` (JSON of a flat object). All rows or none."""
        rows = rows.select("id", "vector", (F.col("metadata") if "metadata" in rows.columns else F.lit(None)).cast("string").alias("metadata"))

        def check(written: DataFrame) -> None:
            bad = written.agg(F.count_if(F.col("id").isNull() | (F.col("id") < 0)).alias("ids"), F.count_if(F.col("vector").isNull() | (F.size("vector") != self.dim) | F.exists("vector", lambda x: x.isNull())).alias("dims"), (F.count("id") - F.count_distinct("id")).alias("twice")).first()
            if bad["ids"]:
                raise StoreError("ids are integers from 0 to 2**63 - 1")
            if bad["dims"]:
                raise WrongDimension(f"vectors have {self.dim} dimensions")
            if bad["twice"] or not self._live_among(written.select("id")).isEmpty():
                raise DuplicateId("an id is live already, or twice in the batch")

        return self._commit(rows.withColumn("op", F.lit("insert")), check)

    def delete(self, ids: DataFrame) -> int:
        ids = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct()

        def check(written: DataFrame) -> None:
            if self._live_among(written.select("id")).count() < written.count():
                raise MissingId("an id is not live")

        return self._commit(ids.select("id", F.lit(None).alias("vector"), F.lit(None).cast("string").alias("metadata"), F.lit("delete").alias("op")), check)

    def _publish(self, **changes) -> int:
        """A manifest of the next generation, then what it doesn't name goes."""
        generation = self.manifest["generation"] + 1
        manifest = self.manifest | {"generation": generation} | changes
        self._take_over()
        self._write_json(_manifest(generation), manifest)
        self.manifest = manifest
        self.log = [e for e in self.log if e["seq"] > manifest["seq"]]
        self.collect_garbage()
        return generation

    def checkpoint(self) -> int:
        """The log becomes a segment, small segments are merged, and all is compacted if too many
        records are dead."""
        generation, segments, seq = self.manifest["generation"] + 1, list(self.manifest["segments"]), self.seq
        if self.log:
            segments.append(self._segment(_newest(self._read([e["path"] for e in self.log])), f"segments/{generation:08d}-new"))
        if len(segments) > self.max_segments:
            small = sorted(segments, key=lambda s: s["rows"])[:2]
            merged = _newest(self._read([s["path"] for s in small]))
            segments = [*(s for s in segments if s not in small), self._segment(merged, f"segments/{generation:08d}-merged")]
        held = sum(s["rows"] for s in segments)
        if held and 1 - self.count() / held >= DEAD_SHARE:
            segments = [self._segment(self._all(), f"segments/{generation:08d}-all")]
        return self._publish(seq=seq, segments=segments, checkpointed=time.time())

    def _all(self) -> DataFrame:
        return last_operations(self.operations()).withColumn("op", F.lit("insert"))

    def _segment(self, rows: DataFrame, name: str) -> dict:
        self._write(rows, name)
        return {"path": name, "rows": self._read([name]).count(), "files": self._sums(name)}

    def compact(self) -> int:
        """All live records become one segment."""
        seq = self.seq
        segment = self._segment(self._all(), f"segments/{self.manifest['generation'] + 1:08d}-all")
        return self._publish(seq=seq, segments=[segment], checkpointed=time.time())

    def build_index(self, segment_rows: int = ann.SEGMENT_ROWS) -> int:
        """Save a graph index of the live records; later operations are searched beside it."""
        name = f"segments/{self.manifest['generation'] + 1:08d}-index"
        if self._fs.exists(self._at(name)):
            self._fs.delete(self._at(name), True)
        rows = self.live().select("id", "vector")
        ann.build_index(rows, self.metric, segment_rows=segment_rows).write.option("maxRecordsPerFile", 8).parquet(f"{self.path}/{name}")
        return self._publish(index={"path": name, "rows": rows.count(), "seq": self.seq, "files": self._sums(name)})

    def index(self) -> DataFrame:
        """The saved index, as :func:`ann.search_index` takes it."""
        if not self.manifest.get("index"):
            raise StoreError("there is no index")
        return self.spark.read.parquet(f"{self.path}/{self.manifest['index']['path']}")

    def verify(self) -> None:
        """Checks all bytes of segments and index; opening checks names and lengths."""
        for s in self._named():
            if not self._sound(s):
                raise StoreError(f"{s['path']} is damaged")

    def collect_garbage(self) -> None:
        """Own files that the manifest doesn't name go, older manifests first; foreign files stay."""
        for x in self._names(""):
            if x.startswith("manifest") and x.endswith(".json") and x != _manifest(self.manifest["generation"]):
                self._fs.delete(self._at(x), False)
        keep = {s["path"].split("/")[1] for s in self._named()}
        for x in self._names("segments"):
            if x[:8].isdigit() and x not in keep:
                self._fs.delete(self._at(f"segments/{x}"), True)
        for x in self._names("log"):
            if (_number(x) or self.manifest["seq"] + 1) <= self.manifest["seq"]:
                self._fs.delete(self._at(f"log/{x}"), True)


def _manifest(generation: int) -> str:
    return f"manifest-{generation:08d}.json"


def _number(name: str) -> int | None:
    """The commit that a file of the log belongs to."""
    return int(name[:12]) if name[:12].isdigit() else None


def _newest(ops: DataFrame) -> DataFrame:
    """The last operation of each id, deletes too."""
    return ops.groupBy("id").agg(F.max_by(F.struct("op", "vector", "metadata", "seq"), "seq").alias("x")).select("x.op", "id", "x.vector", "x.metadata", "x.seq")


def _filter(where: Filter | str | dict | None) -> Filter:
    return where if isinstance(where, Filter) else Filter.from_json(where) if where else Filter()


def _check(body: dict) -> int:
    import zlib

    return zlib.crc32(json.dumps(body, sort_keys=True).encode())


def ingest(stream: DataFrame, collection: Collection, checkpoint_dir: str):
    """Apply a stream of ``(seq, op, id, vector, metadata)`` operations, a commit a micro-batch.

    Operations of a batch on one id count by the last ``seq``; inserts of live ids replace them, deletes of
    missing ids do nothing, so a batch that is retried after a failure changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            last = batch.groupBy("id").agg(F.max_by(F.struct("op", "vector", "metadata"), "seq").alias("x"))
            collection._commit(last.select("x.op", "id", "x.vector", "x.metadata"))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
