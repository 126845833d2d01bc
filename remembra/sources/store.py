"""The store: rows by id, as segments of rows, of removed ids and of touches."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remembra.sources.log import Conflict, Log

#: Removed ids up to which they are broadcast, and segments from which a change ends in a compaction.
BROADCAST_IDS, MOST_SEGMENTS = 100_000, 64
#: The column that segments are partitioned by, so that a filter on it reads only its part.
PARTITION = "type"
#: Numbers that a segment says of itself, made from its rows.
Facts = Callable[[DataFrame], dict[str, int]]


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that the session has been given. Without either it raises, but for a session that is one
    process: that gets a folder of its own, which ends with it."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not path:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="remembra-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            sc.setCheckpointDir(path)
            return path
        sc.setCheckpointDir(path)
    return (path or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, records: int | None = None, **options) -> DataFrame:
    """df written as Parquet and read back, so that its lineage ends there. records: rows that go to Python at once, for rows of megabytes; options: of the writer."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    if records:
        conf.set(key, str(records))
    try:
        df.write.mode("overwrite").options(**options).parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Rows by id in a folder: a part of its log of versions, the only one or one of several (see log.Log).

    Segments hold rows, ids whose earlier rows are gone, or touches, which add to rows wherever these are. A change writes the rows it makes and the ids
    that it replaces or removes, never the rest. Readers go on with the version they have. Segments are folded by compact(), which a
    change calls when there are many; vacuum() deletes what the newest version does not name. ids are of any type, one for a store.
    defaults: values of columns that segments written before the column was there have not. unique: rows of one id say the same, so of two writers that add
    one the first does.
    """

    def __init__(self, spark: SparkSession, folder: str, defaults: Mapping[str, object] | None = None, log: Log | None = None, part: str = "", partition: str | None = PARTITION, unique: bool = False):
        self.spark, self.defaults, self.unique = spark, dict(defaults or {}), unique
        self.log, self.part, self.partition = log or Log(spark, folder), part, partition
        self.log.parts[part] = self
        self.folder, self._path, self._fs, self._numbers = self.log.folder, self.log.path, self.log.fs, self.log.numbers

    def _version(self) -> tuple[int, list[dict]]:
        number, state = self.log.version()
        return number, state["segments"]

    def _commit(self, before: int, segments: list[dict]) -> None:
        self.log.put(before, {"segments": segments})

    def _segment(self, df: DataFrame, kind: str, facts: Facts | None = None) -> dict:
        base = max((s["seq"] for s in self.log.segments(self.part)), default=0)
        made = self.log.segment(df, self.part, kind, self.partition if kind == "rows" else None)
        return made | {"base": base, "facts": facts(self.log.load(made)) if facts else {}}

    def _change(self, rows: DataFrame | None, gone: DataFrame | None, facts: Facts | None = None, gone_facts: Mapping[str, int] | None = None) -> None:
        with self.log.transaction():
            first = not self.log.segments(self.part)
            new = []
            if gone is not None:
                new.append(self._segment(gone, "gone") | {"facts": dict(gone_facts or {})})
            if rows is not None:
                new.append(self._segment(rows, "rows", facts))
            self.log.change([s for s in new if s["rows"] or first])

    def tidy(self) -> None:
        """Fold the segments if there are many; if another writer is at it, leave it to that one."""
        if len(self.log.segments(self.part)) > MOST_SEGMENTS:
            try:
                self.compact()
            except Conflict:
                pass

    # ---- reading ----

    def version(self) -> int:
        """The number of the newest whole version; -1 if there is none."""
        return self.log.version()[0]

    def exists(self) -> bool:
        return any(s["kind"] == "rows" for s in self.log.segments(self.part))

    def facts(self) -> dict[str, int]:
        """The sums of what segments say of themselves."""
        out: dict[str, int] = {}
        for s in self.log.segments(self.part):
            for k, v in s.get("facts", {}).items():
                out[k] = out.get(k, 0) + v
        return out

    def read(self) -> DataFrame:
        """The rows of the newest version; in a transaction, of the version that it started from with its own changes."""
        segments = self.log.segments(self.part)
        rows, gone, touches = ([s for s in segments if s["kind"] == k] for k in ("rows", "gone", "touch"))
        if not rows:
            raise ValueError(f"{self.folder}: nothing has been written")
        fields = {f.name: f for s in rows for f in T.StructType.fromJson(json.loads(s["schema"])).fields}

        def whole(s: dict) -> DataFrame:
            df = self.log.load(s)
            missing = [F.lit(self.defaults.get(n)).cast(f.dataType).alias(n) for n, f in fields.items() if n not in df.columns]
            return df.select("*", *missing).select(*fields, F.lit(s["seq"]).alias("__seq"), F.lit(s.get("base", s["seq"])).alias("__base"))

        def few(some: list[dict], by: DataFrame) -> DataFrame:
            return F.broadcast(by) if sum(s["rows"] for s in some) <= BROADCAST_IDS else by

        def later(some: list[dict], place: str) -> list[dict]:
            return [g for g in some if any(g["seq"] > s.get(place, s["seq"]) for s in rows)]

        out = reduce(DataFrame.unionByName, map(whole, rows))
        if gone := later(gone, "seq"):
            ids = reduce(DataFrame.union, (self.log.load(g).select("id", F.lit(g["seq"]).alias("__until")) for g in gone))
            ids = ids.groupBy("id").agg(F.max("__until").alias("__until"))
            out = out.join(few(gone, ids), "id", "left").filter("__until is null or __until < __seq")
        if touches := later(touches, "base"):
            # one for each id and segment, so a row's list is no longer than there are segments
            told = reduce(DataFrame.union, (self.log.load(t).select("id", F.struct(F.lit(t["seq"]).alias("seq"), F.col("accessed_at").alias("at"), F.col("accesses").alias("n")).alias("t")) for t in touches))
            out = out.join(few(touches, told.groupBy("id").agg(F.collect_list("t").alias("__told"))), "id", "left")
            own = F.filter("__told", lambda t: t["seq"] > F.col("__base"))
            at, n = F.array_max(F.transform(own, lambda t: t["at"])), F.aggregate(own, F.lit(0).cast("long"), lambda x, t: x + t["n"])
            out = out.withColumns({"accessed_at": F.greatest("accessed_at", at), "access_count": (F.col("access_count") + F.coalesce(n, F.lit(0).cast("long"))).cast(fields["access_count"].dataType)})
        return out.select(*fields)

    def get(self, id_: str, whole: int = 36) -> DataFrame:
        """The row with a whole id, or the first by id of those that start with it."""
        rows = self.read()
        if len(id_) >= whole:
            return rows.filter(F.col("id").cast("string") == id_)
        return rows.filter(F.col("id").cast("string").startswith(id_)).orderBy("id").limit(1)

    # ---- changes ----

    def write(self, rows: DataFrame, facts: Facts | None = None) -> None:
        """rows are all that there is from now on."""
        with self.log.transaction():
            old = [s["name"] for s in self.log.segments(self.part)]
            self.log.change([self._segment(rows, "rows", facts)], old, whole=True)

    def append(self, rows: DataFrame, facts: Facts | None = None) -> None:
        """facts: what a segment of these rows says of itself."""
        self._change(rows, None, facts)

    def replace(self, rows: DataFrame) -> None:
        """rows take the place of those with their ids."""
        made = stored(rows, f"{workspace(self.spark, 'replace')}/rows")  # read twice, and never differently
        self._change(made, made.select("id").distinct())

    def update(self, changes: DataFrame, also_nulls: Sequence[str] = ()) -> None:
        """Columns of changes (id, ...) replace those of the rows with their ids, where they are not null; those of also_nulls even if they are. Only these rows are written."""
        names = [c for c in changes.columns if c != "id"]
        new = changes.select("id", *(F.col(c).alias(f"__{c}") for c in names))
        with self.log.transaction():
            rows = self.read()
            value = lambda c: F.col(f"__{c}").cast(rows.schema[c].dataType) if c in also_nulls else F.coalesce(F.col(f"__{c}").cast(rows.schema[c].dataType), F.col(c))
            self.replace(rows.join(new, "id").select(*(value(c).alias(c) if c in names else F.col(c) for c in rows.columns)))

    def delete(self, ids: DataFrame, facts: Mapping[str, int] | None = None) -> None:
        self._change(None, ids.select("id").distinct(), gone_facts=facts)

    def delete_prefix(self, prefix: str) -> bool:
        """Delete the one row whose id starts so; False, and nothing changes, if there is none or more than one."""
        with self.log.transaction():
            found = self.read().filter(F.col("id").cast("string").startswith(prefix)).select("id").limit(2).collect()
            if len(found) == 1:
                self.delete(self.read().filter(F.col("id") == found[0].id))
        return len(found) == 1

    def fold(self, touches: DataFrame, batch: str | None = None) -> None:
        """Take in touches (id, accessed_at, accesses) of searches: the last access, and their number. No row is written: a segment of touches is, one for each id, which
        every reader adds and compact() folds; touches never meet other changes. batch: see Log."""
        by = touches.groupBy("id").agg(F.max("accessed_at").alias("accessed_at"), F.sum("accesses").cast("long").alias("accesses"))
        with self.log.transaction(batch) as now:
            if not now.done:
                self.log.change([s for s in [self._segment(by, "touch")] if s["rows"]])

    def compact(self) -> None:
        """One segment in place of all; what others add meanwhile stays beside it, and if others have folded the same segments it raises Conflict."""
        with self.log.transaction():
            segments = self.log.segments(self.part)
            if segments:
                top = max(s["seq"] for s in segments)
                made = self.log.segment(self.read(), self.part, "rows", self.partition)
                self.log.change([made | {"seq": top, "base": top, "facts": self.facts()}], [s["name"] for s in segments])

    def vacuum(self) -> None:
        """See Log.vacuum."""
        self.log.vacuum()

    def storage(self) -> dict[str, float]:
        """Megabytes of the folder: of the segments, of everything else (indexes and versions), and of both."""
        total, table = self.log.megabytes(), self.log.megabytes(self.part)
        return {"table_mb": round(table, 2), "index_mb": round(total - table, 2), "total_mb": round(total, 2)}
