"""State tables as parquet folders: one partition per run, and segments of many runs.

A run writes only its own partition of each table and reads only earlier runs of the
tables it writes, so repeating a run after a failure replaces what the first attempt left.
Known rows are never rewritten: `url` and `content` grow by new keys, `dupe` and `liked` by
superseding rows that :meth:`StateStore.current` resolves. `open` holds the urls that wait
after a run, so that the next one need not look at more. A table comes into being with its
first run.

:meth:`StateStore.compact` folds runs that can't be repeated any more into segments, and
segments into larger ones, as many as have come together each time. Which segments count,
and up to which run, is said by the newest file in `manifest`, which is written whole or not
at all; so a reader sees the state before or after, and what a failed attempt left is not
seen. Folders that a version of the manifest has replaced are deleted with the next one.

Beside the partitions, `bounds` holds a name for each table and run that says how many rows
it has and from when to when, and `claims` whose run it is.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom import schemas
from adloom.operators.backlog import timestamp
from adloom.operators.counted import write_counted
from adloom.operators.dedup import keep_one, recent_signatures
from adloom.operators.skew import without_known
from adloom.plans.files import Files

TABLES = {
    "url": T.StructType(schemas.URL.fields[:2]),
    # Urls found by browsing, urls taken up for collecting, and urls still waiting, per run.
    "found": schemas.VISITED,
    "backlog": T.StructType(schemas.URL.fields[:2]),
    "open": T.StructType(schemas.URL.fields[:2]),
    "visited": schemas.VISITED,
    "content": schemas.CONTENT,
    "dupe": schemas.DUPE,
    "liked": schemas.LIKED,
    # Signatures that a stream without a queue has let through.
    "seen": T.StructType(schemas.DUPE.fields[:1]),
    # Who ran a run, and at what time.
    "claims": schemas.CLAIMS,
}
#: Rows that a stream without a queue has let through, in the caller's columns.
KEPT = "kept"
#: Tables in which a later row replaces earlier ones of the same key.
SUPERSEDING = {"dupe": ["sig"], "liked": ["rule_set", "content_hash"]}
RUN = T.StructField("run", T.LongType())
#: What tells a batch of a stream from the stream, which may repeat its runs.
_BATCH = " batch [^ ]*$"
#: Segments of one level that are folded into one of the next.
FAN = 8
_EPOCH = datetime(1970, 1, 1)
_MICRO = timedelta(microseconds=1)


@dataclass(frozen=True)
class Run:
    """One execution of the modes: ids rise from 1, ``as_of`` stamps its rows.

    Later runs must not have an earlier ``as_of``. A run that failed half-way is to be
    repeated under its id before the next one starts. ``owner`` tells runs of different
    programs apart, see :meth:`StateStore.claim`.
    """

    id: int
    as_of: datetime
    owner: str = "batch"

    def __post_init__(self) -> None:
        if self.id < 1:
            raise ValueError("run ids start at 1")


@dataclass(frozen=True)
class Segment:
    """Consecutive runs in one folder for each table that has rows of them."""

    first: int
    last: int
    level: int
    #: Programs and streams that the runs belong to.
    writers: list[str] = field(default_factory=list)
    #: Per table the folder's name, and what :class:`Bounds` says of it.
    folders: dict[str, list] = field(default_factory=dict)


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    segments: tuple[Segment, ...] = ()
    #: Folders that this version has replaced, below the store's.
    replaced: tuple[str, ...] = ()

    @property
    def upto(self) -> int:
        """The last run that lies in a segment."""
        return self.segments[-1].last if self.segments else 0


@dataclass(frozen=True)
class Bounds:
    """Rows of a folder, and the least and largest microsecond of their ``ts``, if any."""

    rows: int
    first: int | None = None
    last: int | None = None

    def may_hold(self, since: datetime | None) -> bool:
        if since is None or not self.rows:
            return self.rows > 0
        return self.last is not None and self.last >= micros(since)

    @staticmethod
    def of(name: str) -> tuple[int, Bounds]:
        run, rows, first, last = name.split("_")
        return int(run), Bounds(int(rows), *(int(x) if x else None for x in (first, last)))

    def name(self, run: int) -> str:
        times = ("" if x is None else str(x) for x in (self.first, self.last))
        return "_".join([str(run), str(self.rows), *times])


def micros(at: datetime) -> int:
    return (at - _EPOCH) // _MICRO


def writer_of(owner: str) -> str:
    """Who may repeat a run: its owner, or the stream that the batch belongs to."""
    return re.sub(_BATCH, "", owner)


def writer() -> Column:
    """The same for the column ``owner``."""
    return F.regexp_replace("owner", _BATCH, "").alias("writer")


class StateStore:
    """State tables below one folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark)
        self._claimed: set[Run] = set()

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def manifest(self) -> Manifest:
        """What is folded so far."""
        versions = [int(name) for name in self.files.names(self.path("manifest"))]
        if not versions:
            return Manifest()
        told = json.loads(self.files.read(f"{self.path('manifest')}/{max(versions)}"))
        segments = tuple(Segment(**segment) for segment in told["segments"])
        return Manifest(max(versions), segments, tuple(told["replaced"]))

    def bounds(self, table: str) -> dict[int, Bounds]:
        """By run, what its partition holds; a run that is not named may hold anything."""
        return dict(map(Bounds.of, self.files.names(f"{self.path('bounds')}/{table}")))

    def _runs(self, table: str) -> list[int]:
        """Runs that have a partition, folded or not."""
        names = (n for n in self.files.names(self.path(table)) if n.startswith("run="))
        return sorted(int(name.removeprefix("run=")) for name in names)

    def log(
        self,
        table: str,
        before: int | None = None,
        upto: int | None = None,
        since: datetime | None = None,
        after: int = 0,
    ) -> DataFrame:
        """Rows with their ``run``, of the runs within the bounds.

        Only folders that may hold such rows are read. ``since`` leaves out folders whose
        rows are all earlier; what is read may still hold some that are.
        """
        manifest = self.manifest()
        most = min(x for x in (before and before - 1, upto, 1 << 62) if x is not None)
        known = self.bounds(table)
        segments = [
            f"{self.path(table)}/{name}"
            for s in manifest.segments
            if s.first <= most and s.last > after
            for name, *told in [s.folders.get(table, [None, 0])]
            if Bounds(*told).may_hold(since)
        ]
        loose = [
            f"{self.path(table)}/run={run}"
            for run in self._runs(table)
            if max(after, manifest.upto) < run <= most and known.get(run, Bounds(1, 0, 1 << 62)).may_hold(since)
        ]
        rows = self._read(table, segments, loose)
        if segments:
            rows = rows.filter(F.col("run").between(after + 1, most))
        return rows

    def of_others(self, table: str, run: Run) -> DataFrame | None:
        """Rows of earlier runs that don't belong to the run's writer, or None without any.

        Where the writer is alone, no row is read.
        """
        manifest, own = self.manifest(), writer_of(run.owner)
        claims = self.log("claims", before=run.id)
        recent = claims.filter((F.col("run") > manifest.upto) & (writer() != own))
        others = {row.run for row in recent.select("run").collect()}
        loose = [f"{self.path(table)}/run={n}" for n in self._runs(table) if n in others]
        shared = [s for s in manifest.segments if table in s.folders and s.writers != [own]]
        folders = [f"{self.path(table)}/{s.folders[table][0]}" for s in shared]
        if not loose and not folders:
            return None
        rows = self._read(table, folders, loose)
        if any(own in s.writers for s in shared):
            mine = claims.filter(writer() == own).select("run")
            rows = rows.join(mine, "run", "left_anti")
        return rows.drop("run")

    def _read(self, table: str, segments: Sequence[str], loose: Sequence[str]) -> DataFrame:
        reader = self.spark.read.option("basePath", self.path(table))
        if table == KEPT:  # its columns are the caller's
            plain = reader.option("mergeSchema", "true").parquet
            frames = [plain(*paths) for paths in (segments, loose) if paths]
            rows = frames[0] if frames else self.spark.range(0).select(F.lit(0).alias("run"))
            for more in frames[1:]:
                rows = rows.unionByName(more, allowMissingColumns=True)
            return rows.withColumn("run", F.col("run").cast("long"))
        schema = T.StructType([*TABLES[table].fields, RUN])
        frames = []
        if segments:
            frames.append(self.spark.read.schema(schema).parquet(*segments))
        if loose and table == "claims":
            frames.append(reader.schema(schema).json(list(loose)))
        elif loose:
            frames.append(reader.schema(schema).parquet(*loose))
        if not frames:
            nothing = (F.lit(None).cast(f.dataType).alias(f.name) for f in schema)
            return self.spark.range(0).select(*nothing)
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

    def write(self, table: str, rows: DataFrame, run: int) -> DataFrame:
        """Replace the run's partition, and return it as read back from its own folder."""
        return self.write_told(table, rows, run)[0]

    def write_told(
        self, table: str, rows: DataFrame, run: int, **told: Column
    ) -> tuple[DataFrame, dict]:
        """The same, and what :func:`write_counted` tells of the rows."""
        names = rows.columns if table == KEPT else TABLES[table].names
        target = f"{self.path(table)}/run={run}"
        folder = f"{self.path('bounds')}/{table}"
        # Without a name in this folder the partition is always read.
        for name in self.files.names(folder):
            if name.split("_")[0] == str(run):
                self.files.delete(f"{folder}/{name}")
        bounds, told = written(rows, target, names, **told)
        self.files.mark(f"{folder}/{bounds.name(run)}")
        return self.spark.read.schema(rows.select(*names).schema).parquet(target), told

    def claim(self, run: Run) -> Run:
        """Note down who a run belongs to before anything is written.

        A run of another owner is never overwritten, and time never runs backwards. Of
        several programs that claim a run at once one succeeds; programs that may do so
        need different owners, for a run of the same owner counts as repeated.
        """
        if run in self._claimed:
            return run
        if run.id <= self.manifest().upto:
            raise ValueError(f"run {run.id} is folded and can't be repeated")
        path = f"{self.path('claims')}/run={run.id}/claim.json"
        told = json.dumps({"owner": run.owner, "as_of": run.as_of.isoformat(sep=" ")})
        earlier, later, foreign = self.log("claims").agg(
            F.max(F.when(F.col("run") < run.id, F.col("as_of"))),
            F.min(F.when(F.col("run") > run.id, F.col("as_of"))),
            F.max(F.when((F.col("run") == run.id) & (F.col("owner") != run.owner), F.col("owner"))),
        ).first()
        if foreign is None and ((earlier and run.as_of < earlier) or (later and run.as_of > later)):
            raise ValueError(f"the time of run {run.id} does not lie between its neighbours'")
        if foreign is None and not self.files.put(path, told):
            held = json.loads(self.files.read(path))
            foreign = held["owner"] if held["owner"] != run.owner else None
            if foreign is None and held["as_of"] != run.as_of.isoformat(sep=" "):
                self.files.put(path, told, replace=True)
        if foreign is not None:
            raise ValueError(f"run {run.id} belongs to {foreign}")
        self._claimed.add(run)
        return run

    def run_of(self, owner: str, as_of: datetime) -> Run:
        """The run that an owner has claimed before, or the next free one."""
        while True:
            mine, at, last, latest = self.log("claims").agg(
                F.max(F.when(F.col("owner") == owner, F.col("run"))),
                F.max(F.when(F.col("owner") == owner, F.col("as_of"))),
                F.max("run"),
                F.max("as_of"),
            ).first()
            if mine is not None:
                return self.claim(Run(mine, at, owner))
            try:
                return self.claim(Run((last or 0) + 1, max(as_of, latest or as_of), owner))
            except ValueError:
                # Another program was faster; it has moved the next free run on.
                if self.log("claims").agg(F.max("run")).first()[0] == last:
                    raise

    def current(
        self, table: str, upto: int | None = None, since: datetime | None = None
    ) -> DataFrame:
        """The table as it stands after a run, or its rows later than ``since``.

        Superseding rows are never earlier, so older ones need not be read for that.
        """
        rows = self.log(table, upto=upto, since=since)
        if since is not None:
            rows = rows.filter(F.col("ts") > timestamp(since))
        if table == "url":
            visited = self.log("visited", upto=upto).select("url").distinct()
            return rows.drop("run").join(
                visited.withColumn("visited", F.lit(1)), "url", "left"
            ).fillna(0, ["visited"])
        if table in SUPERSEDING:
            return newest(table, rows).drop("run")
        return rows.drop("run")

    def waiting(self, run: int) -> DataFrame:
        """Urls that wait for a run: those left by the last run that left a queue, and those
        found since, without those that other runs have closed or stored meanwhile.

        Only the last queue and what came after it are read. New urls are looked for in the
        whole content, which may have come by another way.
        """
        last = max((n for n in self._runs("open") if n < run), default=0)
        fresh = self.log("url", upto=run, after=last).drop("run")
        fresh = without_known(fresh, self.log("content", before=run), "url")
        queue = self._read("open", [], [f"{self.path('open')}/run={last}"] if last else [])
        queue = queue.drop("run")
        if last + 1 < run:
            stored = self.log("content", before=run, after=last).select("url")
            closed = self.log("visited", before=run, after=last).select("url")
            queue = queue.join(stored.unionByName(closed), "url", "left_anti")
            fresh = fresh.join(closed, "url", "left_anti")
        return queue.unionByName(fresh)

    def snapshot(self, before: int, limit: int | None = None) -> DataFrame:
        """Signatures known before a run, or the newest of them."""
        return recent_signatures(self.current("dupe", upto=before - 1), limit)

    def register_views(self, prefix: str = "", upto: int | None = None) -> None:
        """Temporary views over the current tables, for reports in SQL."""
        for table in ("url", "content", "dupe", "liked"):
            self.current(table, upto).createOrReplaceTempView(prefix + table)

    def horizon(self, gone: Sequence[str] = ()) -> int:
        """The last run that no writer can repeat: all before the last run of each.

        ``gone`` names writers that will not come back, as in the table ``claims``; a
        stream is named without its batch.
        """
        claims = self.log("claims")
        last = claims.filter(~writer().isin(*gone)) if gone else claims
        last = last.groupBy(writer()).agg(F.max("run").alias("run")).agg(F.min("run")).first()[0]
        newest_run = claims.agg(F.max("run")).first()[0]
        return (newest_run or 0) if last is None else last - 1

    def compact(self, gone: Sequence[str] = ()) -> int:
        """Fold what can't be repeated any more, in place; returns the last run folded.

        Nothing that a reader, a repeated run or a stream needs is lost. Of two programs that
        compact at once one fails, and the state is as the other has left it.
        """
        old, upto = self.manifest(), self.horizon(gone)
        if upto <= old.upto:
            return old.upto
        made, merged = self._folded(old, upto, self)
        loose = [
            f"{table}/run={run}"
            for table in (*TABLES, KEPT)
            if table != "open"
            for run in self._runs(table)
            if old.upto < run <= upto
        ]
        # Of the queues the last one stays as it is; it has replaced the others.
        loose += [f"open/run={run}" for run in [r for r in self._runs("open") if r <= upto][:-1]]
        past = [
            f"bounds/{table}/{bounds.name(run)}"
            for table in (*TABLES, KEPT)
            for run, bounds in self.bounds(table).items()
            if run <= upto
        ]
        folders = [f"{table}/{told[0]}" for s in merged for table, told in s.folders.items()]
        kept = old.segments[: len(old.segments) - len(merged)]
        told = {
            "segments": [asdict(segment) for segment in (*kept, made)],
            "replaced": [*loose, *past, *folders],
        }
        folder = self.path("manifest")
        if not self.files.put(f"{folder}/{old.version + 1}", json.dumps(told)):
            raise RuntimeError("another program has compacted this state meanwhile")
        # Readers of the version before may still be at work, but not those before that.
        for name in old.replaced:
            self.files.delete(self.path(name))
        if old.version > 1:
            self.files.delete(f"{folder}/{old.version - 1}")
        return upto

    def _folded(self, old: Manifest, upto: int, target: StateStore) -> tuple[Segment, list[Segment]]:
        """A new segment up to a run, written below ``target``, and the segments in it."""
        merged: list[Segment] = []
        level = 0
        rest = list(old.segments)
        while len(rest) >= FAN - 1 and all(s.level == level for s in rest[1 - FAN :]):
            merged = [*rest[1 - FAN :], *merged]
            rest = rest[: 1 - FAN]
            level += 1
        after = rest[-1].last if rest else 0
        folders: dict[str, list] = {}
        for table in (*TABLES, KEPT):
            if table == "open":
                continue
            rows = self.log(table, upto=upto, after=after)
            if "run" not in rows.columns or len(rows.columns) == 1:
                continue
            if table in SUPERSEDING:
                rows = newest(table, rows)
            elif table == "visited":
                rows = rows.groupBy("url").agg(F.min("run").alias("run"))
            name = f"segment-{uuid.uuid4().hex}"
            bounds, _ = written(rows, f"{target.path(table)}/{name}")
            if bounds.rows:
                folders[table] = [name, bounds.rows, bounds.first, bounds.last]
            else:
                target.files.delete(f"{target.path(table)}/{name}")
        claims = self.log("claims", upto=upto, after=after).select(writer()).distinct()
        writers = sorted(row.writer for row in claims.collect())
        return Segment(after + 1, upto, level, writers, folders), merged

    def copy_to(self, root: str, run: int, gone: Sequence[str] = ()) -> StateStore:
        """A compacted copy of everything up to a run. Runs that a writer may repeat stay
        apart in it, so that it goes on like the original."""
        if run <= self.manifest().upto:
            raise ValueError(f"run {run} is folded; the state as it was then can't be told")
        target = StateStore(self.spark, root)
        upto = max(0, min(self.horizon(gone), run - 1))
        if upto:
            made, _ = self._folded(Manifest(), upto, target)
            told = {"segments": [asdict(made)], "replaced": []}
            target.files.put(f"{target.path('manifest')}/1", json.dumps(told))
        for table in (*TABLES, KEPT):
            apart = [r for r in self._runs(table) if upto < r <= run]
            if table == "open":
                apart = [r for r in self._runs(table) if r <= upto][-1:] + apart
            for one in apart:
                if table == "claims":
                    name = f"claims/run={one}/claim.json"
                    target.files.put(target.path(name), self.files.read(self.path(name)))
                else:
                    rows = self._read(table, [], [f"{self.path(table)}/run={one}"])
                    target.write(table, rows.drop("run"), one)
        return target


def newest(table: str, rows: DataFrame) -> DataFrame:
    """Of rows with the same key the one of the last run."""
    return keep_one(rows, SUPERSEDING[table], ["run"], last=True)


def written(
    rows: DataFrame, target: str, names: Sequence[str] | None = None, **told: Column
) -> tuple[Bounds, dict]:
    """Write a folder anew; rows, times and what is asked for are counted on the way."""
    if dict(rows.dtypes).get("ts") == "timestamp_ntz":
        in_micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
        told |= {"first": F.min(in_micros), "last": F.max(in_micros)}
    seen = write_counted(rows, target, names, overwrite=True, **told)
    return Bounds(seen["rows"], seen.get("first"), seen.get("last")), seen
