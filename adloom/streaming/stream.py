"""Modes over streams of fetched pages: one micro-batch is one run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from adloom.functions import html as H
from adloom.functions.text import signature
from adloom.operators.classify import classify
from adloom.plans import modes
from adloom.plans.files import Files
from adloom.operators.skew import without_known
from adloom.plans.state import KEPT, Run, StateStore
from adloom.schemas import PAGES
from adloom.session import SETTINGS
from adloom.sources.rules import RuleSet


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def page_stream(
    spark: SparkSession,
    path: str,
    schema: StructType = PAGES,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Pages from a folder (or glob) of parquet files that keeps growing."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_of_batch(store: StateStore, batch: DataFrame, number: int, at: datetime) -> Run:
    """The run of a micro-batch: the one it had before, or the next free one.

    A stream is known by the id in its checkpoint, so a new checkpoint starts new runs.
    """
    context = batch.sparkSession.sparkContext
    stream = context.getLocalProperty("sql.streaming.queryId")
    return store.run_of(f"stream {stream} batch {number}", at)


def repeat_last_batch(spark: SparkSession, checkpoint: str) -> None:
    """Let a stream that has ended repeat its last micro-batch when it starts again, as it
    would if it had failed just before noting that the batch was done."""
    files = Files(spark)
    done = max(files.names(f"{checkpoint}/commits"), key=int)
    files.delete(f"{checkpoint}/commits/{done}")


def collect_stream(
    pages: DataFrame,
    store: StateStore,
    checkpoint: str,
    axes: Sequence[H.Selector] = H.AD_AXES,
    clock: Callable[[int], datetime] | None = None,
    snapshot: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Collect every micro-batch against the signatures known before it.

    A repeated batch has its old run and replaces its own rows; batch runs and other
    streams on the same store keep theirs.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        at = clock(number) if clock else now()
        run = run_of_batch(store, batch, number, at)
        modes.collect_pages(store, batch, run, axes, snapshot)

    return _started(pages, on_batch, checkpoint, available_now)


def _started(
    rows: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool,
    mode: str = "append",
) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.outputMode(mode)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def classify_stream(texts: DataFrame, *rule_sets: RuleSet, text: str = "content") -> DataFrame:
    """Verdicts on a stream; stateless, so it runs in append mode."""
    return classify(texts, *rule_sets, text=text)


def dedup_stream(
    texts: DataFrame,
    store: StateStore,
    checkpoint: str,
    order: Sequence[str] = ("ts", "url"),
    text: str = "content",
    clock: Callable[[int], datetime] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """First row per signature, across and within batches, however late rows come.

    The first row so far is the stream's keyed state, an aggregate kept in RocksDB and saved
    with the checkpoint. So a batch costs what it holds and not what came before, rows of a
    hot signature are combined in each task, nothing is forgotten, and no row is dropped for
    its time. What other streams on the store have let through before a run counts as known
    to it. Kept rows are in :func:`kept_rows`; of equal signatures in one batch the first by
    ``order`` stays.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        run = run_of_batch(store, batch, number, clock(number) if clock else now())
        # A signature that came in an earlier batch has its first row from there.
        new = batch.filter(F.col("_first._at") == F.col("_last")).select("_first._row.*")
        known = store.of_others("seen", run)
        if known is not None:
            new = without_known(new, known, "sig")
        kept = store.write(KEPT, new, run.id)
        store.write("seen", kept.select("sig"), run.id)

    # The time of a micro-batch is noted with its offsets, and the same if it is repeated.
    signed = texts.withColumn("sig", signature(F.col(text))).withColumn("_at", F.current_timestamp())
    row = F.struct(*(c for c in signed.columns if c != "_at")).alias("_row")
    first = F.min_by(F.struct("_at", row), F.struct("_at", *order))
    states = signed.groupBy("sig").agg(first.alias("_first"), F.max("_at").alias("_last"))
    conf, provider = store.spark.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(provider)
    conf.set(provider, SETTINGS[provider])
    try:
        return _started(states, on_batch, checkpoint, available_now, "update")
    finally:
        conf.set(provider, before)


def kept_rows(store: StateStore) -> DataFrame:
    """All rows that :func:`dedup_stream` has let through, with ``sig`` and ``run``."""
    return store.log(KEPT)
