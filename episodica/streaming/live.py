"""The log as a stream: counts in windows, sessions, running counters, and review decisions that wait for the next boundary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, ts: str, width: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Rows per window and group; a stream holds a window until the watermark has passed it."""
    x = events.withWatermark(ts, late) if events.isStreaming else events
    return x.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap: start, end, n."""
    x = events.withWatermark(ts, late) if events.isStreaming else events
    return x.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def counters(events: DataFrame, by: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Running counts of each kind, for update mode."""
    return events.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col(kind) == k).alias(k) for k in kinds))


def once(events: DataFrame, key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Each key once, as long as the watermark remembers it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


PAIR = "uid bigint, review_seq bigint, before_key string, after_key string, closed_by string"
_STATE = "before string, review bigint, last bigint"


def _pairs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, wait_ms: int | None) -> Iterator[pd.DataFrame]:
    """Keeps three values a trajectory: the latest answer, the open review and the last sequence number; earlier rows are late and dropped."""
    before, review, last = state.get if state.exists else (None, None, -1)
    out = []
    if state.hasTimedOut:
        if review is not None:
            out.append((key[0], review, before, None, "timeout"))
        state.remove()
    else:
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, kind, answer in rows[["seq", "kind", "answer_key"]].itertuples(index=False):
            if seq <= last:
                continue
            last = int(seq)
            if review is not None:
                out.append((key[0], review, before, answer if kind == "actor" else None, kind))
                review = None
            if kind == "review":
                review = last
            elif kind == "submission":
                before = None
            else:
                before = answer if answer is not None else before
        state.update((before, review, last))
        if wait_ms:
            state.setTimeoutDuration(wait_ms)
    yield pd.DataFrame(out, columns=["uid", "review_seq", "before_key", "after_key", "closed_by"]).astype({"uid": "int64", "review_seq": "int64"})


def review_pairs(events: DataFrame, wait_ms: int | None = 3_600_000) -> DataFrame:
    """Each PER review with the answer before it and whatever follows it, given out when its boundary arrives or the wait is over.
    events: uid, seq, kind (actor, review or submission), answer_key; a trajectory's rows arrive in order of seq.
    With a wait the query runs until it is stopped; for a run over what is there now (availableNow) give None."""
    step = lambda key, batches, state: _pairs(key, batches, state, wait_ms)
    return events.groupBy("uid").applyInPandasWithState(step, PAIR, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if wait_ms else GroupStateTimeout.NoTimeout)


def first_wins_sink(path: str, key: list[str]):
    """For foreachBatch: adds the rows whose key isn't in the table at the path yet. A batch that is run twice adds nothing."""

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(key)
        try:
            rows = rows.join(spark.read.parquet(path).select(*key), key, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(path)

    return put


def _batches(spark: SparkSession, path: str) -> DataFrame:
    """The batches that ended."""
    schema = "cache_writer string, cache_batch bigint, cache_ended timestamp"
    try:
        return spark.read.schema(schema).parquet(f"{path}/ended")
    except AnalysisException as e:  # before the first one
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _end(spark: SparkSession, path: str, writer: str, batch: int) -> None:
    spark.range(1).select(F.lit(writer).alias("cache_writer"), F.lit(batch).cast("long").alias("cache_batch"), F.current_timestamp().alias("cache_ended")).coalesce(1).write.mode("append").parquet(f"{path}/ended")


def cached_rows(spark: SparkSession, path: str, schema: StructType, key: list[str] | None = None) -> DataFrame:
    """What cache_sink() wrote in batches that ended, with cache_writer, cache_batch and cache_bucket; with a key, of rows of one key that several writers
    added, the one of the batch that ended last."""
    whole = StructType([*schema.fields, *StructType.fromDDL("cache_writer string, cache_batch bigint, cache_bucket int").fields])
    try:
        rows = spark.read.schema(whole).parquet(f"{path}/rows")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], whole)
    ended = _batches(spark, path)
    if not key:
        return rows.join(ended.drop("cache_ended"), ["cache_writer", "cache_batch"], "left_semi")
    last = F.max_by(F.struct(*(c for c in whole.names if c not in key)), F.struct("cache_ended", "cache_writer", "cache_batch"))
    return rows.join(ended, ["cache_writer", "cache_batch"]).groupBy(*key).agg(last.alias("_r")).select(*(c if c in key else f"_r.{c}" for c in whole.names))


def cache_sink(path: str, key: list[str], order: list[str], required: tuple[str, ...] = (), writer: str = "one", buckets: int = 64):
    """For foreachBatch: a table in which the first row of each key stays, however often a batch is run or wherever a run ends.

    A batch writes its new rows to a folder of its own, which a second run replaces, and then notes that it ended; readers (cached_rows)
    take rows of ended batches only, and a batch that ended adds nothing when it is run again. Rows lie in buckets by key, and a batch
    reads the buckets that its own keys fall into. Of one batch's rows of a key the first in `order` counts. Rows without a key or without
    a column of `required` go to `refused`, kept apart by batch as well, and stop nothing. Several streams may write to one path, each
    under a writer's name of its own; what they add at the same time for one key is settled by the reader.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        if not _batches(spark, path).where((F.col("cache_writer") == writer) & (F.col("cache_batch") == batch_id)).isEmpty():
            return
        folder = f"cache_writer={writer}/cache_batch={batch_id}"
        whole = F.lit(True)
        for c in (*key, *required):
            whole = whole & F.col(c).isNotNull()
        batch.where(~whole).write.mode("overwrite").parquet(f"{path}/refused/{folder}")
        others = [c for c in schema.names if c not in key]
        first = F.min_by(F.struct(F.lit(0).alias("_"), *others), F.struct(*order))
        rows = batch.where(whole).groupBy(*key).agg(first.alias("_r")).select(*(c if c in key else f"_r.{c}" for c in schema.names))
        rows = rows.withColumn("cache_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = [r["cache_bucket"] for r in rows.select("cache_bucket").distinct().collect()]  # `buckets` numbers at most
        held = cached_rows(spark, path, schema).where(F.col("cache_bucket").isin(touched)).select(*key)
        rows.join(held, key, "left_anti").repartition("cache_bucket").write.mode("overwrite").partitionBy("cache_bucket").parquet(f"{path}/rows/{folder}")
        _end(spark, path, writer, batch_id)

    return put


LEDGER = "key string, entry bigint, parent bigint, at bigint, text string"


def ledgers(events: DataFrame, limit: int, keep_ms: int | None = None) -> DataFrame:
    """Each question's newest entries after every batch that touches it, as bounded_ledger() numbers them: key, entry (from 1), parent, at, text.

    events: key string, at bigint (their order), text string; for update mode. State holds `limit` rows of a key at most, and with
    keep_ms none that is older. Entries arrive in order over batches; within one they are sorted. A null key is no question. The state
    store must be one with list state (RocksDB).
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Ledger(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.rows = handle.getListState("rows", "at bigint, text string", keep_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            new = pd.concat(list(rows)).sort_values(["at", "text"], kind="stable")[["at", "text"]]
            held = [(int(r[0]), r[1]) for r in self.rows.get()] if self.rows.exists() else []
            kept = (held + [(int(a), t) for a, t in new.itertuples(index=False)])[-limit:]
            self.rows.put(kept)
            out = [(key[0], i, i - 1 if i > 1 else None, at, text) for i, (at, text) in enumerate(kept, 1)]
            yield pd.DataFrame(out, columns=["key", "entry", "parent", "at", "text"]).astype({"parent": "Int64"})

        def close(self) -> None:
            pass

    return events.where("key IS NOT NULL").groupBy("key").transformWithStateInPandas(Ledger(), LEDGER, "Update", "processingTime" if keep_ms else "none")
