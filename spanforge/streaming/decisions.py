"""Evaluation over streams, and the stateful rules of the decision log."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.evaluate import evaluate
from ..operators.sequence import compact_log, dedupe_window
from ..plans.rules import Config, Rule, Spans
from ..sources.shared import Store


def evaluate_stream(spans: DataFrame, catalog: Iterable[Rule], config: Config | None = None, columns: Spans | None = None) -> DataFrame:
    """The batch operator: evaluation has no state, so a stream takes the same columns."""
    return evaluate(spans, catalog, config, columns)


MARKS = 30 * 24 * 3_600_000  # how long a log's or project's mark is kept, in milliseconds
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(times: pd.Series) -> np.ndarray:
    return pd.to_datetime(times).astype("datetime64[ms]").astype("int64").to_numpy()


class _Marked(StatefulProcessor):
    """A mark for each key, which goes by a timer once the watermark is MARKS beyond it."""

    SCHEMA = ""

    def __init__(self, ts: str):
        self.ts = ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.mark = handle, handle.getValueState("mark", self.SCHEMA)

    def take(self, rows: pd.DataFrame, at: np.ndarray, mark: tuple | None) -> tuple[np.ndarray, tuple]:
        """Which rows, which are in the order of their times, stay, and the mark behind them."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.ts, kind="stable")
        keep, mark = self.take(frame, _millis(frame[self.ts]), self.mark.get() if self.mark.exists() else None)
        self.mark.update(mark)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(int(mark[-1]), timerValues.getCurrentWatermarkInMs()) + MARKS)
        yield frame[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.mark.clear()
        return iter([])

    def close(self) -> None:
        pass


class _Repeats(_Marked):
    SCHEMA = "last_key string, last_call string, last_at long"

    def __init__(self, key: str, ts: str, millis: int, call_id: str | None):
        super().__init__(ts)
        self.key, self.millis, self.call_id = key, millis, call_id

    def take(self, rows, at, mark):
        last_key, last_call, last_at = mark or (None, None, None)
        keys = [None if pd.isna(k) else str(k) for k in rows[self.key]]
        calls = [None if pd.isna(c) else str(c) for c in rows[self.call_id]] if self.call_id else [None] * len(keys)
        keep, i = np.zeros(len(rows), bool), 0
        while i < len(keys):
            j = i + 1  # a run of one key and call
            while j < len(keys) and (keys[j], calls[j]) == (keys[i], calls[i]):
                j += 1
            goes_on = last_at is not None and (keys[i], calls[i]) == (last_key, last_call)
            k = i
            if goes_on:
                k = j if calls[i] is not None else i + int(np.searchsorted(at[i:j], last_at + self.millis, side="right"))
            while k < j:
                keep[k] = True
                last_key, last_call, last_at = keys[i], calls[i], int(at[k])
                k = j if calls[i] is not None else i + int(np.searchsorted(at[i:j], last_at + self.millis, side="right"))
            i = j
        return keep, (last_key, last_call, last_at)


class _Seldom(_Marked):
    SCHEMA = "last_at long"

    def __init__(self, ts: str, apart: int):
        super().__init__(ts)
        self.apart = apart

    def take(self, rows, at, mark):
        last, keep = mark[0] if mark else None, np.zeros(len(rows), bool)
        i = 0 if last is None else int(np.searchsorted(at, last + self.apart, side="left"))
        while i < len(at):  # one step for each record that stays
            keep[i], last = True, int(at[i])
            i = int(np.searchsorted(at, last + self.apart, side="left"))
        return keep, (last,)


def _stateful(records: DataFrame, key: str, ts: str, processor: StatefulProcessor) -> DataFrame:
    conf = records.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the store that has timers
    return records.withWatermark(ts, "1 minute").groupBy(key).transformWithStateInPandas(processor, records.schema, "Append", "EventTime")


def dedupe_stream(records: DataFrame, log: str, key: str, ts: str, millis: int = 3000, call_id: str | None = None) -> DataFrame:
    """Drop a record that repeats its log's last kept record within millis (inclusive) or, with one call id, at any age.

    The state of a log is its last kept key, call id and time; a timer removes it when the watermark (one minute) is 30 days
    on. Records of a micro-batch are taken in the order of their time; runs of one key are looked at as a whole. Sets the session's
    state store to RocksDB, which timers need.
    """
    return _stateful(records, log, ts, _Repeats(key, ts, millis, call_id))


def once_an_hour(records: DataFrame, project: str, ts: str, hours: float = 1) -> DataFrame:
    """One record a project in each hour from the last one that was kept: 10:59 and 11:01 are one hour's.

    The state is the time of the last kept record; a timer removes it after 30 days.
    """
    return _stateful(records, project, ts, _Seldom(ts, int(hours * 3_600_000)))


def windowed_counts(records: DataFrame, ts: str, decision: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Decisions by time window, for append or update output; data later than `late` is dropped."""
    by: Column = F.window(ts, width, slide) if slide else F.window(ts, width)
    return records.withWatermark(ts, late).groupBy(by, decision).agg(F.count("*").alias("n"))


def append_log(records: DataFrame, folder: str, checkpoint: str, command: str | None = "command"):
    """Write decisions as JSON lines as they come, their commands scrubbed; the file sink's own log makes each file count once."""
    from ..functions.redact import scrub

    own = records.withColumn(command, scrub(command)["text"]) if command else records
    return own.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")


class DecisionLog:
    """A log that a stream appends to in batches, without repeats, and that is compacted when it grows too large.

    <folder>/batches/<number> holds a version of the log: a JSON list of the segments (folders of Parquet files) that it is made
    of. A batch reads the last version, drops what repeats the last kept record of its log, writes the rest as a new
    segment and then the new version under the batch's number, which only one writer can. A batch that has a version, as after a
    restart that replays it, changes nothing. Readers take the last version, so they see whole batches.
    """

    def __init__(self, spark, folder: str, key: list[str], ts: str = "ts", log: str = "log", call_id: str | None = None, millis: int = 3000, most: int = 1 << 20, target: int = 512 << 10, days: int = 30):
        self.spark, self.folder, self.key, self.ts, self.log, self.call_id = spark, folder.rstrip("/"), key, ts, log, call_id
        self.millis, self.most, self.target, self.days, self.store = millis, most, target, days, Store(spark)

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.store.names(f"{self.folder}/batches") if n.isdigit())

    def segments(self, version: int | None = None) -> list[str]:
        known = self.versions()
        return json.loads(self.store.read(f"{self.folder}/batches/{known[-1] if version is None else version}")) if known else []

    def read(self, schema: str | None = None) -> DataFrame | None:
        """The log's records with seq, their place; None before the first batch, unless a schema is given."""
        found = [f"{self.folder}/{s}" for s in self.segments()]
        if found:
            return self.spark.read.parquet(*found)
        return self.spark.createDataFrame([], schema) if schema else None

    def _size(self) -> Column:
        return F.octet_length(F.to_json(F.struct(*[F.col(c) for c in self._columns]))) + 1  # a line of the log

    def add(self, batch: DataFrame, number: int) -> bool:
        """Append a batch; False if it was there already. Records of one batch are taken in the order of ts, then of all their columns."""
        if number in self.versions():
            return False
        self._columns = [c for c in batch.columns if c != "seq"]
        name, old = f"segment-{number}-{uuid.uuid4().hex}", self.read()
        first = (old.agg(F.max("seq")).first()[0] + 1) if old is not None and old.select("seq").head(1) else 0
        order = [F.col(self.ts), *(F.col(c) for c in self._columns)]
        place = F.row_number().over(Window.partitionBy(self.log).orderBy(*order)).cast("long") - 1  # seq orders one log's records
        new = batch.select(*self._columns, (place + first).alias("seq"))
        if old is not None:  # the last kept record of each log that has new ones stands before them
            last = old.join(batch.select(self.log).distinct(), self.log, "left_semi")
            last = last.groupBy(self.log).agg(F.max_by(F.struct(*old.columns), "seq").alias("r")).select("r.*")
            new = last.select(*self._columns, "seq").unionByName(new)
        kept = dedupe_window(new, self.key, ["seq"], self.ts, self.millis, self.call_id, [self.log]).where(F.col("seq") >= first)
        kept.write.parquet(f"{self.folder}/{name}")
        segments = [*self.segments(), name]
        segments = self._compacted(segments, number)
        return self.store.write_once(f"{self.folder}/batches/{number}", json.dumps(segments))

    def _compacted(self, segments: list[str], number: int) -> list[str]:
        """One segment in place of all, if a log is above `most` bytes."""
        rows = self.spark.read.parquet(*(f"{self.folder}/{s}" for s in segments))
        if rows.groupBy(self.log).agg(F.sum(self._size()).alias("size")).where(F.col("size") > self.most).isEmpty():
            return segments
        now = F.lit(rows.agg(F.max(self.ts)).first()[0])
        name = f"compacted-{number}-{uuid.uuid4().hex}"
        compact_log(rows, ["seq"], self._size(), self.ts, now, self.most, self.target, self.days, [self.log]).write.parquet(f"{self.folder}/{name}")
        return [name]

    def vacuum(self) -> int:
        """Delete segments that no version after the last two names: readers of these may go on. How many went."""
        known = self.versions()
        live = {s for v in known[-2:] for s in self.segments(v)}
        gone = [n for n in self.store.names(self.folder) if n.startswith(("segment-", "compacted-")) and n not in live and int(n.split("-")[1]) <= (known[-1] if known else -1)]
        for n in gone:
            self.store.delete(f"{self.folder}/{n}")
        return len(gone)


def keep_log(records: DataFrame, log: DecisionLog, checkpoint: str, command: str | None = "command"):
    """A stream's writer that appends to a DecisionLog, with commands scrubbed."""
    from ..functions.redact import scrub

    own = records.withColumn(command, scrub(command)["text"]) if command else records
    return own.writeStream.foreachBatch(log.add).option("checkpointLocation", checkpoint)


def payload_calls(payloads: DataFrame, text: str = "value") -> DataFrame:
    """Hook payloads (JSON text) with the app that sent them and their calls; what is no object is left out. For streams and tables."""
    from ..operators.mapping import agent_of, cursor_candidates

    own = payloads.withColumn("payload", F.try_parse_json(text)).where(F.schema_of_variant("payload").startswith("OBJECT"))
    own = own.withColumn("agent", agent_of(F.col("payload")))
    return own.withColumn("candidates", F.when(F.col("agent") == "cursor", cursor_candidates(F.col("payload"))))
