"""Streams that remember: contains-mode dedup with held rows, and digests and indicators seen in earlier batches."""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from doclens.sources.artifacts import bounded_batches

#: The state store that keyed state needs; set it on the session before a stream of this module starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_end(query: StreamingQuery) -> None:
    """Waits for a query that ends by itself, and raises what ended it early.

    By polling: while awaitTermination blocks the driver's Python, workers of keyed state may wait for it for ever.
    """
    while query.isActive:
        time.sleep(0.2)
    if query.exception() is not None:
        raise query.exception()


FIELDS = ("seq", "rule_id", "severity", "indication", "description")
KEPT = "artifact_id BIGINT, seq BIGINT, rule_id STRING, severity STRING, indication STRING, description STRING"


def first_texts(rows: list[tuple]) -> list[tuple]:
    """Of findings (seq, rule_id, severity, indication, description), those whose description no earlier one holds in either text.

    Texts that repeat are looked at once, and longer descriptions cannot lie in shorter texts.
    """
    kept, texts = [], {}
    for row in sorted(rows, key=lambda r: r[0]):
        own = row[4] or ""
        if own not in texts and not any(len(text) >= len(own) and own in text for text in texts):
            kept.append(row)
        for text in (row[4] or "", row[3] or ""):
            texts.setdefault(text, row[0])
    return kept


def _deflated(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else zlib.compress(t.encode()) for t in texts.to_pylist()], pa.binary())


def _inflated(data: bytes | None) -> str | None:
    return None if data is None else zlib.decompress(data).decode()


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What dedup leaves of each artifact's findings, whose last two fields are deflated."""
    for batch in batches:
        kept = []
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            kept += [(row["artifact_id"], *f) for f in first_texts([(*[f[c] for c in FIELDS[:3]], *[_inflated(f[c]) for c in FIELDS[3:]]) for f in row["found"]])]
        columns = [[r[k] for r in kept] for k in range(1 + len(FIELDS))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.string()) for k, c in enumerate(columns)], ["artifact_id", *FIELDS])


def dedup_contains_stream(findings: DataFrame, delay: str = "1 hour", delay_ms: int = 3_600_000) -> DataFrame:
    """K1's contains mode on a stream of findings (artifact_id, seq, ..., modificationTime), whatever the order of its rows.

    A finding goes when an earlier one (by seq) of its artifact holds its description. An artifact's rows are
    held as a session: as long as the next comes within the delay. Once the watermark has passed the delay
    after the last one they are written at once and forgotten; rows later than the watermark are
    dropped. delay_ms is the delay again, in milliseconds. Texts are deflated before they are dealt out
    and held.
    """
    bounded_batches(findings.sparkSession)
    deflated = F.arrow_udf(_deflated, "binary")
    timed = findings.withColumns({c: deflated(c) for c in FIELDS[3:]}).withWatermark("modificationTime", delay)
    session = F.session_window("modificationTime", f"{delay_ms} milliseconds")
    held = timed.groupBy("artifact_id", session).agg(F.collect_list(F.struct(*FIELDS)).alias("found"))
    return held.select("artifact_id", "found").mapInArrow(_first_of_each, KEPT)


SEEN = "value STRING, artifact_id BIGINT, first_artifact BIGINT, n_before BIGINT"


class SeenValues(StatefulProcessor):
    """How many artifacts had a value before, and which was the first; forgotten a time after its last news."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first BIGINT, n BIGINT, due BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ids, last = set(), 0
        for row in rows:
            ids.add(row["artifact_id"])
            last = max(last, row["at"])
        ids, over, seen = sorted(ids), timerValues.getCurrentWatermarkInMs(), self.seen.get()
        first, n, due = seen or (ids[0], 0, None)
        if due is not None:
            self.handle.deleteTimer(due)
            if due <= over:  # over already: timers come after a batch's rows
                first, n, due = ids[0], 0, None
        due = max(due or 0, last + self.keep_ms, over + 1)
        self.handle.registerTimer(due)
        self.seen.update((first, n + len(ids), due))
        return (Row(value=key[0], artifact_id=x, first_artifact=first, n_before=n + k) for k, x in enumerate(ids) if n + k > 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def seen_before(values: DataFrame, value_col: str, delay: str = "1 hour", keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """J7 and J8 across batches: (value, artifact_id, first_artifact, n_before) of values that another artifact had before.

    With sha256 as the value these are copies, with a finding's description shared indicators.
    Within a batch artifacts count by id, once each. State is three numbers a value, and goes when
    the watermark is keep_ms past its last modificationTime; rows later than delay are dropped.
    """
    timed = values.where(F.col(value_col).isNotNull()).withWatermark("modificationTime", delay)
    rows = timed.select(F.col(value_col).alias("value"), "artifact_id", "modificationTime", F.unix_millis("modificationTime").alias("at"))
    return rows.groupBy("value").transformWithState(SeenValues(keep_ms), SEEN, "Append", "EventTime")
