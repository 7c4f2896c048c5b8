"""Windows of a fixed number of samples on a stream, and flight status that expires.

A flight's state is its open tail: the samples that no closed window needs any more are gone, and samples that the watermark
has not passed wait for late ones. So a closed window holds the same samples as in a batch over all rows, whatever the order of
arrival within the allowed delay. A timer closes what is left when the watermark passes a flight's last sample.

Waiting samples are not one value but many: sorted runs, cut into pages that the state store keeps on disk. A sample is written
when it comes and read when it is final, and a task holds one page of each run, however many samples of a flight wait.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..operators.features import ALL_FEATURES, _columns
from ..operators.monitor import status_text

# Bytes of samples that are sorted together as they come, bytes of a page, and runs that a flight has at most.
SORTED, PAGE, RUNS = 2**22, 2**18, 32


def windows_of(values: np.ndarray, first: int, w: int, length: int, step: int, final: int) -> tuple[np.ndarray, int]:
    """Row numbers (windows, length) of the windows that close, and the next window's number.

    `values` are a flight's samples from sample `first` on, `final` of them cannot change any more. As in batches a window
    needs a sample behind it.
    """
    count = max(0, -(-(first + final - length) // step) - w) if first + final > length else 0
    starts = (w + np.arange(count)) * step - first
    return starts[:, None] + np.arange(length), w + count


class Runs:
    """The waiting samples of one flight: runs of pages, sorted by time and tie, in a map state (run, page) -> samples.

    `table` has a row for each run: its number, the page to be read next, the number of pages, the samples of that page that are
    gone, the time of the next sample and that of the last one.
    """

    def __init__(self, pages, kind: np.dtype, table: bytes):
        self.pages, self.kind = pages, kind
        self.table = np.frombuffer(table, dtype=np.int64).reshape(-1, 6).tolist()

    def add(self, samples: np.ndarray) -> None:
        self._keep(iter([samples[np.lexsort((samples["tie"], samples["us"]))]]))
        if len(self.table) > RUNS:
            shortest = sorted(self.table, key=lambda r: r[2] - r[1])[: RUNS // 2]
            self._keep(self.merged(shortest))
            self.table = [r for r in self.table if r[1] < r[2]]

    def final(self, us: int) -> Iterator[np.ndarray]:
        """Takes out the samples up to time `us`, in order."""
        yield from self.merged(self.table, us)
        self.table = [r for r in self.table if r[1] < r[2]]

    def last(self) -> int | None:
        return max((r[5] for r in self.table), default=None)

    def stored(self) -> bytes:
        return np.array(self.table, dtype=np.int64).tobytes()

    def _keep(self, pieces: Iterator[np.ndarray]) -> None:
        run = 1 + max((r[0] for r in self.table), default=-1)
        size, rest, page, head = max(1, PAGE // self.kind.itemsize), np.empty(0, dtype=self.kind), 0, None
        for piece in pieces:
            rest = np.concatenate([rest, piece])
            head, last = int(rest["us"][0]) if head is None else head, int(rest["us"][-1])
            full = len(rest) // size * size
            for k in range(0, full, size):
                self.pages.updateValue((run, page), (rest[k : k + size].tobytes(),))
                page += 1
            rest = rest[full:]
        if len(rest):
            self.pages.updateValue((run, page), (rest.tobytes(),))
            page += 1
        self.table.append([run, 0, page, 0, head, last])

    def merged(self, runs: list[list[int]], until: int = np.iinfo(np.int64).max) -> Iterator[np.ndarray]:
        """Takes the samples up to time `until` out of some runs: pieces of about a page, in order."""
        read = {}
        while live := [r for r in runs if r[1] < r[2] and r[4] <= until]:
            for r in live:
                if r[0] not in read:
                    read[r[0]] = np.frombuffer(bytes(self.pages.getValue((r[0], r[1]))[0]), dtype=self.kind)[r[3] :]
            # What comes after the pages at hand comes after the first of their ends.
            us, tie = min((read[r[0]]["us"][-1], read[r[0]]["tie"][-1]) for r in live)
            if us > until:
                us, tie = until, np.iinfo(np.int64).max
            pieces = []
            for r in live:
                samples = read[r[0]]
                low, high = np.searchsorted(samples["us"], us, "left"), np.searchsorted(samples["us"], us, "right")
                taken = int(low + np.searchsorted(samples["tie"][low:high], tie, "right"))
                pieces.append(samples[:taken])
                r[3] += taken
                if taken < len(samples):
                    read[r[0]], r[4] = samples[taken:], int(samples["us"][taken])
                    continue
                self.pages.removeKey((r[0], r[1]))
                del read[r[0]]
                r[1], r[3] = r[1] + 1, 0
            piece = np.concatenate(pieces)
            yield piece[np.lexsort((piece["tie"], piece["us"]))]


class Closing(StatefulProcessor):
    """Closes the windows of a flight whose samples are final."""

    def __init__(self, channels, length: int, step: int, fs: float, time: str):
        self.channels, self.length, self.step, self.fs, self.time = channels, length, step, fs, time
        self.kind = np.dtype([("us", np.int64), ("tie", np.int64), ("x", np.float64, (len(channels),))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "run long, page long", "samples binary")
        self.flight = handle.getValueState("flight", "first long, w long, timer long, tail binary, runs binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first, w, timer, tail, table = self.flight.get() or (0, 0, 0, b"", b"")
        runs, held = Runs(self.pages, self.kind, table), []
        for part in rows:
            samples = np.empty(len(part), dtype=self.kind)
            samples["us"], samples["tie"] = part["us"].astype("int64"), part["tie"].astype("int64")
            for j in range(len(self.channels)):
                samples["x"][:, j] = part[f"x{j}"].astype(float)
            held.append(samples)
            # A flight with many samples never has them all in memory, not even those of one batch.
            if sum(s.nbytes for s in held) >= SORTED:
                runs.add(np.concatenate(held))
                held = []
        if held:
            runs.add(np.concatenate(held))
        yield from self._close(key, timerValues.getCurrentWatermarkInMs(), first, w, timer, tail, runs)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, w, _, tail, table = self.flight.get()
        yield from self._close(key, timerValues.getCurrentWatermarkInMs(), first, w, 0, tail, Runs(self.pages, self.kind, table))

    def _close(self, key: tuple, passed: int, first: int, w: int, timer: int, tail: bytes, runs: Runs) -> Iterator[pd.DataFrame]:
        rest = np.frombuffer(bytes(tail), dtype=self.kind)
        for piece in runs.final(passed * 1000):
            rest = np.concatenate([rest, piece])
            cells, following = windows_of(rest, first, w, self.length, self.step, len(rest))
            if len(cells):
                middle = rest["us"][cells[:, self.length // 2]]
                columns = {"key": key[0], "w": np.arange(w, following), self.time: pd.to_datetime(middle, unit="us")}
                for j, c in enumerate(self.channels):
                    for n, values in _columns(rest["x"][:, j][cells], self.fs).items():
                        columns[f"{c}_{n}"] = values.fill_null(0.0).to_numpy()
                yield pd.DataFrame(columns)
            # Of the samples that are final, only those of the next window on are needed.
            drop = min(len(rest), max(0, following * self.step - first))
            first, w, rest = first + drop, following, rest[drop:]
        last = runs.last()
        due = last // 1000 + 1 if last is not None and last // 1000 + 1 > passed else 0
        if timer and timer != due:
            self.handle.deleteTimer(timer)
        if due and timer != due:
            self.handle.registerTimer(due)
        self.flight.update((first, w, due, rest.tobytes(), runs.stored()))


def counted_windows(stream: DataFrame, channels, length: int, step: int, fs: float, delay: str, key="flight_id", time="ts",
                    tie="event_id") -> DataFrame:
    """(key, w, <time>, <channel>_<feature>): windows of `length` samples every `step`, with the time of their middle sample.

    Samples are ordered by time, then by `tie` (a long). Those later than `delay` are dropped. All fourteen features of each
    channel; undefined statistics are 0. The state needs the RocksDB store, which `live.run_available` sets.
    """
    channels = list(channels)
    names = [f"{c}_{n}" for c in channels for n in ALL_FEATURES]
    values = [F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(channels)]
    timed = stream.select(F.col(key).alias("key"), time, F.col(tie).cast("long").alias("tie"), *values)
    timed = timed.withWatermark(time, delay).withColumn("us", F.unix_micros(time))
    output = f"key string, w long, {time} timestamp, " + ", ".join(f"`{n}` double" for n in names)
    closing = Closing(channels, length, step, fs, time)
    found = timed.groupBy("key").transformWithStateInPandas(closing, output, "append", "eventtime")
    return found.withColumnRenamed("key", key)


def expiring_status(scored: DataFrame, live_for_ms: int, by=("flight_id",), time="ts", delay="0 seconds") -> DataFrame:
    """(by, seen, faulty_share, latest_severity, status): the running status, one row for each flight of a batch.

    The state of a flight is removed once the watermark is `live_for_ms` past its latest row; a flight that comes back
    begins anew. `scored` has (by, w, fault_label, severity_level) and the event time.
    """
    by = list(by)
    timed = scored.withWatermark(time, delay).withColumn("ms", F.unix_millis(time))
    kinds = {f.name: f.dataType.simpleString() for f in scored.schema}

    def advance(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, faulty, w, level, label, last = state.get if state.exists else (0, 0, -1, 0, 0, 0)
        for part in parts:
            seen, faulty, last = seen + len(part), faulty + int(part["fault_label"].sum()), max(last, int(part["ms"].max()))
            top = part.loc[part["w"].idxmax()]
            if top["w"] >= w:
                w, level, label = int(top["w"]), int(top["severity_level"]), int(top["fault_label"])
        state.update((seen, faulty, w, level, label, last))
        state.setTimeoutTimestamp(max(last + live_for_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*keys, seen, faulty / seen, level, label)], columns=[*by, "seen", "faulty_share", "latest_severity", "label"])

    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    state = "seen long, faulty long, w long, level int, label int, last long"
    output = f"{keys}, seen long, faulty_share double, latest_severity int, label int"
    found = timed.groupBy(*by).applyInPandasWithState(advance, output, state, "update", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("status", status_text(F.col("label"))).drop("label")


def stored_status(spark: SparkSession, folder: str, by=("flight_id",)) -> DataFrame:
    """The status of all flights that have not expired, read from the state of a run of `expiring_status` in `folder`."""
    state = spark.read.format("statestore").load(f"{folder}/progress")
    state = state.select("key.*", "value.groupState.*")
    return state.select(
        *by, "seen", (F.col("faulty") / F.col("seen")).alias("faulty_share"), F.col("level").alias("latest_severity"), status_text(F.col("label")).alias("status")
    )
