"""Job logs as streams: per-job state kept by a stateful processor.

Lines may come in another order than they were written. They wait in a buffer until all lines before them have come, or until the
watermark says that none of those can come any more, and are folded in line order; a line that was folded already is a replay and changes
nothing. Lines are numbered from 1 (a log that begins with line 0 is taken as well).

Ours, not part of the batch semantics: a ten-minute watermark on ts drops later lines, and state of a job silent (by event time) for
a day is removed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from groundloom.streaming import jobs

WATERMARK = "10 minutes"
IDLE_MS = 24 * 3600 * 1000

STATE = StructType([StructField(n, t) for n, t in (("stage", StringType()), ("phase", StringType()), ("phase_us", LongType()), ("done", LongType()), ("total", LongType()),
                                                   ("frames", LongType()), ("warnings", LongType()), ("line_no", LongType()))])
OUTPUT = StructType([StructField("job_id", LongType()), *STATE.fields, StructField("spent", StringType())])  # spent: JSON, phase -> seconds


class Alarm:
    """One timer a job, a day of event time after its last line."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle
        self.seen = handle.getValueState("seen", StructType([StructField("ms", LongType())]))

    def set(self, us: int) -> None:
        ms = max(int(us) // 1000, self.seen.get()[0] if self.seen.exists() else 0)
        self.seen.update((ms,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms + IDLE_MS)

    def idle(self, now_ms: int) -> bool:
        """Whether the job has been silent for the whole time; its own state goes then."""
        ms = self.seen.get()[0] if self.seen.exists() else 0
        if ms + IDLE_MS > now_ms:
            self.handle.registerTimer(ms + IDLE_MS)
            return False
        self.seen.clear()
        return True


#: What a waiting line keeps.
LINE = StructType([StructField(n, t) for n, t in (("us", LongType()), ("kind", StringType()), ("stage", StringType()), ("phase", StringType()), ("done", LongType()), ("total", LongType()),
                                                  ("frames", LongType()), ("text", StringType()))])


def whole(v) -> int | None:
    return None if v is None or v != v else int(v)


class InOrder:
    """Lines of one job by number: those to fold now, and those that still wait."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.waiting = handle.getMapState("waiting", StructType([StructField("line_no", LongType())]), LINE)
        self.last = handle.getValueState("folded", StructType([StructField("line_no", LongType())]))

    def take(self, rows: pd.DataFrame, watermark_ms: int) -> tuple[list[dict], list[dict]]:
        """Ready lines and waiting ones, both in line order, as dicts with line_no."""
        begun = self.last.exists()
        last = self.last.get()[0] if begun else 0
        pool = {k[0]: dict(zip(LINE.names, v)) for k, v in self.waiting.iterator()}
        kept = set(pool)
        text = lambda v: v if isinstance(v, str) else None
        for r in rows.itertuples():
            n = int(r.line_no)
            if n not in pool and (n > last or not begun):
                pool[n] = dict(us=int(r.us), kind=r.kind, stage=text(r.stage), phase=text(r.phase), done=whole(r.done), total=whole(r.total), frames=whole(r.frames), text=r.line)
        ready: list[dict] = []
        for n in sorted(pool):
            if n > last + 1 and pool[n]["us"] > watermark_ms * 1000:
                break
            ready.append({"line_no": n, **pool[n]})
            last = n
        done = {r["line_no"] for r in ready}
        for n in kept & done:
            self.waiting.removeKey((n,))
        for n in pool.keys() - kept - done:
            self.waiting.updateValue((n,), tuple(pool[n][c] for c in LINE.names))
        if ready:
            self.last.update((last,))
        return ready, [{"line_no": n, **pool[n]} for n in sorted(pool) if n not in done]

    def clear(self) -> None:
        self.waiting.clear()
        self.last.clear()


NO_LINES = pd.DataFrame(columns=["line_no", "line", *LINE.names[:-1]])


class JobTracker(StatefulProcessor):
    """Latest stage, counter and frames per job, and the seconds spent in each phase: all lines so far, in line order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alarm = Alarm(handle)
        self.order = InOrder(handle)
        self.now = handle.getValueState("now", STATE)
        self.spent = handle.getMapState("spent", StructType([StructField("phase", StringType())]), StructType([StructField("seconds", DoubleType())]))

    @staticmethod
    def fold(s: dict, spent: dict, lines: list[dict]) -> None:
        for r in lines:
            s["line_no"] = r["line_no"]
            if r["kind"] == "stage":
                s["stage"] = r["stage"]
            if r["phase"] is not None:
                if s["phase"] is not None:
                    spent[s["phase"]] = spent.get(s["phase"], 0.0) + (r["us"] - s["phase_us"]) / 1e6
                s["phase"], s["phase_us"] = r["phase"], r["us"]
            if r["kind"] == "progress":
                s["done"], s["total"] = r["done"], r["total"]
            if r["frames"] is not None:
                s["frames"] = r["frames"]
            s["warnings"] += r["kind"] == "warning"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows))
        ready, waiting = self.order.take(lines, timerValues.getCurrentWatermarkInMs())
        s = dict(zip(STATE.names, self.now.get() if self.now.exists() else (None, None, None, None, None, None, 0, -1)))
        spent = {k[0]: v[0] for k, v in self.spent.iterator()}
        self.fold(s, spent, ready)
        self.now.update(tuple(s[n] for n in STATE.names))
        for phase, seconds in spent.items():
            self.spent.updateValue((phase,), (seconds,))
        self.fold(s, spent, waiting)  # shown, not kept: lines before these may still come
        self.alarm.set(lines["us"].max())
        yield pd.DataFrame([[key[0], *[s[n] for n in STATE.names], json.dumps(spent)]], columns=OUTPUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.alarm.idle(timerValues.getCurrentWatermarkInMs()):
            self.now.clear()
            self.spent.clear()
            self.order.clear()
        return iter([])

    def close(self) -> None:
        pass


class Throttle(StatefulProcessor):
    """Progress lines that differ from the last one of the job and come a second after it, or finish it. A line is written once its
    turn has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alarm = Alarm(handle)
        self.order = InOrder(handle)
        self.last = handle.getValueState("last", StructType([StructField("key", StringType()), StructField("us", LongType())]))

    def written(self, job: int, ready: list[dict]) -> pd.DataFrame:
        k0, u0 = self.last.get() if self.last.exists() else (None, None)
        out = []
        for r in ready:
            if r["kind"] == "progress":
                text = r["text"].split("progress ", 1)[1]
                if k0 is None or (text != k0 and (r["us"] - u0 >= 1_000_000 or r["done"] >= r["total"])):
                    out.append([job, r["line_no"], text])
                k0, u0 = text, r["us"]
        if k0 is not None:
            self.last.update((k0, u0))
        return pd.DataFrame(out, columns=["job_id", "line_no", "key"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows))
        ready, _ = self.order.take(lines, timerValues.getCurrentWatermarkInMs())
        self.alarm.set(lines["us"].max())
        yield self.written(key[0], ready)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        out = self.written(key[0], self.order.take(NO_LINES, now)[0])
        if self.alarm.idle(now):
            self.last.clear()
            self.order.clear()
        yield out

    def close(self) -> None:
        pass


class Tail(StatefulProcessor):
    """The last lines and the last warnings of each job by line number: lists of bounded length, whatever order lines come in."""

    LINES, WARNINGS = 40, 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alarm = Alarm(handle)
        item = StructType([StructField("line_no", LongType()), StructField("line", StringType())])
        self.lists = {"line": (handle.getListState("lines", item), self.LINES), "warning": (handle.getListState("warnings", item), self.WARNINGS)}
        self.batches = handle.getValueState("batches", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows))
        n = (self.batches.get()[0] if self.batches.exists() else 0) + 1
        self.batches.update((n,))
        out = []
        for what, (ring, most) in self.lists.items():
            own = lines if what == "line" else lines[lines["kind"] == "warning"]
            both = {k: v for k, v in ring.get()} | {int(k): v for k, v in zip(own["line_no"], own["line"])}
            last = sorted(both.items())[-most:]
            if last:
                ring.put(last)
            out += [[key[0], n, what, back, *x] for back, x in enumerate(reversed(last), 1)]
        self.alarm.set(lines["us"].max())
        yield pd.DataFrame(out, columns=["job_id", "batch", "what", "back", "line_no", "line"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.alarm.idle(timerValues.getCurrentWatermarkInMs()):
            self.batches.clear()
            for ring, _ in self.lists.values():
                ring.clear()
        return iter([])

    def close(self) -> None:
        pass


def parsed(lines: DataFrame) -> DataFrame:
    """Parsed lines of a stream with (job_id, line_no, ts, line), late ones dropped."""
    p = jobs.parse(lines.withWatermark("ts", WATERMARK))
    return p.select(F.col("job_id").cast("bigint").alias("job_id"), "line_no", "ts", "line", "kind", "stage", "phase", "done", "total", "frames", F.unix_micros("ts").alias("us"))


def job_state(lines: DataFrame) -> DataFrame:
    return parsed(lines).groupBy("job_id").transformWithStateInPandas(JobTracker(), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


def progress(lines: DataFrame) -> DataFrame:
    schema = StructType([StructField("job_id", LongType()), StructField("line_no", LongType()), StructField("key", StringType())])
    return parsed(lines).groupBy("job_id").transformWithStateInPandas(Throttle(), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def tails(lines: DataFrame) -> DataFrame:
    """After each batch, the whole tails of the jobs that had lines in it: job_id, batch (of the job, from 1), what ('line' or 'warning'), back, line_no, line. Progress lines are not kept."""
    schema = StructType([StructField(n, t) for n, t in (("job_id", LongType()), ("batch", LongType()), ("what", StringType()), ("back", LongType()), ("line_no", LongType()), ("line", StringType()))])
    return parsed(lines).where("kind <> 'progress'").groupBy("job_id").transformWithStateInPandas(Tail(), outputStructType=schema, outputMode="Update", timeMode="EventTime")


def throughput(lines: DataFrame) -> DataFrame:
    """Lines per stage and minute."""
    p = parsed(lines).where("kind = 'stage'")
    return p.groupBy(F.window("ts", "1 minute").alias("w"), "stage").agg(F.count(F.lit(1)).alias("lines"))


def eta_batch(model: DataFrame, steps: int, write):
    """A foreachBatch function: state rows -> percent and seconds left with the newest cost model."""

    def run(batch: DataFrame, epoch: int) -> None:
        s = batch.select("job_id", "phase", "done", "total", "frames", F.timestamp_micros("phase_us").alias("phase_since"), F.current_timestamp().alias("seen"))
        spent = batch.select("job_id", F.explode(F.from_json("spent", "map<string,double>")).alias("phase", "seconds"))
        write(jobs.eta(s, spent, model, steps), epoch)

    return run
