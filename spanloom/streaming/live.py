"""Live traces: lines put in order and given to their tasks, calls assembled as their lines arrive.

Two stateful operators follow each other. ``live_rows`` keeps, per trace, how far its files have been read: it
numbers lines and bytes along rotated files, keeps the current task and interrupt mark of every CPU, and holds back files
that arrive before their predecessors and lines whose task is not named yet. ``live_spans`` keeps, per task, the
stack of open calls (``stacks``). Both give what the batch jobs give on the same text: line numbers, tasks, parents, flags.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import schema as S
from ..operators.assemble import IRQ_NAMES, IRQ_PREFIXES, task_key
from ..sources.tokens import tokenize
from .stacks import Stack

#: kinds of lines that calls and their tasks depend on
CALLS = ("open", "leaf", "close", "fn", "lost", "event", "marker", "banner")

TOKEN = ("trace_id string, rotation bigint, block bigint, file_size bigint, octets bigint, kind string, indent int, func string, dur_us double, abs_us double, "
         "irq boolean, irq_mark boolean, has_ret boolean, has_args boolean, lost bigint, cpu int, own string, sets string, claims string, text string, "
         "arrived timestamp")
PLACED = TOKEN + ", pos bigint, offset bigint"
ROW = ("trace_id string, line_no bigint, byte_start bigint, byte_end bigint, kind string, indent int, func string, dur_us double, abs_us double, irq boolean, "
       "has_ret boolean, has_args boolean, lost bigint, cpu int, task_key string, late boolean, text string, arrived timestamp")
SPAN = ("trace_id string, task_key string, span_id bigint, func string, parent_id bigint, depth int, start_us double, dur_us double, "
        "flags int, func_path array<string>, arrived timestamp")


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def live_tokens(lines: DataFrame) -> DataFrame:
    """Token rows of a stream with their place (``pos``, ``offset``) in their block of the file.

    A block is read in one go by one task, in file order, so counting along it is exact; only narrow token columns pass through
    Python. The last row of a block has kind ``end`` and its number of lines and bytes.
    """
    t = tokenize(lines.withColumn("arrived", F.current_timestamp()))
    irq = F.coalesce(F.col("func").isin(IRQ_NAMES) | F.col("func").rlike(IRQ_PREFIXES), F.lit(False))
    cpu = F.coalesce("cpu", F.lit(-1))
    own = task_key(F.col("pid"), cpu)
    t = t.select("trace_id", "rotation", "block", "file_size", "octets", "kind", "indent", "func", "dur_us", "abs_us", irq.alias("irq"), "irq_mark",
                 F.col("ret").isNotNull().alias("has_ret"), "has_args", "lost", cpu.alias("cpu"), own.alias("own"),
                 F.coalesce(task_key(F.col("next_pid"), cpu), own).alias("sets"), F.coalesce(task_key(F.col("prev_pid"), cpu), own).alias("claims"),
                 "text", "arrived")
    return t.mapInPandas(_count_rows, PLACED)


def _count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add pos and offset, and an ``end`` row after each block."""
    keys = ["trace_id", "rotation", "block"]
    last, lines, size = None, 0, 0

    def end() -> pd.DataFrame:
        row = last.to_frame().T
        return row.assign(kind="end", pos=lines, offset=size, own=None, sets=None, claims=None, text=None)

    for pdf in batches:
        if not len(pdf):
            continue
        new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        new[0] = last is None or (pdf[keys].iloc[0] != last[keys]).any()
        cuts = [0, *np.flatnonzero(new)[np.flatnonzero(new) > 0].tolist(), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = pdf.iloc[a:b]
            if new[a]:
                if last is not None:
                    yield end()
                lines, size = 0, 0
            octets = part["octets"].to_numpy(np.int64)
            yield part.assign(pos=np.arange(lines, lines + len(part)), offset=size + np.cumsum(octets) - octets)
            lines, size, last = lines + len(part), size + int(octets.sum()), part.iloc[-1]
    if last is not None:
        yield end()


class FileOrder(StatefulProcessor):
    """Rows of one trace in the order of its files, numbered, with their task.

    State: where the next file continues, the task and interrupt mark per CPU, rows of files that came before their predecessors, and
    lines before the first that names a task on their CPU. After ``wait_ms`` without the missing file, reading goes on with
    the next one there is; a file that comes after its successors gives ``late`` rows without numbers or tasks.
    """

    def __init__(self, wait_ms: int, first: int | None):
        self.wait_ms, self.first = wait_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "state string")
        self.early = handle.getListState("early", PLACED)
        self.unnamed = handle.getListState("unnamed", ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield self._step(key, pd.concat(list(rows), ignore_index=True), timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._step(key, None, timerValues, True)

    def close(self) -> None:
        pass

    def _step(self, key, got, timer, expired: bool) -> pd.DataFrame:
        state = json.loads(self.at.get()[0]) if self.at.exists() else {"next": self.first, "line": 0, "byte": 0, "cpus": {}}
        held = _frame(self.early.get(), PLACED)
        got = held if got is None else pd.concat([held, got], ignore_index=True) if len(held) else got
        out = []
        if state["next"] is not None and len(got):
            late = got["rotation"].between(0, state["next"] - 1)
            out.append(_late(got[late & (got["kind"] != "end")]))
            got = got[~late]
        rotations = sorted(got["rotation"].unique().tolist())
        if expired and rotations and rotations[0] != state["next"]:
            state["next"] = rotations[0]
        go = [r for r in rotations if r < 0]
        for r in rotations[len(go):]:
            if state["next"] is not None and r != state["next"]:
                break
            go.append(r)
            state["next"] = r + 1
        ready, rest = got[got["rotation"].isin(go)], got[~got["rotation"].isin(go)]
        if len(ready):
            out.append(self._in_order(key, ready, state))
        if expired:
            out.append(_frame(self.unnamed.get(), ROW))
            self.unnamed.clear()
        if len(rest):
            self.early.put(_tuples(rest, PLACED))
        else:
            self.early.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(rest) or self.unnamed.exists():
            self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + self.wait_ms)
        self.at.update((json.dumps(state),))
        return _typed(pd.concat([_typed(o, ROW) for o in out], ignore_index=True) if out else pd.DataFrame(columns=_names(ROW)), ROW)

    def _in_order(self, key, rows: pd.DataFrame, state: dict) -> pd.DataFrame:
        """Number the rows of complete files and give them their tasks."""
        end = rows["kind"] == "end"
        blocks = rows[end].sort_values(["rotation", "block"])[["rotation", "block", "pos", "offset", "file_size"]]
        # a last line without line feed ends with its file
        blocks = blocks.astype({c: np.int64 for c in ("pos", "offset", "file_size")})
        rest = blocks["file_size"] - blocks.groupby("rotation")["offset"].cumsum() + blocks["offset"]
        size = np.minimum(blocks["offset"], rest).to_numpy()
        lines = blocks["pos"].to_numpy(np.int64)
        blocks = blocks.assign(_line=state["line"] + np.cumsum(lines) - lines, _byte=state["byte"] + np.cumsum(size) - size, _end=state["byte"] + np.cumsum(size))
        state["line"], state["byte"] = state["line"] + int(lines.sum()), state["byte"] + int(size.sum())
        rows = rows[~end].merge(blocks[["rotation", "block", "_line", "_byte", "_end"]], on=["rotation", "block"])
        rows = rows.assign(line_no=rows["_line"] + rows["pos"], byte_start=rows["_byte"] + rows["offset"])
        rows = rows.assign(byte_end=np.minimum(rows["byte_start"] + rows["octets"], rows["_end"])).sort_values("line_no", ignore_index=True)
        acts = rows["kind"].isin(CALLS).to_numpy()
        tasks, irqs = np.full(len(rows), None, object), rows["irq"].fillna(False).to_numpy(bool)
        named = _frame(self.unnamed.get(), ROW)
        for cpu, part in rows[acts].groupby("cpu", sort=False):
            known = state["cpus"].setdefault(str(cpu), {"task": None, "mark": False})
            at = part.index.to_numpy()
            sets, claims = part["sets"].where(part["sets"].notna(), None), part["claims"].where(part["claims"].notna(), None)
            before = sets.shift().ffill()
            before = before.where(before.notna(), known["task"])
            # lines ahead of any name belong to the task that the first one claims
            if known["task"] is None and claims.notna().any():
                first = claims.dropna().iloc[0]
                before = before.where(before.notna(), first)
                mine = named["cpu"] == cpu
                named.loc[mine, "task_key"] = first
            own = part["own"]
            tasks[at] = own.where(own.notna(), before).to_numpy(object)
            marks = part["irq_mark"].where(part["irq_mark"].notna(), None)
            on = marks.shift().ffill()
            irqs[at] |= on.where(on.notna(), known["mark"]).to_numpy(bool)
            if sets.notna().any():
                known["task"] = sets.dropna().iloc[-1]
            if marks.notna().any():
                known["mark"] = bool(marks.dropna().iloc[-1])
        rows = rows.assign(task_key=tasks, irq=irqs, late=False)[_names(ROW)]
        # lines that nothing has named yet wait for the name, or for the timer
        open_ended = acts & rows["task_key"].isna().to_numpy()
        nameless = rows[open_ended].assign(task_key="?/" + rows["cpu"][open_ended].astype("string"))
        still = named["task_key"].astype("string").str.startswith("?/").fillna(False).to_numpy(bool)
        waiting = _tuples(named[still], ROW) + _tuples(nameless, ROW)
        if waiting:
            self.unnamed.put(waiting)
        else:
            self.unnamed.clear()
        go = [_typed(df, ROW) for df in (named[~still], rows[~open_ended]) if len(df)]
        return pd.concat(go, ignore_index=True) if go else rows[:0]


def _frame(rows, schema: str) -> pd.DataFrame:
    return pd.DataFrame([tuple(r) for r in rows], columns=_names(schema))


def _tuples(pdf: pd.DataFrame, schema: str) -> list[tuple]:
    pdf = _typed(pdf, schema)
    cols = []
    for c in pdf.columns:
        values = pdf[c].astype(object).where(pdf[c].notna(), None).tolist()
        cols.append([v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if isinstance(v, np.generic) else v for v in values])
    return list(zip(*cols))


_DTYPES = {"bigint": "Int64", "int": "Int32", "double": "Float64", "boolean": "boolean", "string": "object", "timestamp": "datetime64[ns]"}


def _typed(pdf: pd.DataFrame, schema: str) -> pd.DataFrame:
    """The columns of ``schema``, with nulls that survive in whole numbers and flags."""
    out = {}
    for c in schema.split(","):
        name, kind = c.strip().split(" ")
        col = pdf[name] if name in pdf.columns else pd.Series([None] * len(pdf), index=pdf.index)
        out[name] = col.astype(object).where(col.notna(), None) if kind == "string" else col.astype(_DTYPES[kind])
    return pd.DataFrame(out)


def _late(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(line_no=None, byte_start=None, byte_end=None, task_key=None, late=True)


def live_rows(lines: DataFrame, kinds: tuple[str, ...] | None = (*CALLS, "unparsed"), wait_ms: int = 60_000, first: int | None = None) -> DataFrame:
    """Streaming rows of the given kinds (None: all) with line_no, byte range and task, as ``number_lines`` and ``attribute`` give them.

    ``first``: number of the first file, where it is known; otherwise a trace begins with the first file seen.
    """
    t = live_tokens(lines)
    if kinds is not None:
        t = t.where(F.col("kind").isin(*kinds, "end"))
    return t.groupBy("trace_id").transformWithStateInPandas(FileOrder(wait_ms, first), ROW, "Append", "ProcessingTime")


class Calls(StatefulProcessor):
    """Calls of one task; a task that is silent for ``idle_ms`` gives up its open calls."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stack = handle.getValueState("stack", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stack = Stack(json.loads(self.stack.get()[0]) if self.stack.exists() else None)
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("line_no", kind="stable")
        cols = ["kind", "line_no", "indent", "func", "dur_us", "abs_us", "irq", "has_ret", "has_args"]
        whole = {"line_no", "indent"}
        values = [[None if pd.isna(v) else int(v) if c in whole else v for v in pdf[c].tolist()] for c in cols]
        for row in zip(*values):
            stack.line(dict(zip(cols, row)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        state = stack.state()
        if state["open"] or state["loose"]:
            self.stack.update((json.dumps(state),))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        else:
            self.stack.clear()
        yield _spans(key, stack.out, pdf["arrived"].max())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.stack.exists():
            stack = Stack(json.loads(self.stack.get()[0]))
            stack.give_up()
            self.stack.clear()
            yield _spans(key, stack.out, pd.Timestamp.now())

    def close(self) -> None:
        pass


def _spans(key, out: list[tuple], arrived: pd.Timestamp) -> pd.DataFrame:
    return _typed_spans(pd.DataFrame([(key[0], key[1], *row, arrived) for row in out], columns=_names(SPAN)))


def _typed_spans(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.astype({"span_id": "Int64", "parent_id": "Int64", "depth": "Int32", "start_us": "Float64", "dur_us": "Float64", "flags": "Int32",
                       "arrived": "datetime64[ns]"})


def live_spans(lines: DataFrame, idle_ms: int = 600_000, wait_ms: int = 60_000, first: int | None = None) -> DataFrame:
    """Streaming span rows, each once, when its parent is certain. Durations and stamps are as printed."""
    rows = live_rows(lines, CALLS, wait_ms, first).where("not late and kind in ('open', 'leaf', 'close', 'fn', 'lost')")
    return rows.groupBy("trace_id", "task_key").transformWithStateInPandas(Calls(idle_ms), SPAN, "Append", "ProcessingTime")


def live_func_stats(spans: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Tumbling statistics of closed calls per function."""
    ok = spans.where(F.col("dur_us").isNotNull() & (F.col("flags").bitwiseAND(F.lit(S.UNTIMED)) == 0))
    return (ok.withWatermark("arrived", late).groupBy(F.window("arrived", window), "trace_id", "func")
            .agg(F.count(F.lit(1)).alias("calls"), F.sum("dur_us").alias("total_us"), F.max("dur_us").alias("max_us"),
                 F.percentile_approx("dur_us", 0.5).alias("p50_us")))


def live_quarantine(lines: DataFrame, wait_ms: int = 60_000, first: int | None = None) -> DataFrame:
    """Lines of a stream that no rule understood, with their place in the trace, and lines of files that came too late."""
    rows = live_rows(lines, None, wait_ms, first)
    return rows.where("late or kind = 'unparsed'").select("trace_id", "line_no", "late", "text")
