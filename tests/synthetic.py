"""A small trace with a known answer: reads of which three go to disk and four take a timer interrupt."""

from spanloom import schema as S
from spanloom.operators.assemble import Trace, make_tracks

SPAN = ("trace_id string, span_id bigint, func string, start_us double, dur_us double, parent_id bigint, depth int, ord bigint, cpu int, "
        "task_key string, flags int, ret_text string, ret decimal(20,0), caller string, line_no bigint, close_line bigint, "
        "byte_start bigint, byte_end bigint, path array<bigint>, func_path array<string>")
SWITCH = "trace_id string, seq bigint, ts_us double, cpu int, prev_key string, next_key string, event_id bigint"
EVENT = ("trace_id string, event_id bigint, name string, ts_us double, cpu int, task_key string, span_id bigint, line_no bigint, "
         "byte_start bigint, byte_end bigint, payload string, fields map<string,string>")
GAP = "trace_id string, cpu int, lost bigint, ts_us double, line_no bigint"
TASK = "trace_id string, task_key string, pid int, comm string, first_line bigint"


class Builder:
    def __init__(self, trace="t", task="100"):
        self.rows, self.stack, self.ts, self.line, self.switches = [], [], 0.0, 0, []
        self.trace, self.task = trace, task

    def open(self, func, flags=0):
        self.rows.append(dict(span_id=self.line, func=func, start_us=float(self.ts), dur_us=None, flags=flags,
                              parent_id=self.stack[-1]["span_id"] if self.stack else None,
                              path=[r["span_id"] for r in self.stack] + [self.line], func_path=[r["func"] for r in self.stack] + [func]))
        self.stack.append(self.rows[-1])
        self.line += 1

    def close(self, dur=None):
        r = self.stack.pop()
        r["dur_us"] = float(self.ts - r["start_us"] if dur is None else dur)
        r["close_line"] = self.line
        self.line += 1

    def leaf(self, func, dur, flags=0, **kw):
        self.open(func, flags | S.LEAF)
        self.stack.pop()
        self.rows[-1].update(dur_us=float(dur), **kw)
        self.ts += dur

    def switch(self, at, prev, nxt):
        self.switches.append((self.trace, len(self.switches), at, 0, prev, nxt, None))

    def trace_tables(self, spark, tasks=None):
        cols = [c.strip().split(" ")[0] for c in SPAN.replace("decimal(20,0)", "d").split(",")]
        fill = lambda r: [{"trace_id": self.trace, "depth": len(r["path"]) - 1, "ord": r["span_id"], "cpu": 0, "task_key": self.task,
                           "line_no": r["span_id"], **r}.get(c) for c in cols]
        spans = spark.createDataFrame([fill(r) for r in self.rows], SPAN)
        sw = spark.createDataFrame(self.switches, SWITCH)
        ev, gaps = spark.createDataFrame([], EVENT), spark.createDataFrame([], GAP)
        tk = spark.createDataFrame([(self.trace, k, int(k), c, 0) for k, c in (tasks or {"100": "mystery", "7": "kworker/0:1"}).items()], TASK)
        end = max(r["start_us"] + (r["dur_us"] or 0) for r in self.rows)
        n = len(self.rows)
        meta = spark.sql(f"""select '{self.trace}' trace_id, 'function_graph' format, 'tracefs' source, 'function_graph' tracer, 'absolute' clock,
            0.0D t0_abs_s, {end}D duration_us, {n}L lines, 0L bytes, named_struct('proc', true, 'duration', true) options,
            named_struct('spans', {n}L, 'events', 0L, 'lost', 0L, 'gaps', 0L, 'orphans', 0L, 'unclosed', 0L, 'unparsed', 0L) counts,
            array(0) cpus, array('') warnings""")
        return Trace(spans, ev, sw, gaps, make_tracks(spans, tk), tk, meta)


def mystery(n=200, disk=(37, 112, 160), irqs=(5, 50, 90, 140)):
    b = Builder()
    reads = []
    for k in range(n):
        b.leaf("trace_syscall_enter", 0.3)
        reads.append(b.line)
        b.open("__x64_sys_read")
        b.open("vfs_read")
        b.leaf("touch_atime", 1 + (k % 7) * 0.1)
        b.open("filemap_get_pages")
        if k in disk:
            b.open("filemap_add_folio")
            b.leaf("submit_bio", 5)
            b.open("io_schedule")
            b.switch(b.ts + 1, "100", "7")
            b.ts += 150
            b.switch(b.ts - 1, "7", "100")
            b.close()
            b.close()
        if k in irqs:
            b.leaf("irq_enter_rcu", 0.2, S.IRQ)
            b.leaf("__sysvec_apic_timer_interrupt", 60, S.IRQ)
            b.leaf("irq_exit_rcu", 3, S.IRQ)
        b.leaf("filemap_get_read_batch", 4 + (k % 5) * 0.2)
        b.close()
        b.leaf("copy_page_to_iter", 2)
        b.close()
        b.close()
        b.leaf("trace_syscall_exit", 0.3)
        b.ts += 2
    return b, reads
