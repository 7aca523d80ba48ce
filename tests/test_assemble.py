"""Call trees from hand-written lines."""

from spanloom import schema as S


def by_func(tr):
    return {r["func"]: r for r in tr.spans.collect()}


def test_columns_and_returns(trace):
    tr = trace([
        "# tracer: function_graph",
        " 0)               |  vfs_read(file=0x1, count=4096) { /* <-ksys_read+0x6f/0xf0 */",
        " 0)   0.151 us    |    dput.part.0(); /* ret=0x0 */",
        " 0) + 12.500 us   |    rw_verify_area(); /* <-vfs_read+0x2/0x3 ret=-22 */",
        " 0) + 14.010 us   |  } /* vfs_read ret=0x1000 */"])
    s = by_func(tr)
    assert len(s) == 3
    v, r = s["vfs_read"], s["rw_verify_area"]
    assert v["dur_us"] == 14.01 and int(v["ret"]) == 4096 and v["flags"] & S.HAS_ARGS
    assert int(r["ret"]) == -22 and r["parent_id"] == v["span_id"] and r["start_us"] == 0.151
    m = tr.meta.first()
    assert (m["tracer"], m["clock"], m["format"]) == ("function_graph", "reconstructed", "function_graph")
    o = m["options"]
    assert [o[c] for c in ("cpu", "duration", "args", "retval", "retaddr", "proc", "abstime")] == [True] * 5 + [False] * 2


def test_old_return_style(trace):
    s = by_func(trace([" 1)   0.2 us    |  foo(); /* = 0xffffffffffffffea */", " 1)               |  bar() {",
                       " 1)   1.0 us    |  } /* bar = -22 */"]))
    assert int(s["foo"]["ret"]) == 18446744073709551594 and int(s["bar"]["ret"]) == -22


def test_absolute_clock(trace):
    tr = trace([
        "  100.000010 |   2)  cat-5   |  ...1. |               |  a() {",
        "  100.000010 |   2)  cat-5   |  ...1. |   0.300 us    |    b();",
        "  100.000010 |   2)  cat-5   |  ...1. |   0.300 us    |    c();",
        "  100.000011 |   2)  cat-5   |  ...1. |   1.100 us    |  }",
        "  100.000020 |   2)  cat-5   |  ...1. |   0.100 us    |  d();"])
    s = by_func(tr)
    assert [s[f]["start_us"] for f in "abcd"] == [0, 0, 0.3, 10]
    m = tr.meta.first()
    assert m["clock"] == "absolute" and abs(m["t0_abs_s"] - 100.00001) < 1e-9
    assert m["options"]["latency"] and m["options"]["proc"]
    t = tr.tasks.first()
    assert (t["pid"], t["comm"]) == (5, "cat")


def test_bare(trace):
    tr = trace(["mutex_unlock();", "__x64_sys_dup2() {", "  ksys_dup3() {", "  }", "}"])
    s = by_func(tr)
    assert len(s) == 3 and s["ksys_dup3"]["depth"] == 1


def test_orphans_adopt_deeper_calls(trace):
    s = by_func(trace([" 0)   1.0 us    |      leafA();", " 0)   5.0 us    |    } /* inner */",
                       " 0)   0.5 us    |    sib();", " 0)   9.0 us    |  } /* outer */"]))
    assert s["inner"]["flags"] & S.ORPHAN and s["outer"]["flags"] & S.ORPHAN
    assert s["leafA"]["parent_id"] == s["inner"]["span_id"]
    assert s["inner"]["parent_id"] == s["outer"]["span_id"] == s["sib"]["parent_id"]


def test_threshold_output(trace):
    tr = trace([" 1) + 30.3 us   |    } /* do_sys_openat2 */", " 1) + 31.6 us   |  } /* __x64_sys_open */",
                " 1) ! 125.4 us  |        } /* dup_mmap */"])
    s = by_func(tr)
    assert s["do_sys_openat2"]["parent_id"] == s["__x64_sys_open"]["span_id"] and s["dup_mmap"]["parent_id"] is None
    assert s["__x64_sys_open"]["dur_us"] >= s["do_sys_openat2"]["dur_us"]
    assert "tracing_thresh" in " ".join(tr.meta.first()["warnings"])


def test_lost_events(trace):
    tr = trace([" 0)   cat-9    |               |  a() {", " 0)   cat-9    |               |    b() {",
                " 0)   cat-9    |               |      c() {", "CPU:0 [LOST 12 EVENTS]",
                " 0)   cat-9    |   0.2 us    |    x();", " 0)   cat-9    |   5.0 us    |  }"])
    s = by_func(tr)
    g = tr.gaps.collect()
    assert len(g) == 1 and g[0]["lost"] == 12 and g[0]["ts_us"] == s["x"]["start_us"]
    assert all(s[f]["flags"] & S.GAP for f in "abc") and s["b"]["flags"] & S.UNCLOSED
    assert not s["x"]["flags"] & S.GAP
    assert s["x"]["parent_id"] == s["a"]["span_id"] and s["a"]["dur_us"] == 5


def test_banners_and_migration(trace):
    tr = trace([" 0)               |  schedule() {", " ------------------------------------------",
                " 0)    foo-42     =>    <idle>-0   ", " ------------------------------------------",
                " 0)   0.5 us    |  idle_thing();", " 2)    <idle>-0   =>    foo-42   ",
                " 2)   80.0 us   |  } /* schedule */"])
    s = by_func(tr)
    assert s["schedule"]["task_key"] == "42" and s["schedule"]["dur_us"] == 80
    assert s["schedule"]["flags"] & (S.ORPHAN | S.UNCLOSED) == 0
    assert tr.switches.count() == 2 and s["idle_thing"]["task_key"] == "0/0"
    assert {r["name"] for r in tr.tracks.collect()} == {"foo 42", "idle/0"}


def test_old_interrupt_markers(trace):
    s = by_func(trace([" 0)               |  f() {", " 0)   ==========> |", " 0)   1.0 us    |    smp_apic_timer_interrupt();",
                       " 0)   <========== |", " 0)   2.0 us    |    g();", " 0)   4.0 us    |  }"]))
    assert s["smp_apic_timer_interrupt"]["flags"] & S.IRQ and not s["g"]["flags"] & S.IRQ


def test_comment_event_and_switch(trace):
    tr = trace([
        "   1.000001 |   3)  ls-249   |               |  f() {",
        "   1.000002 |   3)  ls-249   |               |    /* sched_switch: prev_comm=ls prev_pid=249 prev_prio=120 prev_state=S ==> next_comm=swapper/3 next_pid=0 next_prio=120 */",
        "   1.000009 |   3)  ls-249   |   9.0 us    |  }"])
    e = tr.events.collect()
    assert len(e) == 1 and e[0]["name"] == "sched_switch" and e[0]["span_id"] == 0 and e[0]["fields"]["prev_state"] == "S"
    w = tr.switches.collect()
    assert len(w) == 1 and w[0]["next_key"] == "0/3"


def test_latency_lines(trace):
    s = by_func(trace(["     cat-177       3..... 8055us : mutex_unlock <-rb_simple_write", "     cat-177       3d.... 8059us : x <-y"]))
    assert s["x"]["start_us"] == 4 and s["mutex_unlock"]["caller"] == "rb_simple_write"
    assert s["x"]["flags"] == S.LEAF | S.NO_DUR


def test_trace_cmd(trace):
    tr = trace(["             cat-1234  [001]  5.000100: funcgraph_entry:                   |  vfs_read() {",
                "             cat-1234  [001]  5.000101: funcgraph_entry:        0.500 us   |    rw_verify_area();",
                "             cat-1234  [001]  5.000105: sched_wakeup:         comm=kworker pid=12",
                "             cat-1234  [001]  5.000110: funcgraph_exit:       + 10.000 us  |  }",
                "             cat-1234  [001]  5.000120: function:             do_sys_open <-- __x64_sys_openat"])
    s = by_func(tr)
    assert tr.meta.first()["source"] == "trace-cmd" and s["vfs_read"]["dur_us"] == 10 and tr.events.count() == 1
    assert s["do_sys_open"]["caller"] == "__x64_sys_openat"
    assert tr.events.first()["span_id"] == s["vfs_read"]["span_id"]


def test_garbage_never_fails(trace, lines):
    from spanloom.sources.tokens import token_table, unparsed_samples

    text = "hello world\n\x00\x01zzz\n 0) | |||\n}}}}\n12.3 | x"
    tr = trace(text)
    n = tr.meta.first()["counts"]["unparsed"]
    assert n > 0 and unparsed_samples(token_table(lines(text))).count() == n


def test_run_released_by_short_call(trace):
    # deeper run before `read {` that is longer than the call: the interrupt came before it
    s = by_func(trace([" 0)               |  vfs() {", " 0)   1.0 us    |      irq_enter_rcu();", " 0)   30.0 us   |      __sysvec_t();",
                       " 0)               |    read() {", " 0)   2.0 us    |      get();", " 0)   5.7 us    |    }", " 0)   40.0 us   |  }"]))
    assert s["__sysvec_t"]["parent_id"] == s["vfs"]["span_id"] and s["__sysvec_t"]["flags"] & S.IRQ
    assert s["get"]["parent_id"] == s["read"]["span_id"] and not s["read"]["flags"] & S.IRQ
    assert s["read"]["start_us"] == 31.0 and s["read"]["dur_us"] == 5.7


def test_run_kept_by_long_leaf(trace):
    s = by_func(trace([" 0)               |  vfs() {", " 0)   1.0 us    |      irq_enter_rcu();", " 0)   30.0 us   |      __sysvec_t();",
                       " 0)   59.5 us   |    unlock();", " 0)   60.0 us   |  }"]))
    assert s["__sysvec_t"]["parent_id"] == s["unlock"]["span_id"] and not s["unlock"]["flags"] & (S.LEAF | S.IRQ)
    assert s["unlock"]["dur_us"] == 59.5


def test_trailing_run_hoisted(trace):
    s = by_func(trace([" 0)               |  vfs() {", " 0)               |    up_read() {", " 0)   1.0 us    |      irq_enter_rcu();",
                       " 0)   30.0 us   |      __sysvec_t();", " 0)   0.2 us    |    }", " 0)   40.0 us   |  }"]))
    assert s["__sysvec_t"]["parent_id"] == s["vfs"]["span_id"] and s["up_read"]["dur_us"] == 0.2
    assert s["vfs"]["dur_us"] == 40
