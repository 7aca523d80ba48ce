"""Files, gzip, numbering, streams, details, categories, timeline data."""

import gzip

import pytest
from pyspark.sql import functions as F

from spanloom import schema as S
from spanloom.functions.categories import category
from spanloom.functions.words import errno_of, us
from spanloom.operators import quality, search, timeline
from spanloom.operators.ordered import order_stats, running
from spanloom.sources.lines import number_lines, read_gzip_sniffed, read_lines, stream_lines
from tests.synthetic import Builder


def test_byte_ranges_and_crlf(spark, tmp_path):
    text = " 0)  kätzchen-7  |   0.5 us    |  a();\r\n 0)  kätzchen-7  |   0.5 us    |  b();\n\nlast"
    (tmp_path / "x.trace").write_bytes(text.encode())
    rows = read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    raw = text.encode()
    assert [r["line_no"] for r in rows] == [0, 1, 2, 3]
    assert rows[0]["value"].endswith("a();") and raw[rows[1]["byte_start"]:rows[1]["byte_end"]].decode() == " 0)  kätzchen-7  |   0.5 us    |  b();\n"
    assert rows[-1]["byte_end"] == len(raw)


def test_numbering_over_many_blocks(spark, tmp_path):
    for f in ("a", "b"):
        (tmp_path / f"{f}.trace").write_text("".join(f"line {f} {i}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, str(tmp_path)).select("line_no", "value").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 6000 and all(r["value"].endswith(f" {r['line_no']}") for r in rows)


def test_gzip_by_magic_bytes(spark, tmp_path):
    body = "".join(f"l{i}\n" for i in range(70000)) + "end"
    (tmp_path / "noext").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "plain").write_text("not gzip")
    df = read_gzip_sniffed(spark, str(tmp_path))
    assert df.count() == 70001
    last = df.orderBy(F.desc("line_no")).first()
    assert last["value"] == "end" and last["byte_end"] == len(body)


def test_running_equals_one_window(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id", F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"), (F.col("id") / 17).cast("int").alias("c"))
    got = {r["id"]: r for r in running(df, ["k"], "c", ["id"], [("s", "sum", "id"), ("m", "max", "v"), ("p", "prev", "v"), ("n", "next", "v"), ("t", "total", "id")]).collect()}
    for i in range(500):
        mine = [j for j in range(500) if j % 3 == i % 3]
        seen = [j for j in mine if j < i and j % 7 == 0]
        after = [j for j in mine if j > i and j % 7 == 0]
        r = got[i]
        assert r["s"] == sum(j for j in mine if j < i) and r["t"] == sum(mine)
        assert r["p"] == (seen[-1] if seen else None) and r["n"] == (after[0] if after else None)
        assert r["m"] == max(seen + ([i] if i % 7 == 0 else []), default=None)


def test_order_stats_exact(spark):
    vals = [(i * 7919 % 1000) / 10 for i in range(1001)]
    df = spark.createDataFrame([("a", float(v)) for v in vals], "k string, v double")
    r = order_stats(df, ["k"], "v", {"mid": F.floor(F.col("n") / 2), "top": F.col("n") - 1, "low": F.lit(0)}).first()
    s = sorted(vals)
    assert (r["n"], r["mid"], r["top"], r["low"]) == (1001, s[500], s[-1], s[0])


# fixed values: names and their subsystems
SUBSYSTEMS = {
    "entry": "__x64_sys_read x64_sys_call do_syscall_64 trace_syscall_enter task_work_run exit_to_user_mode_loop",
    "irq": "kvm_steal_clock sched_clock_cpu ktime_get hrtimer_interrupt tick_sched_timer __sysvec_apic_timer_interrupt irq_exit_rcu",
    "fs": "__fput filp_close mntput dput.part.0 vfs_read current_time locks_remove_posix",
    "block": "submit_bio blk_mq_submit_bio virtqueue_add_sgs I_BDEV blkdev_read_iter",
    "net": "tcp_sendmsg __skb_clone",
    "mm": "__zap_vma_range folio_remove_rmap_ptes __tlb_remove_folio_pages obj_cgroup_charge filemap_read free_swap_cache set_pte_range",
    "sync": "_raw_spin_lock mutex_unlock __rcu_read_lock up_read down_write",
    "sched": "psi_task_change __schedule io_schedule",
    "other": "security_inode_permission bpf_lsm_file_permission",
}


def test_categories(spark):
    want = {n: c for c, names in SUBSYSTEMS.items() for n in names.split()}
    assert len(want) == 44
    got = spark.createDataFrame([(n,) for n in want], "func string").select("func", category(F.col("func")).alias("c")).collect()
    assert {r.func: r.c for r in got} == want
    own = spark.createDataFrame([("a_b",)], "func string").select(category(F.col("func"), [("net", "^a"), ("fs", "b$")])).first()[0]
    assert own == "net"


def test_words_and_errno(spark):
    vals = [(0.0, "0 ns"), (0.9996, "1.00 µs"), (0.25, "250 ns"), (12.34, "12.3 µs"), (1234.0, "1.23 ms"), (2.5e6, "2.50 s")]
    got = spark.createDataFrame([(v,) for v, _ in vals], "v double").select(us(F.col("v"))).collect()
    assert [r[0] for r in got] == [t for _, t in vals]
    e = spark.createDataFrame([("0xfffffffffffffffe",), ("0x10",), ("-22",)], "r string").select(errno_of(F.col("r"))).collect()
    assert [r[0] for r in e] == [2, None, 22]


def test_split_args(spark):
    r = spark.range(1).select(search.split_args(F.lit("file=0xffff8881, buf=(ptr, 2), count=4096"))).first()[0]
    assert r == ["file=0xffff8881", "buf=(ptr, 2)", "count=4096"]


def test_utilisation_and_pins(spark):
    b = Builder()
    for i in range(10):
        b.ts = 2.0 * i
        b.leaf("a", 1.0)
    b.ts = 100.0
    b.leaf("b", 10.0, cpu=1)
    t = b.trace_tables(spark)
    u = {(r["cpu"], r["bin"]): r["busy"] for r in timeline.cpu_utilisation(t.spans, t.meta, 110).collect()}
    assert u[(1, 105)] == pytest.approx(1) and (1, 50) not in u and u[(0, 0)] == pytest.approx(1) and u.get((0, 1), 0) == pytest.approx(0)
    o = spark.createDataFrame([("p", i, d) for i, d in enumerate((5.0, 1.0, 9.0, 2.0))], "trace_id string, span_id bigint, dur_us double")
    x = spark.createDataFrame([("p", i, v) for i, v in enumerate((10.2, 50.0, 9.8, 10.4))], "trace_id string, span_id bigint, start_us double")
    m = spark.createDataFrame([("p", 100.0)], "trace_id string, duration_us double")
    pins = timeline.outlier_pins(o, x, m, 100).orderBy("x").collect()
    assert [(p["members"], p["slowest_span"]) for p in pins] == [(3, 2), (1, 1)]


def test_violations(spark):
    b = Builder()
    b.open("p")
    b.leaf("c", 2.0)
    b.leaf("d", 2.0)
    b.close()
    s = b.trace_tables(spark).spans.drop("byte_start", "byte_end")
    assert quality.violations(s).count() == 0
    bad = s.withColumn("start_us", F.when(F.col("func") == "d", 1.0).otherwise(F.col("start_us")))
    assert {r["rule"] for r in quality.violations(bad).collect()} == {"overlaps sibling"}


def test_live_spans(spark, tmp_path):
    from spanloom.streaming.live import live_spans

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text(" 0)  cat-5  |               |  f() {\n 0)  cat-5  |   1.0 us    |    g();\n 0)  cat-5  |   3.0 us    |  }\n"
                               " 0)  cat-5  |               |  h() {\n 0)  cat-5  |   2.0 us    |  k();\n")
    q = (live_spans(stream_lines(spark, str(src))).writeStream.format("memory").queryName("live").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).start())
    try:
        # a query with processing-time timeouts never goes idle: wait for its rows
        for _ in range(90):
            if spark.table("live").count() >= 4 or q.awaitTermination(1):
                break
        rows = {r["func"]: r for r in spark.table("live").collect()}
    finally:
        q.stop()
    assert rows["g"]["func_path"] == ["f", "g"] and rows["f"]["dur_us"] == 3.0
    assert rows["h"]["flags"] & S.UNCLOSED and rows["k"]["depth"] == 0
