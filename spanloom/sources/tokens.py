"""tokenize: one narrow projection from trace lines to typed columns.

Each line is classified on its own, by its first characters before any wide
pattern runs. Column patterns are applied once per line: the match is rewritten
to its groups with a separator and split, instead of one pattern run per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

_SEP = "\ue000"  # private-use separator for rewritten matches

# --- fixed values: line shapes (Java regular expressions) -------------------
RE_TRACER = r"^#\s*tracer:\s*(\S+)"
RE_RULE = r"^-+\s*$"
RE_LOST = r"^CPU:\s*(\d+)\s*\[LOST (\d+) EVENTS\]"
RE_MARKER = r"^(?:\d+\.\d+ *\| *)?(\d+)\)\s*(={10}>|<={10}) *\|"
RE_BANNER = r"^(?:\d+\.\d+ *\| *)?(\d+)\)\s*([^|]*?)-(\d+)\s+=> ([^|]*)-(\d+)\s*$"
RE_GRAPH_HEAD = r"^(?:\d+\.\d+ *\| *)?\d+\)[^|]*\|"
RE_GRAPH = (r"(?s)^(?:(\d+\.\d+) *\| *)?(\d+)\)(?: *([^|]*?\S-\d+) *\|)?(?: *([.0-9a-zA-Z]{1,6}) *\|)?"
            r"( *(?:[^\d\s|]? *(\d+(?:\.\d+)?) us|[+!#*@$]?) *\|)?(.*)$")
RE_BRACKET = r"(?s)^(.*?)-(\d+)\s+\[\s*(\d+)\s*\]\s+(?:(\S+)\s+)?(\d+(?:\.\d+)?):(?:\s+(.*))?$"
RE_LATENCY = r"(?s)^(.*?)-(\d+)\s+(\d+)(\S*)\s+(\d+)us\s*: (.*)$"
RE_EVENT = r"(?s)^([\w:.-]+?):(?:\s+(.*))?$"
RE_FN = r"^([^\s]+?)(?:\s+<-+\s*(\S+))?\s*$"
RE_SPLIT_TASK = r"(?s)^(.*)-(\d+)$"
RE_SWITCH = r"prev_comm=(.*?) prev_pid=(\d+).*?==> next_comm=(.*?) next_pid=(\d+)"
RE_CMD_DUR = r"^[+!#*@$\s]*(\d+(?:\.\d+)?)"
RE_CALL = r"^([^ (;{]+)\("


def _groups(c: Column, pattern: str, n: int) -> Column:
    """Groups 1..n of an anchored pattern as one array (empty strings for unmatched groups)."""
    return F.split(F.regexp_replace(c, pattern, _SEP.join(f"${k}" for k in range(1, n + 1))), _SEP, -1)


def _nn(c: Column) -> Column:
    return F.when(c != "", c)


def tokenize(lines: DataFrame) -> DataFrame:
    """Add token columns to (trace_id, ..., value); keeps every input column but ``value``.

    Every line gives exactly one row; ``kind`` is header, rule, blank, lost, banner,
    marker, event, open, leaf, close, fn or unparsed. Unreadable lines keep their text.
    """
    keep = [c for c in lines.columns if c != "value"]
    d = lines.withColumn("_t", F.regexp_replace(F.translate("value", _SEP, "�"), "^[ \t]+", ""))
    t = F.col("_t")
    c1 = F.substring(t, 1, 1)
    digit = c1.between("0", "9")
    shape = (F.when(F.trim(t, F.lit(" \t")) == "", "blank").when(c1 == "#", "header")
             .when((c1 == "-") & t.rlike(RE_RULE), "rule")
             .when((c1 == "C") & t.rlike(RE_LOST), "lost")
             .when(digit & t.rlike(RE_GRAPH_HEAD), F.when(t.rlike(RE_MARKER), "marker").otherwise("graph"))
             .when(digit & t.rlike(RE_BANNER), "banner")
             .when(t.rlike(RE_BRACKET), "bracket").when(t.rlike(RE_LATENCY), "latency").otherwise("bare"))
    d = d.withColumn("_shape", shape)
    sh = F.col("_shape")
    d = d.withColumn("_g", F.when(sh == "graph", _groups(t, RE_GRAPH, 7))
                     .when(sh == "bracket", _groups(t, RE_BRACKET, 6))
                     .when(sh == "latency", _groups(t, RE_LATENCY, 6))
                     .when(sh == "banner", _groups(t, RE_BANNER, 5))
                     .when(sh == "marker", _groups(F.regexp_extract(t, RE_MARKER, 0), RE_MARKER, 2))
                     .when(sh == "lost", _groups(F.regexp_extract(t, RE_LOST, 0), RE_LOST, 2)))
    g = lambda k: _nn(F.get("_g", F.lit(k - 1)))
    is_tail = sh.isin("bracket", "latency")
    # what follows the timestamp of a bracket or latency line
    d = d.withColumn("_rest", F.when(is_tail, F.ltrim(F.coalesce(F.get("_g", F.lit(5)), F.lit("")))))
    d = d.withColumn("_ev", F.when(is_tail & F.col("_rest").rlike(RE_EVENT), F.regexp_extract("_rest", RE_EVENT, 1)))
    fg = F.coalesce(F.col("_ev").isin("funcgraph_entry", "funcgraph_exit"), F.lit(False))
    after_ev = F.regexp_extract("_rest", RE_EVENT, 2)
    d = d.withColumns({
        "_fg": fg,
        "_body": F.when(fg, after_ev).when(F.col("_ev").isNotNull(), F.trim(after_ev)).otherwise(F.trim("_rest")),
    })
    bar = F.instr("_body", "|")
    text = (F.when(sh == "graph", F.get("_g", F.lit(6)))
            .when(F.col("_fg") & (bar > 0), F.expr("substring(_body, instr(_body, '|') + 1)"))
            .when(sh == "bare", F.translate("value", _SEP, "�")))
    proc = F.when(sh == "graph", g(3))
    d = d.withColumns({
        "_text": text,
        "abs_us": F.when(sh == "graph", g(1).cast("decimal(24,9)").cast("double") * 1e6)
        .when(sh == "bracket", g(5).cast("decimal(24,9)").cast("double") * 1e6)
        .when(sh == "latency", g(5).cast("double")),
        "cpu": F.when(sh == "graph", g(2)).when(is_tail, g(3)).when(sh.isin("lost", "marker", "banner"), g(1)).try_cast("int"),
        "comm": F.when(sh == "graph", _nn(F.trim(F.regexp_extract(proc, RE_SPLIT_TASK, 1)))).when(is_tail, F.trim(g(1))),
        "pid": F.when(sh == "graph", _nn(F.regexp_extract(proc, RE_SPLIT_TASK, 2))).when(is_tail, g(2)).try_cast("int"),
        "lat_flags": F.when(sh.isin("graph", "latency", "bracket"), g(4)),
        "has_dur_col": F.when(sh == "graph", F.get("_g", F.lit(4)) != "").otherwise(False),
        "dur_us": F.when(sh == "graph", g(6).try_cast("double"))
        .when(F.col("_fg"), _nn(F.regexp_extract(F.substring_index("_body", "|", 1), RE_CMD_DUR, 1)).try_cast("double")),
        "lost": F.when(sh == "lost", g(2)).try_cast("bigint"),
        "irq_mark": F.when(sh == "marker", g(2) == "==========>"),
        "tracer": F.when(sh == "header", _nn(F.regexp_extract(t, RE_TRACER, 1))),
        "prev_comm": F.when(sh == "banner", F.trim(F.get("_g", F.lit(1)))), "prev_pid": F.when(sh == "banner", g(3)).try_cast("int"),
        "next_comm": F.when(sh == "banner", F.trim(F.get("_g", F.lit(3)))), "next_pid": F.when(sh == "banner", g(5)).try_cast("int"),
    })
    # the call text: indent, then `name(`, `}`, a comment event or a marker
    d = d.withColumn("_b", F.ltrim("_text"))
    b = F.col("_b")
    lead = F.length("_text") - F.length("_b")
    pad = F.when(sh == "bare", 0).otherwise(2)
    d = d.withColumns({
        "_head": F.rtrim(F.substring_index(b, " /*", 1)),
        "_cm": F.when(F.instr(b, "/*") > 0, F.expr("substring_index(substring(_b, instr(_b, '/*') + 2), '*/', 1)")),
        "_name": _nn(F.regexp_extract(b, RE_CALL, 1)),
    })
    ends = F.substring(F.col("_head"), -1, 1)
    bare_ok = (F.substring(b, 1, 1) == "}") | F.substring(F.rtrim(b), -1, 1).isin(";", "{") | (
        F.rtrim(b).endswith("*/") & b.rlike(r"^[\w.$]+\("))
    call_kind = (
        F.when((sh == "bare") & ~bare_ok, "unparsed")
        .when(b.startswith("/*") & (F.instr(b, ":") > 0) & (sh != "bare"), "event")
        .when(b.startswith("==========>") | b.startswith("<=========="), "marker")
        .when(b.startswith("}"), "close")
        .when(F.col("_name").isNotNull() & (ends == "{"), "open")
        .when(F.col("_name").isNotNull() & (ends == ";"), "leaf").otherwise("unparsed"))
    fn_ok = F.col("_body").rlike(RE_FN)
    kind = (F.when(sh.isin("graph", "bare") | F.col("_fg"), F.coalesce(call_kind, F.lit("unparsed")))
            .when(is_tail & F.col("_ev").isNotNull() & (F.col("_ev") != "function"), "event")
            .when(is_tail, F.when(fn_ok & (F.col("_body") != ""), "fn").otherwise("unparsed"))
            .otherwise(sh))
    d = d.withColumn("kind", kind)
    k = F.col("kind")
    call = k.isin("open", "leaf", "close")
    in_text = sh.isin("graph", "bare") | F.col("_fg")
    plain = F.regexp_replace(F.col("_cm"), r"(?<!\S)(?:ret=\S*|=\s+\S+|<-\S*)", " ")
    ret_text = F.when(call & F.col("_cm").isNotNull(), _nn(F.regexp_extract("_cm", r"(?:^|\s)(?:ret=|=\s+)(\S+)", 1)))
    d = d.withColumns({
        "func": F.when(k.isin("open", "leaf"), F.col("_name"))
        .when(k == "close", _nn(F.substring_index(F.trim(F.regexp_replace(F.coalesce(plain, F.lit("")), r"\s+", " ")), " ", 1)))
        .when(k == "fn", F.regexp_extract("_body", RE_FN, 1)),
        "caller": F.when(k == "fn", _nn(F.regexp_extract("_body", RE_FN, 2))),
        "indent": F.when(call, F.greatest(F.lit(0), F.floor((lead - pad) / 2)).cast("int")),
        "has_args": k.isin("open", "leaf") & ~F.expr("substring(_b, length(_name) + 2, 1) <=> ')'"),
        "ret_text": ret_text,
        "retaddr": F.when(call, _nn(F.regexp_extract("_cm", r"(?:^|\s)<-(\S+)", 1))),
        "event_name": F.when(k == "event", F.when(in_text, F.trim(F.expr("substring(_b, 3, instr(_b, ':') - 3)"))).otherwise(F.col("_ev"))),
        "payload": F.when(k == "event", F.when(
            in_text, F.trim(F.regexp_replace(F.expr("substring(_b, instr(_b, ':') + 1)"), r"\*/(?!.*\*/).*$", "")))
            .otherwise(F.col("_body"))),
        "irq_mark": F.when((k == "marker") & (sh != "marker"), b.startswith("==========>")).otherwise(F.col("irq_mark")),
        "text": F.when(k == "unparsed", F.col("value")),
    })
    sw = (k == "event") & (F.col("event_name") == "sched_switch") & F.col("payload").rlike(RE_SWITCH)
    part = lambda i: F.when(sw, F.regexp_extract("payload", RE_SWITCH, i))
    d = d.withColumns({
        "ret": parse_ret(F.col("ret_text")),
        "prev_comm": F.coalesce("prev_comm", part(1)), "prev_pid": F.coalesce("prev_pid", part(2).try_cast("int")),
        "next_comm": F.coalesce("next_comm", part(3)), "next_pid": F.coalesce("next_pid", part(4).try_cast("int")),
    })
    return d.select(
        *keep, "kind", F.col("_shape").alias("shape"), "abs_us", "cpu", "comm", "pid", "lat_flags", "has_dur_col",
        "dur_us", "indent", "func", "caller", "has_args", "ret_text", "ret", "retaddr", "event_name", "payload",
        "lost", "irq_mark", "tracer", "prev_comm", "prev_pid", "next_comm", "next_pid",
        (F.col("_fg") | F.coalesce(F.col("_ev") == "function", F.lit(False))).alias("trace_cmd"), "text")


def token_table(lines: DataFrame) -> DataFrame:
    """``tokenize`` written as a table. Filter this, not the projection: a filter pushed
    down through the projection would repeat its patterns."""
    return cut(tokenize(lines))


def parse_ret(c: Column) -> Column:
    """Return value text as a number: hexadecimal, signed decimal, else NULL; exact up to 64 bits."""
    return (F.when(c.rlike("(?i)^0x[0-9a-f]+$"), F.conv(F.substring(c, 3, 64), 16, 10))
            .when(c.rlike(r"^-?\d+$"), c)).try_cast("decimal(20,0)")


def quarantine(tokens: DataFrame) -> DataFrame:
    """Lines no rule understood, with their place in the file."""
    return tokens.where(F.col("kind") == "unparsed").select("trace_id", "line_no", "text")


def unparsed_samples(tokens: DataFrame, limit: int = 20, width: int = 500) -> DataFrame:
    """The first unreadable lines of every trace, cut to ``width`` characters for display."""
    from ..operators.ordered import top_rows

    bad = quarantine(tokens).withColumn("text", F.substring("text", 1, width))
    return top_rows(bad, ["trace_id"], ["line_no"], limit, out="sample")


def event_fields(payload: Column) -> Column:
    """``key=value`` pairs of an event payload as a map; quotes and brackets stay together."""
    pat = r"([A-Za-z_][\w.]*)=(\"[^\"]*\"|\[[^\]]*\]|\S+)"
    val = F.transform(F.regexp_extract_all(payload, F.lit(pat), F.lit(2)),
                      lambda v: F.regexp_replace(v, r"\*/$", ""))
    return F.map_from_arrays(F.regexp_extract_all(payload, F.lit(pat), F.lit(1)), val)
