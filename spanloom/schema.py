"""Flag bits, limits and column lists shared by every job."""

# --- fixed values: span flag bits ------------------------------------------
LEAF, UNCLOSED, ORPHAN, IRQ = 1, 2, 4, 8
HAS_RET, HAS_ARGS, GAP, NO_DUR = 16, 32, 64, 128

#: calls without a comparable duration (statistics)
UNTIMED = UNCLOSED | ORPHAN | NO_DUR
#: the stricter rule used when a typical peer is picked
UNTIMED_PEER = UNTIMED | GAP

# --- fixed values: outlier thresholds --------------------------------------
Z_MIN = 4.0
MAD_SCALE = 1.4826
SIGMA_FLOOR = 0.25
RATIO_MIN = 3.0
MAX_SHARE = 0.1
MIN_PEERS = 8
EXCESS_LO_US, EXCESS_HI_US, EXCESS_SHARE = 10.0, 50.0, 1e-5
RARE_PRESENCE = 0.05
BLAME_SHARE = 0.6
HIST_BUCKETS = 40

#: parent id stored in ordered windows for roots (tables keep NULL)
NO_PARENT = -1

#: columns every analysis job expects from a span table
SPAN_COLUMNS = [
    "trace_id", "span_id", "func", "start_us", "dur_us", "parent_id", "depth",
    "cpu", "task_key", "flags", "path", "func_path",
]
