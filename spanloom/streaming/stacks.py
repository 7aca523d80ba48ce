"""Call stacks of one task, fed with its lines in order.

The parent of most calls is known when they are entered. Two kinds wait: calls printed deeper than the call they lie
in (the next shallower line may take them over), and interrupt runs (they move out of a call whose printed duration can't
hold them). They are held, with what lies below them, until that line or the end of the call decides.
"""

from __future__ import annotations

from .. import schema as S

EPS = 1e-6


def call(row: dict, shape: str, top: dict | None) -> dict:
    """A call from the line that shows it. It is ``risky`` while its parent may still change."""
    indent = row["indent"] if row["indent"] is not None else (top["indent"] + 1 if top else 0)
    jump = shape in ("call", "leaf") and top is not None and indent > top["indent"] + 1
    irq = shape != "flat" and (bool(row["irq"]) or jump)
    flags = {"leaf": S.LEAF, "flat": S.LEAF | S.NO_DUR, "orphan": S.ORPHAN}.get(shape, 0)
    flags |= (S.HAS_RET if row["has_ret"] and shape != "call" else 0) | (S.HAS_ARGS if row["has_args"] else 0)
    risky = shape != "flat" and (indent > 0 if top is None else irq or indent > top["indent"] + 1)
    return {"id": row["line_no"], "func": row["func"] or "?", "indent": indent, "start": row["abs_us"], "dur": None if shape == "call" else row["dur_us"],
            "flags": flags, "shape": shape, "risky": risky, "irq": irq, "printed": shape != "call", "lead": False, "moved": None, "kids": []}


class Stack:
    """Open calls of a task (``open``), what is held below them (``kids``) and below no call (``loose``)."""

    def __init__(self, state: dict | None = None):
        self.open: list[dict] = (state or {}).get("open", [])
        self.loose: list[dict] = (state or {}).get("loose", [])
        self.out: list[tuple] = []

    def state(self) -> dict:
        return {"open": self.open, "loose": self.loose}

    def line(self, row: dict) -> None:
        kind = row["kind"]
        if kind == "lost":
            for c in self.open:
                c["flags"] |= S.GAP
            return
        if kind == "fn":
            self._finished(call(row, "flat", self._top()))
            return
        indent = row["indent"]
        while self.open and self.open[-1]["indent"] >= indent + (kind == "close"):
            self._end(unclosed=True)
        if kind == "close" and self.open and self.open[-1]["indent"] == indent:
            c = self.open[-1]
            c["printed"] = row["dur_us"] is not None
            wait = 0.0 if row["abs_us"] is None or c["start"] is None else max(0.0, row["abs_us"] - c["start"])
            c["dur"] = row["dur_us"] if c["printed"] else wait
            c["flags"] |= S.HAS_RET if row["has_ret"] else 0
            if c["func"] == "?" and row["func"]:
                c["func"] = row["func"]
            self._end(unclosed=False)
            return
        c = call(row, {"open": "call", "leaf": "leaf", "close": "orphan"}[kind], self._top())
        self._take(c)
        if kind == "open":
            self.open.append(c)
        else:
            self._settle(c)
            self._finished(c)

    def give_up(self) -> None:
        """The task is silent: its open calls never return, and nothing is held any longer."""
        while self.open:
            self._end(unclosed=True)
        for c in self.loose:
            self._emit(c)
        self.loose = []

    # ---- inside ----

    def _top(self) -> dict | None:
        return self.open[-1] if self.open else None

    def _held(self) -> list[dict]:
        return self.open[-1]["kids"] if self.open else self.loose

    def _take(self, c: dict) -> None:
        """Calls printed deeper just before ``c`` become its first children."""
        held = self._held()
        mine = [k for k in held if k["shape"] != "flat" and k["indent"] > c["indent"] and k["moved"] is None]
        # a run that moved out of a call stays next to it
        more = mine
        while more:
            ids = {k["id"] for k in more}
            more = [k for k in held if k["moved"] in ids and k not in mine]
            mine = sorted(mine + more, key=lambda k: k["id"])
        if mine:
            held[:] = [k for k in held if k not in mine]
            c["kids"] = mine + c["kids"]
            if c["shape"] != "orphan":
                for k in mine:
                    k["lead"] = True
            c["flags"] &= ~S.LEAF

    def _end(self, unclosed: bool) -> None:
        c = self.open.pop()
        if unclosed:
            c["shape"], c["dur"], c["printed"] = "unclosed", None, False
            c["flags"] |= S.UNCLOSED
        else:
            self._settle(c)
        self._finished(c)

    def _settle(self, c: dict) -> None:
        """Runs that the printed duration of ``c`` can't hold go before it (``lead``) or after it (trailing)."""
        while c["shape"] in ("call", "leaf") and c["printed"] and c["dur"] is not None:
            kids, done = c["kids"], c.get("load", 0.0)
            lead = [k for k in kids if k["lead"]]
            plain = max([k["id"] for k in kids if k["lead"] or not k["irq"]] + [c.get("plain", -1)])
            tail = [k for k in kids if not k["lead"] and k["irq"] and k["id"] > plain]
            weight = lambda group: sum(k["dur"] or 0.0 for k in group)
            load = weight(kids) + done
            if load <= c["dur"] + EPS or not (lead or tail):
                return
            tail_fits, lead_fits = load - weight(tail) <= c["dur"] + EPS, load - weight(lead) <= c["dur"] + EPS
            hoist = bool(tail) and not (not tail_fits and lead and lead_fits)
            free = bool(lead) and not (tail and tail_fits)
            moved = (lead if free else []) + (tail if hoist else [])
            c["kids"] = [k for k in kids if k not in moved]
            if not c["kids"] and c["shape"] == "leaf":
                c["flags"] |= S.LEAF
            for k in moved:
                k["lead"], k["moved"] = c["lead"], c["id"]
            self._held().extend(moved)

    def _finished(self, c: dict) -> None:
        """``c`` is complete: emit it if its parent is certain, else hold it."""
        up, held = self._top(), self._held()
        if not c["risky"] and not c["lead"]:
            if up is not None:
                up["plain"] = max(up.get("plain", -1), c["id"])
            if all(not o["risky"] for o in self.open):
                if up is not None and c["shape"] != "flat":
                    # runs before a plain call are no longer trailing, and nothing shallower can follow inside this parent
                    for k in [k for k in held if not k["lead"] and k["id"] < c["id"]]:
                        held.remove(k)
                        self._emit(k)
                self._emit(c)
                return
        held.append(c)
        held.sort(key=lambda k: k["id"])

    def _emit(self, c: dict) -> None:
        up = self._top()
        if up is not None:  # what the end of the parent needs of a child that is gone
            up["load"] = up.get("load", 0.0) + (c["dur"] or 0.0)
        self._write(c, up["id"] if up else None, [o["func"] for o in self.open], any(o["irq"] for o in self.open))

    def _write(self, c: dict, parent: int | None, names: list[str], irq: bool) -> None:
        irq = irq or c["irq"]
        names = [*names, c["func"]]
        self.out.append((c["id"], c["func"], parent, len(names) - 1, c["start"], c["dur"], c["flags"] | (S.IRQ if irq else 0), names))
        for k in c["kids"]:
            self._write(k, c["id"], names, irq)
