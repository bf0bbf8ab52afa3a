"""`simulate.run_engine` over long series without a task that holds one.

Quotes and arrivals of orders are put in one order (`ordering.number_rows`) and packed into blocks of rows. An order waits
for the next quote only, which opens, expires or refuses it, so what a block needs from before it is the first order since
the last quote, and when, at what price and to which side the open position was opened. A block's map gives its end for
every such start: closes are looked up by the time a position was opened, the trades that follow one another inside the
block are followed by doubling. Maps are composed in order, a row a block at a time; then blocks run from their starts.
Cash is added up trade by trade and the peak by stretches between trades in the same way, so floating-point results are
those of the plain engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.simulate import ExecutionRules, Scenario
from tidemark.operators import ordering as O
from tidemark.session import ship, small_side, written

#: Events (quotes and orders) of a block.
BLOCK_ROWS = 32_768
_PACKED = {"at": "f8", "ts": "f8", "quote": "i1", "toward": "i1", "bid": "f8", "ask": "f8"}
_NAN = float("nan")
FILL = "ts double, kind string, order long, side long, price double"
MARK = "ts double, equity double, drawdown double, position long"
_MAP = (
    "kept long, own_at double, own_ts double, own_side long, own_k long, next_at double, next_ts double, next_side long, next_k long, "
    "quotes long, t double, bid double, ask double, last double, until binary, place binary, opened binary, sides binary, entries binary"
)
_START = "k0 long, lead_at double, lead_ts double, lead_side long, lead_k long, opened double, side long, entry double"
_OPS = "fills long, opens long, deltas binary, tops binary, rest double"
_CASH = "cash double, peak double, equity double"
_NO_LEAD = (_NAN, _NAN, 0, -1)


def _full(df: DataFrame, keys: list[str], schema: str) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + list(T._parse_datatype_string(schema).fields))


def _pack(ticks: DataFrame, series: list[str], latency: float, block_rows: int) -> DataFrame:
    """A row for each block of quotes and order arrivals in time, arrivals after quotes of the same time."""
    ts = F.coalesce(F.unix_micros("timestamp"), F.lit(-(2**63))) / 1e6
    timed = F.col("timestamp").isNotNull()
    both = F.array(F.struct(F.lit(1).alias("quote"), ts.alias("at")), F.when(timed, F.struct(F.lit(0).alias("quote"), (ts + latency).alias("at"))))
    events = ticks.select(*series, "timestamp", "seq", "bid", "ask", F.col("side").alias("toward"), ts.alias("ts"), F.explode(F.array_compact(both)).alias("e"))
    events = events.select(*series, "seq", "bid", "ask", "toward", "ts", "e.at", "e.quote", (-F.col("e.quote")).alias("after"))
    # Ticks without a time come after all others, as they do in pandas.
    day = F.when(F.col("ts") == -(2.0**63) / 1e6, F.lit(2**62)).otherwise(F.floor(F.col("at") / 86_400))
    numbered = O.number_rows(events, series, ["at", "after", "ts", "seq"], day)
    keyed = numbered.withColumn(O.BLOCK, F.floor(F.col(O.INDEX) / block_rows)).drop("seq", "after")
    full = _full(keyed, [*series, O.BLOCK], ", ".join(f"{c} binary" for c in _PACKED) + ", orders long")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(O.INDEX)
        out = frame.iloc[:1][[*series, O.BLOCK]].copy()
        for c, kind in _PACKED.items():
            out[c] = [frame[c].to_numpy(kind).tobytes()]
        return out.assign(orders=int((frame["quote"] == 0).sum()))

    held = written(keyed.groupBy(*series, O.BLOCK).applyInPandas(pack, full))
    before = F.sum("orders").over(W.partitionBy(*series, F.lit(0)).orderBy(O.BLOCK).rowsBetween(W.unboundedPreceding, -1))
    counts = held.select(*series, O.BLOCK, "orders").select(*series, O.BLOCK, F.coalesce(before, F.lit(0)).alias("first"))
    return O.beside(held.drop("orders"), small_side(counts), [*series, O.BLOCK])


def _finite(df: DataFrame, *columns: str) -> DataFrame:
    """Infinities become null at the border to tables."""
    return df.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in columns})


class _Block:
    """A block's quotes, its orders, and the first order that waits for each quote, under a scenario."""

    def __init__(self, row: dict, scenario: Scenario, rules: ExecutionRules):
        x = {c: np.frombuffer(row[c], kind) for c, kind in _PACKED.items()}
        quote = x["quote"] == 1
        bid, ask = scenario.widen(x["bid"], x["ask"])
        lost = np.zeros(len(quote), bool) if scenario.outage is None else quote & (x["ts"] >= scenario.outage[0]) & (x["ts"] < scenario.outage[1])
        if scenario.missed > 0:
            # The draws of the whole series' generator for this block's orders.
            draws = np.random.PCG64(scenario.seed).advance(int(row["first"]))
            lost[~quote] = np.random.Generator(draws).random(int((~quote).sum())) < scenario.missed
        quote, x = quote[~lost], {c: v[~lost] for c, v in x.items()}
        self.rules, self.bid, self.ask = rules, bid[~lost][quote], ask[~lost][quote]
        self.t = x["ts"][quote]
        self.at, self.ts, self.side = x["at"][~quote], x["ts"][~quote], x["toward"][~quote].astype("i8")
        # The number of quotes before each order is the quote it waits for.
        self.waits = np.cumsum(quote)[~quote]
        self.leads = np.r_[True, self.waits[1:] != self.waits[:-1]][: len(self.waits)]
        self.n, self.kept = len(self.t), len(self.at)
        # Ticks without a time close nothing.
        self.order_t = np.maximum.accumulate(self.t)
        self.lead = np.full(self.n, -1)
        k = np.flatnonzero(self.leads & (self.waits < self.n))
        self.lead[self.waits[k]] = k

    def after(self) -> int:
        """The first order after the last quote, or -1."""
        k = np.flatnonzero(self.leads & (self.waits == self.n))
        return int(k[0]) if len(k) else -1

    def openable(self) -> tuple[np.ndarray, np.ndarray]:
        """By each quote's own first order: whether it is taken, and whether it has expired then."""
        at = np.where(self.lead >= 0, self.at[self.lead] if self.kept else _NAN, _NAN)
        taken = at < self.t
        return taken, taken & (self.t >= at + self.rules.expiry)

    def price(self, rows: np.ndarray, side: np.ndarray) -> np.ndarray:
        """What is paid or got at quotes to go to ``side``."""
        return np.where(side > 0, self.ask[rows], self.bid[rows]) + side * self.rules.slippage

    def closes(self, rows: np.ndarray) -> np.ndarray:
        """The quote that closes what was opened at each of ``rows``; their number if none."""
        values, at = np.unique(self.order_t, return_index=True)
        at, opened, h = np.r_[at, self.n], self.t[rows], self.rules.holding
        i = np.searchsorted(values, opened + h)
        ends = np.r_[values, np.inf]
        while (low := (i > 0) & (ends[np.maximum(i - 1, 0)] - opened >= h)).any():
            i = i - low
        while (high := ends[i] - opened < h).any():
            i = i + high
        return np.maximum(at[i], rows + 1)

    def trades(self, start) -> tuple[list[tuple[int, bool, int, float]], np.ndarray, np.ndarray, np.ndarray]:
        """Quotes where a position is opened (true) or closed, its side and entry price; the first quote's order is the one
        that came in, if any. Also which quotes take an order, and whether it has expired, and its side."""
        taken, expired = self.openable()
        sides = np.where(self.lead >= 0, self.side[self.lead] if self.kept else 0, 0)
        if self.n and start.lead_at == start.lead_at:
            taken[0] = start.lead_at < self.t[0]
            expired[0], sides[0] = taken[0] and self.t[0] >= start.lead_at + self.rules.expiry, start.lead_side
        free = np.flatnonzero(taken & ~expired)
        entries, closes = self.price(free, sides[free]), self.closes(free)
        follow = np.searchsorted(free, closes, side="right")
        out, j = [], 0
        if start.side:
            late = self.order_t - start.opened >= self.rules.holding
            late &= self.t == self.order_t
            c = int(late.argmax()) if late.any() else self.n
            if c < self.n:
                out.append((c, False, int(start.side), start.entry))
            j = int(np.searchsorted(free, c, side="right")) if c < self.n else len(free)
        while j < len(free):
            o, c = int(free[j]), int(closes[j])
            out.append((o, True, int(sides[o]), float(entries[j])))
            if c >= self.n:
                break
            out.append((c, False, int(sides[o]), float(entries[j])))
            j = int(follow[j])
        return out, taken, expired, sides

    def map(self) -> tuple:
        """This block's end for every start (`_MAP`)."""
        own = int(self.lead[0]) if self.n else self.after()
        nxt = self.after() if self.n else -1

        def order(k):
            return (float(self.at[k]), float(self.ts[k]), int(self.side[k]), k) if k >= 0 else _NO_LEAD

        empty = b""
        if not self.n:
            return (self.kept, *order(own), *order(-1), 0, _NAN, _NAN, _NAN, _NAN, *[empty] * 5)
        taken, expired = self.openable()
        free = np.flatnonzero(taken & ~expired)
        free = free[free > 0]
        side = self.side[self.lead[free]] if len(free) else np.zeros(0, "i8")
        entry, closes = self.price(free, side), self.closes(free)
        follow = np.searchsorted(free, closes, side="right")
        stays, ends = closes >= self.n, np.arange(len(free))
        ends = np.where(stays | (follow >= len(free)), ends, follow)
        while not np.array_equal(ends, further := ends[ends]):
            ends = further
        until = self.order_t[free - 1]
        # A start lies at or before the first quote, so later rows are not looked up.
        reached = (until - self.t[0] >= self.rules.holding) & (free > 1)
        most = int(reached.argmax()) + 1 if reached.any() else len(free)
        ends, until, place = ends[:most], until[:most], free[:most]
        opened = np.where(stays[ends], self.t[free[ends]], _NAN) if len(free) else np.zeros(0)
        arrays = (until, place.astype("i8"), opened, side[ends].astype("i8"), entry[ends])
        return (self.kept, *order(own), *order(nxt), self.n, float(self.t[0]), float(self.bid[0]), float(self.ask[0]), float(self.order_t[-1]), *[a.tobytes() for a in arrays])


def _advance(state: tuple, m, rules: ExecutionRules) -> tuple:
    """The state (`_START`) after a block, from the state before it and the block's map."""
    k0, *lead, opened, side, entry = state
    own = (m.own_at, m.own_ts, m.own_side, m.own_k + k0) if m.own_at == m.own_at else _NO_LEAD
    waiting = tuple(lead) if lead[0] == lead[0] else own
    if not m.quotes:
        return (k0 + m.kept, *waiting, opened, side, entry)
    at_first = False
    if side:
        if m.t - opened >= rules.holding:
            side = 0
    elif waiting[0] < m.t and not m.t >= waiting[0] + rules.expiry:
        side, opened, at_first = int(waiting[2]), m.t, True
        entry = (m.ask if side > 0 else m.bid) + side * rules.slippage
    until, place, starts, sides, entries = (np.frombuffer(v, kind) for v, kind in zip((m.until, m.place, m.opened, m.sides, m.entries), ("f8", "i8", "f8", "i8", "f8"), strict=True))
    closed = np.ones(len(until), bool)
    if side:
        closed = (until - opened >= rules.holding) & (place > 1 if at_first else True)
    if closed.any():
        j = int(closed.argmax())
        opened, side, entry = (float(starts[j]), int(sides[j]), float(entries[j])) if starts[j] == starts[j] else (_NAN, 0, _NAN)
    elif not side or m.last - opened >= rules.holding and (m.quotes > 1 or not at_first):
        opened, side, entry = _NAN, 0, _NAN
    nxt = (m.next_at, m.next_ts, m.next_side, m.next_k + k0) if m.next_at == m.next_at else _NO_LEAD
    return (k0 + m.kept, *nxt, opened, side, entry)


def _mapped(df: DataFrame, keys: list[str], schema: str, fn: Callable) -> DataFrame:
    """``fn(row)``, a frame or none, for each row. NaN becomes null."""
    full = _full(df, keys, schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = [frame.columns.get_loc(k) for k in keys]
            for row in frame.itertuples(index=False):
                out = fn(row)
                if out is None or not len(out):
                    continue
                for i, k in enumerate(keys):
                    out.insert(i, k, row[at[i]])
                num = out.select_dtypes("floating").columns
                yield out.astype({c: object for c in num}).where(out.notna(), None)[full.names]

    return df.mapInPandas(run, full)


def _carried(df: DataFrame, keys: list[str], schema: str, first: Callable, step: Callable) -> DataFrame:
    """Each block's state before it, a row at a time; ``step`` gives what is returned and the next state."""
    full = _full(df, [*keys, O.BLOCK], schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None
        for frame in frames:
            out, at = [], [frame.columns.get_loc(k) for k in [*keys, O.BLOCK]]
            for row in frame.itertuples(index=False):
                own = tuple(None if row[i] != row[i] else row[i] for i in at)
                if key is None or own[:-1] != key:
                    key, state = own[:-1], first(row)
                made, state = step(state, row)
                out.append((*own, *made))
            made = pd.DataFrame(out, columns=full.names)
            yield made.astype(object).where(made.notna(), None) if len(out) else made

    return df.repartition(*keys).sortWithinPartitions(*keys, O.BLOCK).mapInPandas(run, full)


class Execution:
    """Runs of the engine over ``ticks`` (``timestamp, seq, bid, ask``, and each tick's order to ``side``, 1 or -1), one for
    each named scenario and its rules. Runs of the same latency share their blocks."""

    def __init__(self, ticks: DataFrame, series: list[str], runs: dict[str, tuple[Scenario, ExecutionRules]], block_rows: int = BLOCK_ROWS):
        ship(ticks.sparkSession)
        spark, self.series, self.runs = ticks.sparkSession, series, {n: (s, s.rules(r)) for n, (s, r) in runs.items()}
        self.keys = [*series, "scenario"]
        parts = []
        for latency in sorted({r.latency for _, r in self.runs.values()}):
            names = [n for n, (_, r) in self.runs.items() if r.latency == latency]
            parts.append(_pack(ticks, series, latency, block_rows).select("*", F.explode(F.array(*[F.lit(n) for n in names])).alias("scenario")))
        self.blocks = parts[0]
        for p in parts[1:]:
            self.blocks = self.blocks.union(p)
        runs = self.runs

        def block_map(row) -> pd.DataFrame:
            return pd.DataFrame([_Block(row._asdict(), *runs[row.scenario]).map()], columns=names_of(_MAP))

        def step(state, row):
            return state, _advance(state, row, runs[row.scenario][1])

        held = _mapped(self.blocks.withColumnRenamed(O.BLOCK, "block"), [*self.keys, "block"], _MAP, block_map).withColumnRenamed("block", O.BLOCK)
        held = written(held)
        starts = _carried(held, self.keys, _START, lambda _: (0, *_NO_LEAD, _NAN, 0, _NAN), step)
        ends = held.groupBy(*self.keys).agg(F.max("last").alias("end"))
        self.starts = written(O.beside(starts, ends, self.keys))
        self.started = O.beside(self.blocks, small_side(self.starts), [*self.keys, O.BLOCK]).withColumnRenamed(O.BLOCK, "block")

    def _ops(self) -> DataFrame:
        runs = self.runs

        def ops(row) -> pd.DataFrame:
            b, s = _Block(row._asdict(), *runs[row.scenario]), _Start(row)
            return pd.DataFrame([_cash_ops(b, s)], columns=names_of(_OPS))

        return _mapped(self.started, [*self.keys, "block"], _OPS, ops).withColumnRenamed("block", O.BLOCK)

    def fills(self) -> DataFrame:
        """``series, scenario`` and what became of each order, and closes."""
        runs = self.runs
        return _finite(_mapped(self.started, self.keys, FILL, lambda row: _fill_rows(_Block(row._asdict(), *runs[row.scenario]), _Start(row))), "price")

    def _cash(self, ops: DataFrame) -> DataFrame:
        runs = self.runs

        def step(state, row):
            cash, peak, last = state
            new, top = cash, peak
            for d, x in zip(_floats(row.deltas), _floats(row.tops), strict=True):
                new = new + d
                top = max(top, new + x)
            last = new + row.rest if row.deltas else last
            return (cash, peak, last), (new, top, last)

        return _carried(ops, self.keys, _CASH, lambda row: (runs[row.scenario][1].cash,) * 2 + (_NAN,), step)

    def marks(self) -> DataFrame:
        """``series, scenario`` and equity, drawdown and position after each quote."""
        runs = self.runs
        cash = small_side(written(self._cash(written(self._ops())).drop("equity")))
        full = O.beside(self.started.withColumnRenamed("block", O.BLOCK), cash, [*self.keys, O.BLOCK]).drop(O.BLOCK)
        return _finite(_mapped(full, self.keys, MARK, lambda row: _mark_rows(_Block(row._asdict(), *runs[row.scenario]), _Start(row), row.cash, row.peak)), "equity", "drawdown")

    def totals(self) -> DataFrame:
        """``series, scenario``, number of ``events`` (fills) and ``opened`` positions, and the last mark's ``equity``."""
        ops = written(self._ops())
        counts = ops.groupBy(*self.keys).agg(F.sum("fills").alias("events"), F.sum("opens").alias("opened"))
        last = self._cash(ops).groupBy(*self.keys).agg(F.max_by("equity", O.BLOCK).alias("equity"))
        return _finite(O.beside(counts, last, self.keys), "equity")


def _floats(held: bytes) -> list[float]:
    return np.frombuffer(held).tolist()


class _Start:
    """A block's start; missing numbers are NaN, as pandas may give them as none."""

    def __init__(self, row):
        for n in ("lead_at", "lead_ts", "opened", "entry", "end"):
            v = getattr(row, n)
            setattr(self, n, _NAN if v is None else float(v))
        self.k0, self.lead_side, self.lead_k, self.side = int(row.k0), int(row.lead_side), int(row.lead_k), int(row.side)


def names_of(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _held(b: _Block, trades: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of changes of position: their quotes, and which stretch of quotes between them each quote is in."""
    at = np.array([r for r, *_ in trades], "i8")
    return at, np.searchsorted(at, np.arange(b.n), side="right"), np.array([s if o else 0 for _, o, s, _ in trades], "i8")


def _worth(b: _Block, s: _Start, trades: list) -> tuple[np.ndarray, np.ndarray, list[float], np.ndarray]:
    """For each quote the stretch it is in, its position and the open position's gain; and what each change adds to cash."""
    at, stretch, after = _held(b, trades)
    side = np.r_[s.side, after][stretch]
    entry = np.r_[s.entry if s.side else 0.0, [e if o else 0.0 for _, o, _, e in trades]][stretch]
    with np.errstate(invalid="ignore"):
        x = np.where(side != 0, side * (np.where(side > 0, b.bid, b.ask) - entry) * b.rules.size, 0.0)
    deltas = [0.0]
    for row, opens, sd, e in trades:
        if opens:
            deltas.append(-b.rules.commission)
        else:
            price = float((b.bid if sd > 0 else b.ask)[row]) - sd * b.rules.slippage
            deltas.append(sd * (price - e) * b.rules.size - b.rules.commission)
    return stretch, x, deltas, side


def _refused(b: _Block, s: _Start) -> np.ndarray:
    """Orders after the first of those that wait for a quote, where a quote takes them."""
    first = b.leads.copy()
    if s.lead_at == s.lead_at and b.kept and b.waits[0] == 0:
        first[0] = False
    return np.flatnonzero(~first & (b.at < s.end))


def _fill_rows(b: _Block, s: _Start) -> pd.DataFrame:
    trades, taken, expired, sides = b.trades(s)
    at, stretch, after = _held(b, trades)
    # The position when a quote comes is the one after the quote before.
    before = np.r_[s.side, np.r_[s.side, after][stretch]][: b.n] if b.n else np.zeros(0, "i8")
    k = b.lead + s.k0
    ts = np.where(b.lead >= 0, b.ts[b.lead] if b.kept else _NAN, _NAN)
    if b.n and s.lead_at == s.lead_at:
        k[0], ts[0] = s.lead_k, s.lead_ts
    no, gone = np.flatnonzero(taken & (before != 0)), np.flatnonzero(expired & (before == 0))
    more = _refused(b, s)
    parts = [
        pd.DataFrame({"ts": ts[no], "kind": "refused", "order": k[no], "side": sides[no], "price": _NAN}),
        pd.DataFrame({"ts": b.ts[more], "kind": "refused", "order": more + s.k0, "side": b.side[more], "price": _NAN}),
        pd.DataFrame({"ts": b.t[gone], "kind": "expired", "order": k[gone], "side": sides[gone], "price": _NAN}),
        pd.DataFrame(
            [(b.t[r], "open", k[r], sd, e) if o else (b.t[r], "close", -1, -sd, (b.bid if sd > 0 else b.ask)[r] - sd * b.rules.slippage) for r, o, sd, e in trades],
            columns=["ts", "kind", "order", "side", "price"],
        ),
    ]
    return pd.concat([p for p in parts if len(p)], ignore_index=True) if any(map(len, parts)) else parts[0]


def _cash_ops(b: _Block, s: _Start) -> tuple:
    """How many fills and opened positions a block has, what its changes of position add to cash, and the highest gain in
    each stretch between them; the last quote's gain."""
    trades, taken, expired, _ = b.trades(s)
    opens = sum(o for _, o, *_ in trades)
    # Each taken order is refused, expired or opened; each close is one fill more.
    fills = int(taken.sum()) + len(_refused(b, s)) + len(trades) - opens
    if not b.n:
        return fills, opens, b"", b"", _NAN
    stretch, x, deltas, _ = _worth(b, s, trades)
    tops = np.full(len(deltas), -np.inf)
    np.fmax.at(tops, stretch, x)
    return fills, opens, np.array(deltas).tobytes(), tops.tobytes(), float(x[-1])


def _mark_rows(b: _Block, s: _Start, cash: float, peak: float) -> pd.DataFrame | None:
    if not b.n:
        return None
    stretch, x, deltas, side = _worth(b, s, b.trades(s)[0])
    cash, peak = (_NAN if v is None else v for v in (cash, peak))
    levels = [cash]
    for d in deltas[1:]:
        levels.append(levels[-1] + d)
    equity = np.array(levels)[stretch] + x
    high = np.fmax.accumulate(np.r_[peak, equity])[1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        return pd.DataFrame({"ts": b.t, "equity": equity, "drawdown": equity / high - 1, "position": side})
