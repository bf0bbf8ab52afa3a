"""Event simulation and risk: one position, ordered quotes and orders, costs, halts and latches."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.ranking import status_rules


@dataclass(frozen=True)
class ExecutionRules:
    latency: float = 0.0
    expiry: float = 60.0
    max_gap: float = 300.0
    holding: float = 3600.0
    commission: float = 0.0
    slippage: float = 0.0
    size: float = 1.0
    cash: float = 10_000.0


def decide(forecast: Column, spread: Column, threshold: float, max_spread: float, open_session: Column | None = None) -> tuple[Column, Column]:
    """Side by the forecast's sign, or 0, and the reason of refusal or ``ok``."""
    missing = forecast.isNull() | F.isnan(forecast) | (F.abs(forecast) == float("inf"))
    closed = F.lit(False) if open_session is None else ~F.coalesce(open_session, F.lit(False))
    rules = [(missing, "no_forecast"), (closed, "session_closed"), (spread > max_spread, "wide_spread"), (F.abs(forecast) < threshold, "weak_signal")]
    reason = status_rules(rules, "ok")
    return F.when(reason == "ok", F.when(forecast > 0, 1).otherwise(-1)).otherwise(0), reason


def run_engine(ts: np.ndarray, bid: np.ndarray, ask: np.ndarray, order_ts: np.ndarray, order_side: np.ndarray, rules: ExecutionRules = ExecutionRules()) -> tuple[list[dict], list[dict]]:
    """Fills and marks. An order fills at the first quote strictly after its arrival (decision plus latency) and before
    its expiry; a gap in quotes cancels what is pending; an open position refuses orders until its holding time is over
    and it is closed at the next quote."""
    fills, marks = [], []
    pending: tuple[float, int, int] | None = None
    side, entry, opened, cash, peak, k = 0, 0.0, 0.0, rules.cash, rules.cash, 0
    last = None

    def pay(price: float, s: int) -> float:
        return price + s * rules.slippage

    for t, b, a in zip(ts.tolist(), bid.tolist(), ask.tolist(), strict=True):
        if last is not None and t - last > rules.max_gap and pending:
            fills.append({"ts": t, "kind": "gap_cancel", "order": pending[2], "side": pending[1], "price": None})
            pending = None
        while k < len(order_ts) and order_ts[k] + rules.latency < t:
            if side or pending:
                fills.append({"ts": float(order_ts[k]), "kind": "refused", "order": k, "side": int(order_side[k]), "price": None})
            else:
                pending = (float(order_ts[k]) + rules.latency, int(order_side[k]), k)
            k += 1
        if pending and t >= pending[0] + rules.expiry:
            fills.append({"ts": t, "kind": "expired", "order": pending[2], "side": pending[1], "price": None})
            pending = None
        if side and t - opened >= rules.holding:
            price = pay(b if side > 0 else a, -side)
            cash += side * (price - entry) * rules.size - rules.commission
            fills.append({"ts": t, "kind": "close", "order": -1, "side": -side, "price": price})
            side = 0
        if pending and not side and t > pending[0]:
            side, entry, opened = pending[1], pay(a if pending[1] > 0 else b, pending[1]), t
            cash -= rules.commission
            fills.append({"ts": t, "kind": "open", "order": pending[2], "side": side, "price": entry})
            pending = None
        equity = cash + (side * ((b if side > 0 else a) - entry) * rules.size if side else 0.0)
        peak = max(peak, equity)
        marks.append({"ts": t, "equity": equity, "drawdown": equity / peak - 1, "position": side})
        last = t
    return fills, marks


@dataclass(frozen=True)
class Scenario:
    """Operational stress: spread multiplier, added latency and costs, a feed outage, missed forecasts."""

    spread: float = 1.0
    latency: float = 0.0
    commission: float = 0.0
    slippage: float = 0.0
    outage: tuple[float, float] | None = None
    missed: float = 0.0
    seed: int = 7

    def widen(self, bid, ask):
        """Bid and ask with the spread multiplied about their middle, of columns or of arrays."""
        mid, half = (bid + ask) / 2, (ask - bid) / 2 * self.spread
        return mid - half, mid + half

    def quotes(self, ts, bid, ask):
        bid, ask = self.widen(bid, ask)
        keep = np.ones(len(ts), bool) if self.outage is None else ~((ts >= self.outage[0]) & (ts < self.outage[1]))
        return ts[keep], bid[keep], ask[keep]

    def orders(self, ts, side):
        keep = np.random.default_rng(self.seed).random(len(ts)) >= self.missed
        return ts[keep], side[keep]

    def rules(self, base: ExecutionRules) -> ExecutionRules:
        return replace(base, latency=base.latency + self.latency, commission=base.commission + self.commission, slippage=base.slippage + self.slippage)


class RiskEngine:
    """Size and limit checks with reasons; idempotent by intent id; halts latch."""

    def __init__(self, max_size: float, max_daily_loss: float, max_drawdown: float, max_rate: int, stale_after: float):
        self.limits = (max_size, max_daily_loss, max_drawdown, max_rate, stale_after)
        self.seen: dict[str, tuple] = {}
        self.halted: str | None = None
        self.peak = self.day_start = None
        self.day, self.account_at, self.recent = None, None, []

    def observe_account(self, ts: float, equity: float) -> None:
        day = int(ts // 86_400)
        if day != self.day:
            self.day, self.day_start = day, equity
        self.peak = equity if self.peak is None else max(self.peak, equity)
        self.account_at = ts
        if self.day_start - equity > self.limits[1]:
            self.halted = self.halted or "daily_loss"
        if equity / self.peak - 1 < -self.limits[2]:
            self.halted = self.halted or "drawdown"

    def evaluate(self, intent: str, ts: float, size: float, exposure: float) -> tuple[bool, str]:
        content = (size,)
        if intent in self.seen:
            if self.seen[intent][0] != content:
                self.halted = self.halted or "reused_intent"
                return False, "reused_intent"
            return self.seen[intent][1]
        self.recent = [r for r in self.recent if ts - r < 60]
        if self.halted:
            out = False, f"halted_{self.halted}"
        elif self.account_at is None or ts - self.account_at > self.limits[4]:
            out = False, "stale_account"
        elif exposure + size > self.limits[0]:
            out = False, "size"
        elif len(self.recent) >= self.limits[3]:
            out = False, "rate"
        else:
            out = True, "accepted"
            self.recent.append(ts)
        self.seen[intent] = content, out
        return out


def intent_states(signal: np.ndarray, hold: int, cooldown: int) -> list[str]:
    """State of a bar policy: flat, long or short for ``hold`` bars, then cooling down; a signal counts only when flat."""
    out, left, state = [], 0, "flat"
    for s in signal:
        if left == 0:
            if state in ("long", "short") and cooldown:
                state, left = "cooldown", cooldown
            else:
                state = {1: "long", -1: "short"}.get(int(np.sign(s)) if np.isfinite(s) else 0, "flat")
                left = hold if state != "flat" else 0
        out.append(state)
        left = max(0, left - 1)
    return out


def aggregate_folds(folds: list[dict], cash: float) -> dict:
    """Totals over evaluation folds, with the equity chained."""
    pnl = [f["pnl"] for f in folds]
    equity = np.r_[cash, cash + np.cumsum(pnl)]
    return {"folds": len(folds), "trades": sum(f["trades"] for f in folds), "pnl": float(sum(pnl)), "return": float(sum(pnl) / cash), "positive_folds": sum(p > 0 for p in pnl), "max_drawdown": float((equity / np.maximum.accumulate(equity) - 1).min())}
