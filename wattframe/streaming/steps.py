"""Per-series steps for stateful queries.

A step maps ``(state, rows in time order) -> (output rows, state)`` with the
state as a flat list of doubles.  Steps run unchanged over a stream and over
:func:`wattframe.plans.folds.fold`, which is how the two are kept equal.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd

from wattframe.operators.features import CappedThreshold, kalman_rows
from wattframe.plans.folds import Step


def _seconds(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy().astype("datetime64[us]").astype(np.int64) / 1e6


def counter_watts(keys: Sequence[str], ts: str, energy: str, max_range: float | None, min_window_s: float = 0.0) -> Step:
    """Counter to watts on advancing rows (T4): last counter, last time,
    pending energy and time."""

    def step(state, pdf):
        e0, t0, uj, s = state or (np.nan, np.nan, 0.0, 0.0)
        at, watts = [], []
        for i, (e, t) in enumerate(zip(pdf[energy].to_numpy(float), _seconds(pdf[ts]))):
            if not np.isnan(e0):
                d = e - e0
                if d < 0 and max_range is not None:
                    d += max_range
                uj, s = uj + d, s + t - t0
                if d > 0 and s > 0 and s >= min_window_s:
                    at.append(i)
                    watts.append(uj * 1e-6 / s)
                    uj, s = 0.0, 0.0
            e0, t0 = e, t
        return pdf.iloc[at][[*keys, ts]].assign(watts=watts), [e0, t0, uj, s]

    return step


def edge_pulse(
    keys: Sequence[str], ts: str, usage: str, threshold: float = 10.0, min_slope: float = 25.0,
    pulse_s: float = 1.0, cooldown_s: float = 5.0,
) -> Step:
    """Signed usage edge with pulse and cooldown (T3): last usage, last time,
    last fired time, its direction."""

    def step(state, pdf):
        u0, t0, fired, way = state or (np.nan, np.nan, -np.inf, 0.0)
        rows = []
        for u, t in zip(pdf[usage].to_numpy(float), _seconds(pdf[ts])):
            edge = 0
            if not np.isnan(u0) and t > t0 and max(u0, u) >= threshold:
                if min(u0, u) < threshold or abs(u - u0) / (t - t0) >= min_slope:
                    edge = 1 if u >= u0 else -1
            hit = edge != 0 and t - fired >= cooldown_s
            if hit:
                fired, way = t, float(edge)
            live = t - fired < pulse_s
            rows.append((hit, int(live), int(way) if live else 0))
            u0, t0 = u, t
        out = pd.DataFrame(rows, columns=["fired", "risk", "direction"], index=pdf.index)
        return pd.concat([pdf[[*keys, ts]], out], axis=1), [u0, t0, fired, way]

    return step


def pulse_end(pulse_s: float = 1.0):
    """When a live pulse of :func:`edge_pulse` ends by itself, as seconds; none if a later row has told so."""

    def wake(state) -> float | None:
        _, last, fired, _ = state
        return fired + pulse_s if last - fired < pulse_s else None

    return wake


def quiet_row(keys: Sequence[str], ts: str):
    """The row that tells a pulse's end where no sample does."""

    def rows(key: tuple, at: float, state) -> tuple[pd.DataFrame, list[float]]:
        usage, _, fired, way = state
        row = {**dict(zip(keys, key, strict=True)), ts: pd.Timestamp(round(at * 1e6), unit="us"), "fired": False, "risk": 0, "direction": 0}
        return pd.DataFrame([row]), [usage, at, fired, way]

    return rows


def rank_alarm(
    keys: Sequence[str], ts: str, score: str, window: int = 18_000, q: float = 0.9, floor: float = 0.0,
    warm: int = 600, refresh_s: float = 1.0, refractory_s: float = 5.0,
) -> Step:
    """Rolling rank threshold with refractory flags (T5): threshold, refresh
    time, last flag time, then the bounded score window.

    :class:`~wattframe.streaming.queries.RingProcessor` keeps the window in
    chunks, so that a batch rewrites the chunks it touches only.
    """

    def step(state, pdf):
        thr, fresh, last = (state[0], state[1], state[2]) if state else (floor, -np.inf, -np.inf)
        held = np.asarray(state[3:] if state else [], dtype=float)
        ring = np.concatenate([held, pdf[score].to_numpy(float)])
        rows = []
        for i, t in enumerate(_seconds(pdf[ts]), len(held)):
            if t - fresh >= refresh_s:
                past = ring[max(i - window, 0) : i]
                thr = max(floor, float(np.quantile(past, q))) if len(past) >= warm else floor
                fresh = t
            hit = bool(ring[i] > thr) and t - last >= refractory_s
            if hit:
                last = t
            rows.append((thr, hit))
        out = pd.DataFrame(rows, columns=["threshold", "flag"], index=pdf.index)
        return pd.concat([pdf[[*keys, ts]], out], axis=1), [thr, fresh, last, *ring[-window:]]

    return step


def capped_threshold(keys: Sequence[str], ts: str, score: str, base: float, **options) -> Step:
    """Capped-step adaptive threshold."""
    defaults = dict(window_s=3600.0, refresh_s=300.0, min_samples=60, alarm_rate=0.1, max_rise=0.02, max_fall=0.005)
    machine = CappedThreshold(base, **{**defaults, **options})

    def step(state, pdf):
        y = pdf[score].to_numpy(float)
        out, state = machine.run(state, _seconds(pdf[ts]), y, np.zeros(len(y)))
        return pdf[[*keys, ts]].assign(threshold=out), state

    return step


def live_features(keys: Sequence[str], ts: str, power: str, runq: str, tau: float = 35.0, span: int = 30, q: float = 0.1, r: float = 5.0) -> Step:
    """Incremental Hawkes intensity, EWMA z-score and filter level."""
    decay, a = np.exp(-1.0 / tau), 1.0 - 2.0 / (span + 1.0)

    def step(state, pdf):
        nr0, lam, w, ww, mean, m2 = state[:6] if state else (np.nan, 0.0, 0.0, 0.0, 0.0, 0.0)
        rows = []
        for x, nr in zip(pdf[power].to_numpy(float), pdf[runq].to_numpy(float)):
            lam = lam * decay + (max(nr - nr0, 0.0) if not np.isnan(nr0) else 0.0)
            nr0 = nr
            w, ww = w * a + 1.0, ww * a * a + 1.0
            d = x - mean
            mean += d / w
            m2 = m2 * a + d * (x - mean)
            room = w * w - ww
            var = m2 / w * (w * w / room) if room > 1e-9 * w * w else np.nan
            rows.append((lam, mean, (x - mean) / np.sqrt(var) if var > 0 else np.nan))
        kf, kept = kalman_rows(pdf[power].to_numpy(float), list(state[6:]) if state else None, q, r, 1.0, True)
        out = pd.DataFrame(rows, columns=["hawkes", "ewma_mean", "ewma_z"], index=pdf.index)
        out = out.assign(kf_level=kf[:, 1], kf_slope=kf[:, 2])
        return pd.concat([pdf[[*keys, ts]], out], axis=1), [nr0, lam, w, ww, mean, m2, *kept]

    return step


def lookback_features(keys: Sequence[str], ts: str, power: str, usage: str, lags: Sequence[int] = (0, 1, 2, 3)) -> Step:
    """Lag features from a bounded buffer of recent rows."""
    depth = max(lags) + 1

    def step(state, pdf):
        kept = np.asarray(state or [], dtype=float).reshape(-1, 2)
        both = np.vstack([kept, pdf[[power, usage]].to_numpy(float)])
        n, m = len(kept), len(pdf)
        out = pdf[[*keys, ts]].copy()
        for k in lags:
            pad = np.full((max(k - n, 0), 2), np.nan)
            past = np.vstack([pad, both])[max(n - k, 0) : max(n - k, 0) + m]
            out[f"power_lag{k}"], out[f"usage_lag{k}"] = past[:, 0], past[:, 1]
        return out, both[-depth:].ravel().tolist()

    return step


# Fraction of the top level under which a rise arms (and from which a drop arms), loaded
# fraction, power slope and step that count as rising, seconds of flat idling before flags are ignored.
ENGAGE, LOADED, RISING_W_S, RISING_W, IDLE_S = 0.6, 0.45, 30.0, 20.0, 30.0
# Window of the slope, and how much of it must be covered by at least how many points.
SLOPE_S, SLOPE_SHARE, SLOPE_POINTS = 0.5, 0.6, 3


def short_slope(t: np.ndarray, p: np.ndarray) -> float:
    """Least-squares slope of the last ``SLOPE_S`` seconds, 0 until it is meaningful."""
    inside = t >= t[-1] - SLOPE_S
    t, p = t[inside] - t[-1], p[inside]
    if len(t) < SLOPE_POINTS or -t[0] < SLOPE_SHARE * SLOPE_S:
        return 0.0
    d = t - t.mean()
    return float(d @ (p - p.mean()) / (d @ d))


def level_gates(
    keys: Sequence[str], ts: str, power: str, rise: str, drop: str, top_w: float, engage: float = ENGAGE,
    load_floor: float = LOADED, rising_w_s: float = RISING_W_S, rising_w: float = RISING_W, suppress_s: float = IDLE_S,
) -> Step:
    """Rise and drop arming by level, and suppression after flat idling.

    A rise is actionable below ``engage`` of the top level, a drop from there
    on; each has its own flag. A rise flag may start the pre-burn unless power
    has neither been loaded nor rising, by step or by slope, for ``suppress_s``.
    State: idle since, then the (time, power) points of the slope.
    """

    def step(state, pdf):
        idle = state[0] if state else np.nan
        held = np.asarray(state[1:] if state else [], dtype=float).reshape(-1, 2)
        t = np.concatenate([held[:, 0], _seconds(pdf[ts])])
        w = np.concatenate([held[:, 1], pdf[power].to_numpy(float)])
        rows, begin = [], 0
        for i, up, down in zip(range(len(held), len(t)), pdf[rise].to_numpy(float), pdf[drop].to_numpy(float), strict=True):
            while t[begin] < t[i] - SLOPE_S:
                begin += 1
            p, jump = w[i], (w[i] - w[i - 1] if i else 0.0)
            rising = jump >= rising_w or short_slope(t[begin : i + 1], w[begin : i + 1]) >= rising_w_s
            if p >= load_floor * top_w or rising:
                idle = np.nan
            elif np.isnan(idle):
                idle = t[i]
            allowed = np.isnan(idle) or t[i] - idle < suppress_s
            armed = up > 0 and p < engage * top_w
            rows.append((bool(armed), bool(down > 0 and p >= engage * top_w), bool(armed and allowed)))
        # The last point is kept in any case: the next step is measured from it.
        keep = min(begin, len(t) - 1)
        out = pd.DataFrame(rows, columns=["rise_armed", "drop_armed", "preaction"], index=pdf.index)
        return pd.concat([pdf[[*keys, ts]], out], axis=1), [idle, *np.column_stack([t[keep:], w[keep:]]).ravel()]

    return step
