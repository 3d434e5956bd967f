"""The monitor's row windows as array operations over the rows of many keys.

Everything here works on whole arrays (a row's window is a row of a strided
view), with NaN for a missing value, and gives what the replay's SQL windows
give: means and deviations skip missing values, the covariance uses the pairs
that have both.
"""

from __future__ import annotations

import numpy as np

from textdrift.streaming.rules import MonitorRules

#: Rows whose windows are looked at together; bounds the strided copies.
STEP = 20_000


def _moments(v: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, mean, population deviation) of each row's usable values."""
    n = ok.sum(axis=1)
    count = np.maximum(n, 1)
    mean = np.where(ok, v, 0.0).sum(axis=1) / count
    far = np.where(ok, v - mean[:, None], 0.0)
    sd = np.sqrt((far * far).sum(axis=1) / count)
    # equal values have no deviation, whatever the mean's rounding
    same = np.where(ok, v, -np.inf).max(axis=1) <= np.where(ok, v, np.inf).min(axis=1)
    return n, np.where(n > 0, mean, np.nan), np.where(same, 0.0, sd)


def relation_residuals(x: np.ndarray, y: np.ndarray, first: int, window: int) -> np.ndarray:
    """``z_y - rho z_x`` of the rows from ``first`` on, each within the last
    ``window`` rows."""
    rows = np.arange(first, len(x))
    return residuals_of(x, y, rows, rows, window)


def residuals_of(x: np.ndarray, y: np.ndarray, rows: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """:func:`relation_residuals` of ``rows``, each of which has ``place`` rows
    of its own history before it."""
    out = np.full(len(rows), np.nan)
    pad = np.full(window - 1, np.nan)
    wx = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, x]), window)
    wy = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, y]), window)
    for at in range(0, len(out), STEP):
        some = rows[at:at + STEP]
        own = np.arange(window) >= window - 1 - place[at:at + STEP, None]
        vx, vy = np.where(own, wx[some], np.nan), np.where(own, wy[some], np.nan)
        okx, oky = ~np.isnan(vx), ~np.isnan(vy)
        _, mx, sx = _moments(vx, okx)
        _, my, sy = _moments(vy, oky)
        both = okx & oky
        n, px, _ = _moments(vx, both)
        _, py, _ = _moments(vy, both)
        cov = np.where(both, (vx - px[:, None]) * (vy - py[:, None]), 0.0).sum(axis=1) / np.maximum(n, 1)
        scale = sx * sy
        rho = np.where((scale > 0) & (n > 0), cov / np.where(scale > 0, scale, 1.0), 0.0)
        zx = (vx[:, -1] - mx) / np.where(sx > 0, sx, 1.0)
        zy = (vy[:, -1] - my) / np.where(sy > 0, sy, 1.0)
        out[at:at + STEP] = zy - rho * zx
    return out


def previous_of_run(run: np.ndarray, history: np.ndarray) -> np.ndarray:
    """Position of the previous row of the same history and run, -1 for the first."""
    order = np.lexsort((run, history))
    before = np.full(len(run), -1)
    same = (run[order[1:]] == run[order[:-1]]) & (history[order[1:]] == history[order[:-1]])
    before[order[1:][same]] = order[:-1][same]
    return before


def changes(v: np.ndarray, before: np.ndarray) -> np.ndarray:
    """``v / previous - 1``; x / 0 is +-inf and 0 / 0 missing, as in pandas."""
    old = np.where(before >= 0, v[before], np.nan)
    zero = old == 0
    with np.errstate(invalid="ignore"):
        ratio = v / np.where(zero, np.nan, old) - 1.0
    return np.where(zero & (v > 0), np.inf, np.where(zero & (v < 0), -np.inf, ratio))


def evaluate(run: np.ndarray, hf: np.ndarray, dv: np.ndarray, mt: np.ndarray, history: np.ndarray, rows: np.ndarray,
             number: np.ndarray, rules: MonitorRules) -> dict[str, np.ndarray]:
    """Rule inputs and fired rules of ``rows``, which have ``number`` in their
    histories.  The rows of a history stand together, in order."""
    window = rules.history_window
    hist_len = np.minimum(number + 1, window)
    before = previous_of_run(run, history)
    before = np.where(np.arange(len(run)) - before <= window - 1, before, -1)
    out = {"seq": number, "hist_len": hist_len.astype(np.int32)}
    for name, v in (("Diversity_change", dv), ("HighFreq_change", hf), ("METEOR_change", mt)):
        out[name] = changes(v, before)[rows]
    place = rows - np.searchsorted(history, history[rows])
    residual = residuals_of(hf, dv, rows, place, window)
    out["relation_residual"] = np.where(hist_len >= 10, residual, np.nan)
    ready = hist_len >= 2
    hf, dv, mt = hf[rows], dv[rows], mt[rows]
    # a comparison with a missing value is false, as in the replay
    flags = [hf > rules.highfreq_threshold, dv < rules.diversity_threshold, mt < rules.meteor_threshold,
             np.abs(out["Diversity_change"]) > rules.diversity_change_threshold,
             np.abs(out["HighFreq_change"]) > rules.highfreq_change_threshold,
             np.abs(out["relation_residual"]) > rules.relation_residual_threshold]
    out["fired"] = sum((ready & f).astype(np.int32) << i for i, f in enumerate(flags))
    return out


def sticky(level: np.ndarray, start: np.ndarray, status: np.ndarray) -> np.ndarray:
    """Levels (0: none) carried forward inside each history, from its
    ``status``; ``start``: the place of the first row of a row's history."""
    at = np.maximum.accumulate(np.where(level > 0, np.arange(1, len(level) + 1), 0))
    return np.where(at > start, level[at - 1], status)
