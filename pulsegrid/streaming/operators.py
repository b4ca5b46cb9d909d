"""Causal operators on streams: windows, event-time features, indicator and stages.

All keep their state by unit in ``transformWithState`` lists, maps and values, with timers on
event time. Rows that come out of order wait until the watermark has passed them; a unit ends
when the watermark is ``gap`` past its last row: what waited for more rows is put out and its
state goes. So a replay gives the batch result, short units included, once something later
has moved the watermark on: rows whose order column is null only do that (heartbeats). State
is bounded: rows younger than the watermark, and the panes of unfinished windows, the early
reference rows and the last few scores, or a stage and a run length.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import windowing
from ..operators.health import LOGGED, N_REF, REFERENCE, SEQ, SKIP, SMOOTH, U
from ..operators.stages import PERSISTENCE, UNKNOWN
from ..shipping import ship

#: How late a row may be, and how long after its last row a unit has ended.
LATE, GAP = "10 seconds", 60.0
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ready(spark: SparkSession) -> None:
    """Send the package to the workers and choose the state store that lists, maps and timers need."""
    ship(spark)
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)


def _run(rows: DataFrame, unit: str, time: str, late: str, processor: StatefulProcessor, out: str, columns: list[str]) -> DataFrame:
    _ready(rows.sparkSession)
    timed = rows.withWatermark(time, late).select(unit, time, *columns)
    return timed.groupBy(unit).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


def _millis(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").to_numpy().astype(np.int64) // 1000


def _plain(x: float) -> float | None:
    return None if np.isnan(x) else float(x)


class _Unit(StatefulProcessor):
    """What all units have: a last time, and one timer for their end."""

    def __init__(self, time: str, gap: float) -> None:
        self.time, self.gap = time, int(gap * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def seen(self, times: np.ndarray) -> None:
        before = self.last.get()[0] if self.last.exists() else None
        now = int(times.max())
        if before is None or now > before:
            if before is not None:
                self.handle.deleteTimer(before + self.gap)
            self.last.update((now,))
            self.handle.registerTimer(now + self.gap)

    def ended(self, wm: int) -> bool:
        return self.last.exists() and self.last.get()[0] + self.gap <= wm

    def close(self) -> None:
        pass


class _InOrder(_Unit):
    """Hands rows on in order of time and ``order``, once the watermark has passed them."""

    def __init__(self, time: str, gap: float, order: str, columns: list[str], kinds: str, names: list[str]) -> None:
        super().__init__(time, gap)
        self.order, self.columns, self.kinds, self.names = order, columns, kinds, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pending = handle.getListState("pending", f"ms long, at long, {self.kinds}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part[part[self.order].notna()]
            if not len(part):
                continue
            ms = _millis(part[self.time])
            values = [[None if v is None or v != v else v for v in part[c].tolist()] for c in self.columns]
            self.pending.appendList(list(zip(ms.tolist(), part[self.order].astype("int64").tolist(), *values, strict=True)))
            self.seen(ms)
            # Wakes the unit as soon as the watermark has passed these rows.
            self.handle.registerTimer(int(ms.max()))
        yield from self._due(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(key, timerValues)
        if self.ended(timerValues.getCurrentWatermarkInMs()):
            yield self._frame(key, self.finish())
            self.pending.clear()
            self.last.clear()

    def _due(self, key, timers) -> Iterator[pd.DataFrame]:
        wm = timers.getCurrentWatermarkInMs()
        waiting = list(self.pending.get()) if self.pending.exists() else []
        due = sorted((r for r in waiting if r[0] <= wm), key=lambda r: r[:2])
        if due:
            left = [r for r in waiting if r[0] > wm]
            if left:
                self.pending.put(left)
            else:
                self.pending.clear()
            yield self._frame(key, self.take([(r[1], *r[2:]) for r in due]))

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=self.names)

    def take(self, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def finish(self) -> list[tuple]:
        """What comes out when the unit ends; its state goes."""
        raise NotImplementedError


# Windows that count rows

#: Of the values of a pane: rows, known values, mean, sums of powers of differences from it, of sizes and of their roots, ends.
_MOMENTS = "rows long, n long, mean double, m2 double, m3 double, m4 double, size double, root double, lo double, hi double"
_NONE = (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, float("inf"), float("-inf"))


def pane_moments(values: np.ndarray) -> tuple:
    x = values[~np.isnan(values)]
    if not len(x):
        return (len(values), *_NONE[1:])
    d, a = x - x.mean(), np.abs(x)
    return (len(values), len(x), float(x.mean()), *(float((d**k).sum()) for k in (2, 3, 4)), float(a.sum()), float(np.sqrt(a).sum()), float(x.min()), float(x.max()))


def merge_moments(a: tuple, b: tuple) -> tuple:
    """Moments of two panes together."""
    rows = a[0] + b[0]
    if not a[1] or not b[1]:
        return (rows, *(a if a[1] else b)[1:])
    n, d = a[1] + b[1], b[2] - a[2]
    p, q = a[1] / n, b[1] / n
    m2 = a[3] + b[3] + d * d * n * p * q
    m3 = a[4] + b[4] + d**3 * n * p * q * (p - q) + 3 * d * (p * b[3] - q * a[3])
    m4 = a[5] + b[5] + d**4 * n * p * q * (p * p - p * q + q * q) + 6 * d * d * (p * p * b[3] + q * q * a[3]) + 4 * d * (p * b[4] - q * a[4])
    return rows, n, a[2] + q * d, m2, m3, m4, a[6] + b[6], a[7] + b[7], min(a[8], b[8]), max(a[9], b[9])


def moment_stats(m: tuple) -> list[float | None]:
    """The 14 statistics, as ``windowing.window_stats`` has them."""
    _, n, mean, m2, m3, m4, size, root, low, high = m
    if not n:
        return [None] * len(windowing.STATS)
    var, size, root = m2 / n, size / n, root / n
    rms, peak = float(np.sqrt(var + mean * mean)), max(abs(low), abs(high))
    part = lambda a, b: a / b if b else None
    spread = var > 1e-24
    told = {
        "mean": mean, "abs_mean": size, "rms": rms, "std": float(np.sqrt(var)), "var": var, "min": low, "max": high, "peak_to_peak": high - low, "crest_factor": part(peak, rms), "shape_factor": part(rms, size),
        "impulse_factor": part(peak, size), "clearance_factor": part(peak, root * root), "kurtosis": m4 / n / var**2 - 3 if spread else None, "skewness": m3 / n / var**1.5 if spread else None,
    }
    return [told[s] for s in windowing.STATS]


class _Windows(_Unit):
    """Panes are merged as rows come, in any order; a window is put out with its last row."""

    def __init__(self, time: str, gap: float, unit: str, row: str, values: list[str], size: int, step: int) -> None:
        super().__init__(time, gap)
        self.unit, self.row, self.values, self.size, self.step, self.pane = unit, row, values, size, step, gcd(size, step)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.panes = [handle.getMapState(f"panes{k}", "pane long", f"{_MOMENTS}, done long") for k in range(len(self.values))]

    def _covering(self, pane: int) -> range:
        """Windows that hold a pane."""
        first = pane * self.pane
        return range(max(0, -(-(first + self.pane - self.size) // self.step)), first // self.step + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for part in rows:
            part = part[part[self.row].notna()]
            if not len(part):
                continue
            self.seen(_millis(part[self.time]))
            pane = part[self.row].to_numpy().astype(np.int64) // self.pane
            for k, value in enumerate(self.values):
                x, state = part[value].to_numpy(dtype=float), self.panes[k]
                for p in np.unique(pane).tolist():
                    old = state.getValue((p,)) if state.containsKey((p,)) else (*_NONE, 0)
                    now = merge_moments(old[:-1], pane_moments(x[pane == p]))
                    state.updateValue((p,), (*now, old[-1]))
                    if now[0] == self.pane:
                        self._complete(k, p, found)
        yield pd.DataFrame([(key[0], w, w * self.step, *(s for part in parts for s in part)) for w, parts in sorted(found.items())], columns=[self.unit, "w", "row_start", *self.names()])

    def names(self) -> list[str]:
        return [f"{v}_{s}" for v in self.values for s in windowing.STATS]

    def _complete(self, k: int, last: int, found: dict[int, list]) -> None:
        """Put out the windows that pane ``last`` completes, and drop panes that no other one needs."""
        state, each = self.panes[k], self.size // self.pane
        for w in self._covering(last):
            start = w * self.step // self.pane
            panes = [state.getValue((p,)) if state.containsKey((p,)) else None for p in range(start, start + each)]
            if any(m is None or m[0] < self.pane for m in panes):
                continue
            whole = _NONE
            for p, m in zip(range(start, start + each), panes, strict=True):
                whole = merge_moments(whole, m[:-1])
                if m[-1] + 1 == len(self._covering(p)):
                    state.removeKey((p,))
                else:
                    state.updateValue((p,), (*m[:-1], m[-1] + 1))
            found.setdefault(w, []).append(moment_stats(whole))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.ended(timerValues.getCurrentWatermarkInMs()):  # an incomplete tail gives no window
            for state in self.panes:
                state.clear()
            self.last.clear()
        return iter(())


def sliding_windows(samples: DataFrame, unit: str, row: str, values: list[str], time: str, size: int, overlap: float = 0.5, late: str = LATE, gap: float = GAP) -> DataFrame:
    """``unit, w, row_start`` and the 14 statistics of every complete window, as soon as it is complete.

    The state of a unit is the moments of panes that a later window may still need, a few
    numbers each: no samples. Rows may come in any order, across batches too.
    """
    processor = _Windows(time, gap, unit, row, list(values), size, windowing.step_of(size, overlap))
    kind = samples.schema[unit].dataType.simpleString()
    out = f"{unit} {kind}, w long, row_start long, " + ", ".join(f"{n} double" for n in processor.names())
    return _run(samples, unit, time, late, processor, out, [row, *values])


def event_time_features(samples: DataFrame, unit: str, time: str, values: list[str], size: str = "1 second", step: str = "500 milliseconds", late: str = "2 seconds") -> DataFrame:
    """The 14 statistics over sliding event-time windows; rows later than the watermark are dropped."""
    timed = samples.withWatermark(time, late).withColumn("window", F.window(time, size, step))
    return windowing.group_stats(timed, [unit, "window"], values)


# Indicator


class _Indicator(_InOrder):
    def __init__(self, time: str, gap: float, params: dict[str, float], features: tuple[str, ...], skip: int, n_ref: int, smooth: int) -> None:
        super().__init__(time, gap, SEQ, list(features), ", ".join(f"v{k} double" for k in range(len(features))), [U, SEQ, "score", "hi"])
        self.scales = np.array([params[f"s_{f}"] for f in features])
        self.logged = np.array([f in LOGGED for f in features])
        self.healthy, self.failure = params["healthy"], params["failure"]
        self.skip, self.n_ref, self.smooth = skip, n_ref, smooth

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.early = handle.getListState("early", "seq long, x array<double>")
        self.known = handle.getValueState("known", "reference array<double>, recent array<double>")

    def take(self, rows: list[tuple]) -> list[tuple]:
        x = np.array([r[1:] for r in rows], dtype=float)
        x = np.where(self.logged, np.log1p(np.maximum(x, 0)), x)
        new = list(zip([r[0] for r in rows], x, strict=True))
        if self.known.exists():
            return self._put(new)
        early = self._early() + new
        if len(early) >= self.skip + self.n_ref:
            self.early.clear()
            return self._settle(early)
        self.early.appendList([(s, [_plain(v) for v in row]) for s, row in new])
        return []

    def _early(self) -> list[tuple]:
        return [(s, np.array([np.nan if v is None else v for v in x], dtype=float)) for s, x in self.early.get()] if self.early.exists() else []

    def _settle(self, rows: list[tuple]) -> list[tuple]:
        block = np.array([x for _, x in rows])
        own = block[self.skip : self.skip + self.n_ref] if len(block) > self.skip else block[: self.n_ref]
        with np.errstate(all="ignore"):
            reference = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else np.nan for c in own.T])
        self.known.update(([_plain(v) for v in reference], []))
        return self._put(rows)

    def _put(self, rows: list[tuple]) -> list[tuple]:
        reference, recent = self.known.get()
        center = np.array([np.nan if v is None else v for v in reference], dtype=float)
        recent, found = list(recent), []
        for seq, x in rows:
            z = (x - center) / self.scales
            recent.append(float(z[~np.isnan(z)].mean()) if (~np.isnan(z)).any() else None)
            del recent[: -self.smooth]
            values = [v for v in recent if v is not None]
            score = float(np.median(values)) if values else None
            middle, slope = (self.healthy + self.failure) / 2, (self.failure - self.healthy) / 6
            found.append((seq, score, None if score is None else float(1 / (1 + np.exp(np.clip((score - middle) / slope, -700, 700))))))
        self.known.update((list(reference), recent))
        return found

    def finish(self) -> list[tuple]:
        early = self._early()
        found = self._settle(early) if early and not self.known.exists() else []
        self.early.clear()
        self.known.clear()
        return found


def reference_indicator(rows: DataFrame, params: dict[str, float], time: str, features: tuple[str, ...] = REFERENCE, skip: int = SKIP, n_ref: int = N_REF, smooth: int = SMOOTH, late: str = LATE, gap: float = GAP) -> DataFrame:
    """``unit, sequence_index, score, hi``; the first rows of a unit come once its reference is complete.

    ``params`` is a row of fitted scales and anchors. A unit that ends before its reference is
    complete (``skip + n_ref`` rows) is held against the rows it has, as in a batch.
    """
    processor = _Indicator(time, gap, params, features, skip, n_ref, smooth)
    return _run(rows, U, time, late, processor, f"{U} string, {SEQ} long, score double, hi double", [SEQ, *features])


# Stages


class _Debounce(_InOrder):
    def __init__(self, time: str, gap: float, raw: str, k: int) -> None:
        super().__init__(time, gap, SEQ, [raw], "reading string", [U, SEQ, "stage"])
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.now = handle.getValueState("now", "current string, candidate string, length int")

    def take(self, rows: list[tuple]) -> list[tuple]:
        current, candidate, length = self.now.get() if self.now.exists() else (UNKNOWN, None, 0)
        found = []
        for seq, reading in rows:
            if reading:
                if current == UNKNOWN:
                    current = reading
                elif reading == current:
                    candidate, length = None, 0
                else:
                    length = length + 1 if reading == candidate else 1
                    candidate = reading
                    if length >= self.k:
                        current, candidate, length = reading, None, 0
            found.append((seq, current))
        self.now.update((current, candidate, length))
        return found

    def finish(self) -> list[tuple]:
        self.now.clear()
        return []


def debounced_stages(rows: DataFrame, time: str, raw: str = "raw_stage", k: int = PERSISTENCE, late: str = LATE, gap: float = GAP) -> DataFrame:
    """``unit, sequence_index, stage``: the committed stage at every row; a unit that ended starts anew."""
    return _run(rows, U, time, late, _Debounce(time, gap, raw, k), f"{U} string, {SEQ} long, stage string", [SEQ, raw])
