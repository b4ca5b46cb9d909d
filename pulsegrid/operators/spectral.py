"""Spectral features of sample arrays, and of windows gathered into arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Half-open bands in Hz; the last frequency of a 25.6 kHz signal lies in none.
BANDS = (("low", 0.0, 1000.0), ("mid", 1000.0, 5000.0), ("high", 5000.0, 12800.0))
SPECTRAL = ("dominant_frequency_hz", "spectral_centroid_hz", "spectral_entropy", "frequency_rms_hz", "total_spectral_energy")


def band_names(bands: Sequence[tuple[str, float, float]]) -> list[str]:
    return [f"band_energy_frac_{name}" for name, _, _ in bands]


def _batch_features(samples: np.ndarray, sample_rate: float, bands: Sequence[tuple[str, float, float]]) -> dict[str, np.ndarray]:
    """Features of equally long signals, one a row."""
    n = samples.shape[1]
    freq = np.arange(n // 2 + 1) * (sample_rate / n)
    mag = np.abs(np.fft.rfft(samples, axis=1))
    power, total = mag**2, mag.sum(axis=1)
    energy = power.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = mag / total[:, None]
        entropy = -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(axis=1)
        out = {
            "dominant_frequency_hz": freq[1:][np.argmax(mag[:, 1:], axis=1)],
            "spectral_centroid_hz": mag @ freq / total,
            "spectral_entropy": np.where(total > 0, entropy, np.nan),
            "frequency_rms_hz": np.sqrt(power @ freq**2 / energy),
            "total_spectral_energy": energy,
        }
        for name, low, high in bands:
            out[f"band_energy_frac_{name}"] = power[:, (freq >= low) & (freq < high)].sum(axis=1) / energy
    return out


def spectral_features(df: DataFrame, keys: list[str], samples: str, sample_rate: float, bands: Sequence[tuple[str, float, float]] = BANDS) -> DataFrame:
    """``keys`` and the eight spectral features of the array column ``samples``.

    Nulls and NaNs are dropped first, which shortens the signal; under two values every
    feature is null. The dominant frequency leaves out 0 Hz and takes the first of equals.
    Signals of one length are transformed together.
    """
    ship(df.sparkSession)
    names = [*SPECTRAL, *band_names(bands)]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys] + [f"{n} double" for n in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signals = [np.asarray([] if s is None else s, dtype=float) for s in batch["__samples"]]
            signals = [s[~np.isnan(s)] for s in signals]
            out = np.full((len(signals), len(names)), np.nan)
            lengths = np.array([len(s) for s in signals], dtype=int)
            for n in np.unique(lengths[lengths >= 2]):
                at = np.flatnonzero(lengths == n)
                found = _batch_features(np.stack([signals[i] for i in at]), sample_rate, bands)
                out[at] = np.column_stack([found[name] for name in names])
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    clean = F.filter(F.transform(samples, lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
    found = df.select(*keys, clean.alias("__samples")).mapInPandas(run, schema)
    return found.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def gather(df: DataFrame, keys: list[str], index: str, value: str, out: str = "samples", kind: str = "double") -> DataFrame:
    """``keys`` and the values of a group as an array in order of ``index``; nulls keep their places."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).cast(kind).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(out))


def gather_all(df: DataFrame, keys: list[str], index: str, values: list[str]) -> DataFrame:
    """``keys`` and an array of each value column, in order of ``index``; rows are shuffled once for all."""
    samples = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), *[F.col(v).cast("double").alias(v) for v in values])))
    return df.groupBy(*keys).agg(samples.alias("__s")).select(*keys, *[F.col(f"__s.{v}").alias(v) for v in values])


def prefix_of_spectrum(n: int) -> int:
    """How many bins a plot of a spectrum of n bins shows."""
    return n // 4


def spectrum_prefix(df: DataFrame, keys: list[str], samples: str, sample_rate: float) -> DataFrame:
    """``keys, k, frequency, magnitude``: the first quarter of the bins of each signal's spectrum.

    Missing samples are left out; a signal of under two gives no rows.
    """
    ship(df.sparkSession)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys), "frequency array<double>", "magnitude array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.abs(np.fft.rfft(np.asarray(s, dtype=float))) if len(s) > 1 else np.zeros(0) for s in batch["__samples"]]
            shown = [prefix_of_spectrum(len(m)) for m in found]
            at = [np.fft.rfftfreq(len(s), 1 / sample_rate)[:n] if len(s) > 1 else np.zeros(0) for s, n in zip(batch["__samples"], shown, strict=True)]
            yield batch[keys].assign(frequency=at, magnitude=[m[:n] for m, n in zip(found, shown, strict=True)])

    clean = F.filter(F.transform(samples, lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
    found = df.select(*keys, F.coalesce(clean, F.array().cast("array<double>")).alias("__samples")).mapInPandas(run, schema)
    return found.select(*keys, F.posexplode(F.arrays_zip("frequency", "magnitude")).alias("k", "x")).select(*keys, "k", "x.frequency", "x.magnitude")
