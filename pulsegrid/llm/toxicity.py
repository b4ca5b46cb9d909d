"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. The probabilities of the earlier ones are
features of the later ones; in training these come from models that didn't see the row
(out-of-fold), in use from the models fitted on all training rows. Features are the words of a document and
their first four to six letters, so that forms of a known stem count; those that tell most
about some category are kept.

Fitting takes a bounded sample of labelled rows; every document is scored over its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship, table

#: Labelled rows to fit on, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
FEATURES = 1_024
FOLDS = 3
PREFIXES = (4, 5, 6)
CACHED = 150_000
_WORD = re.compile(r"[^\W\d_]+")

#: The flags that the labels hold, in the order of the chain.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]


def document_features(text: str | None) -> set[str]:
    found: set[str] = set()
    for word in set(_WORD.findall((text or "").lower())):
        found.update(features_of(word))
    return found


@dataclass
class Chain:
    """A fitted chain; ``weights`` of a category: features, earlier probabilities, bias."""

    names: list[str]
    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def scores(self, hits: list[np.ndarray]) -> np.ndarray:
        """Probabilities, one row per document; ``hits`` are the places of its features."""
        rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
        cols = np.concatenate(hits).astype(np.int64) if hits else np.zeros(0, np.int64)
        earlier = np.zeros((len(hits), 0))
        for w in self.weights:
            z = _linear(w, rows, cols, earlier, len(self.vocabulary))
            earlier = np.column_stack([earlier, _sigmoid(z)])
        return earlier


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _linear(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, earlier: np.ndarray, n_features: int) -> np.ndarray:
    return np.bincount(rows, w[cols], minlength=len(earlier)) + earlier @ w[n_features:-1] + w[-1]


def _fit(rows, cols, earlier, y, n_features: int, l2: float = 2e-4, steps: int = 150) -> np.ndarray:
    """Logistic regression by accelerated gradient steps, each coordinate scaled by how often it is set."""
    n, rate = len(y), y.mean()
    w = np.zeros(n_features + earlier.shape[1] + 1)
    if not 0 < rate < 1:
        w[-1] = 12.0 if rate else -12.0
        return w
    w[-1] = np.log(rate / (1 - rate))
    often = np.bincount(cols, minlength=n_features) / n
    per_row = np.bincount(rows, minlength=n).mean() + 1
    scale = np.concatenate([1 / (0.25 * (np.sqrt(often * per_row) * np.sqrt(np.maximum(often, 1 / n))) + l2 + 1e-3), 1 / (1 + (earlier**2).mean(axis=0)), [1.0]])
    look, pace = w.copy(), 1.0
    lowest, step = np.inf, 0.5
    for _ in range(steps):
        z = _linear(look, rows, cols, earlier, n_features)
        loss = float(np.mean(np.logaddexp(0, z) - y * z) + 0.5 * l2 * (look[:-1] ** 2).sum())
        if loss > lowest * 1.0001:
            step, pace, look = step / 2, 1.0, w.copy()
            lowest = np.inf
            continue
        lowest = loss
        g = (_sigmoid(z) - y) / n
        grad = np.concatenate([np.bincount(cols, g[rows], minlength=n_features), g @ earlier, [g.sum()]])
        grad[:-1] += l2 * look[:-1]
        new = look - step * scale * grad
        following = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        look, w, pace = new + (pace - 1) / following * (new - w), new, following
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the highest F1; the middle of the gap between the scores on its sides."""
    if not 0 < y.sum() < len(y):
        return 0.5 if y.sum() else 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    ends = np.append(p[order][1:] < p[order][:-1], True)
    k = int(np.argmax(np.where(ends, f1, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, str]] = CATEGORIES, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Fit on at most ``sample`` labelled rows.

    ``categories`` are names and SQL conditions on the labels. Labels with a null among
    their conditions are left out; of several for one id, any that holds counts. Of several
    documents with one id the smallest text is learnt from. Without labels, or with one class only, a category gets a constant probability.
    """
    ship(docs.sparkSession)
    names = [name for name, _ in categories]
    flags = labels.select(F.col(id_col).alias("label_id"), *[F.expr(c).alias(f"y{k}") for k, (_, c) in enumerate(categories)]).dropna()
    flags = flags.groupBy("label_id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(names))])
    chosen = flags.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    ys = [f"y{k}" for k in range(len(names))]
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    # One row for each id, so at most ``sample`` rows go on, whatever repeats.
    known = materialise(known.groupBy("label_id", *ys).agg(F.min("text").alias("text")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Counter()
        for batch in batches:
            for text, *y in zip(batch["text"], *(batch[c] for c in ys), strict=True):
                code = sum(bool(v) << k for k, v in enumerate(y))
                seen.update((f, code) for f in document_features(text))
                seen["", code] += 1
        yield pd.DataFrame([(f, c, n) for (f, c), n in seen.items()], columns=["feature", "code", "n"])

    counts = known.mapInPandas(count, "feature string, code int, n long").groupBy("feature", "code").agg(F.sum("n").alias("n"))
    wide = counts.groupBy("feature").agg(*[F.sum(F.when(F.expr(f"(code & {1 << k}) {op} 0"), F.col("n")).otherwise(0)).alias(f"{side}{k}") for k in range(len(names)) for side, op in (("pos", "<>"), ("neg", "="))])
    wide = materialise(wide)
    totals = wide.where("feature = ''").first()
    chain = Chain(names)
    if totals is None:
        chain.weights = [np.array([*[0.0] * k, -12.0]) for k in range(len(names))]
        chain.thresholds = [2.0] * len(names)
        return chain

    def strength(k: int) -> Column:
        cells = [F.col(f"pos{k}") + 0.5, F.lit(totals[f"pos{k}"] + 0.5) - F.col(f"pos{k}"), F.col(f"neg{k}") + 0.5, F.lit(totals[f"neg{k}"] + 0.5) - F.col(f"neg{k}")]
        odds = F.log(cells[0] / cells[1]) - F.log(cells[2] / cells[3])
        return F.abs(odds) / F.sqrt(sum(1 / c for c in cells))

    top: list[str] = []
    for k in range(len(names)):
        rows = wide.where(f"feature <> '' AND pos{k} + neg{k} > 1").orderBy(strength(k).desc(), "feature").limit(features // len(names)).collect()
        top += [r["feature"] for r in rows]
    chain.vocabulary = vocabulary = {f: k for k, f in enumerate(dict.fromkeys(top))}

    def design(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [sorted(vocabulary[f] for f in document_features(t) if f in vocabulary) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["label_id"].astype(str), "hits": hits} | {c: batch[c] for c in ys})

    data = known.mapInPandas(design, "id string, hits array<int>, " + ", ".join(f"{c} boolean" for c in ys)).toPandas().sort_values("id", kind="stable")
    hits = [np.asarray(h, np.int64) for h in data["hits"]]
    rows, cols = np.repeat(np.arange(len(hits)), [len(h) for h in hits]), np.concatenate(hits) if hits else np.zeros(0, np.int64)
    fold = np.random.default_rng(5).permutation(len(hits)) % folds
    earlier, unseen = np.zeros((len(hits), 0)), np.zeros((len(hits), 0))
    for c in ys:
        y = data[c].to_numpy(float)
        out = np.zeros(len(y))
        for f in range(folds):
            train, put = fold != f, np.cumsum(fold != f) - 1
            at = train[rows]
            w = _fit(put[rows[at]], cols[at], unseen[train], y[train], len(vocabulary)) if train.any() else np.zeros(len(vocabulary) + unseen.shape[1] + 1)
            out[~train] = _sigmoid(_linear(w, rows, cols, unseen, len(vocabulary)))[~train]
        chain.weights.append(_fit(rows, cols, unseen, y, len(vocabulary)))
        chain.thresholds.append(best_threshold(out, y))
        unseen = np.column_stack([unseen, out])
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, p_<category>..., is_<category>...``: one row per row of ``docs``.

    Null and empty texts have no features and get the bias alone; repeated rows and null ids
    each give a row; other columns play no part.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"p_{n} double" for n in chain.names), *(f"is_{n} boolean" for n in chain.names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, known = chain.vocabulary, {}
        for batch in batches:
            hits = []
            for text in batch["text"]:
                found = set()
                for word in set(_WORD.findall((text or "").lower())):
                    places = known.get(word)
                    if places is None:
                        if len(known) >= CACHED:
                            known.clear()
                        places = known[word] = tuple(vocabulary[f] for f in features_of(word) if f in vocabulary)
                    if places:
                        found.update(places)
                hits.append(np.array(sorted(found), np.int64))
            p = chain.scores(hits)
            yield pd.DataFrame({"id": batch["id"]} | {f"p_{n}": p[:, k] for k, n in enumerate(chain.names)} | {f"is_{n}": p[:, k] >= chain.thresholds[k] for k, n in enumerate(chain.names)})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", category: str = "toxic") -> DataFrame:
    """``docs`` without the rows that the chain puts in ``category``; all columns stay.

    Rows of one id are told apart by nothing else: if any is rejected, all are.
    """
    chain = fit_chain(docs, labels, id_col=id_col, text_col=text_col)
    bad = score(docs, chain, id_col, text_col).where(F.col(f"is_{category}")).select(F.col("id").alias("__bad_id")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad_id"]), "left_anti")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit_chain(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))
