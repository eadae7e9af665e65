"""Quality by a generalised additive model with pairwise interactions.

Boosting cycles over the features; every step fits a tree of three leaves to one feature's binned
residuals and adds it to that feature's lookup table, so that the model is a table a feature. What is
left is then given to the feature pairs whose four-leaf trees explain most of it, boosted in the same
way into two-dimensional tables. A score is an intercept and one table look-up a feature and pair.

Features come from the text alone. The fit reads a bounded sample of the labelled rows (``SAMPLE_ROWS``,
the smallest hashes of doc_id); bins, trees and pairs are learned in one task, and the tables (some
hundred kB) travel with the scoring function.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS = 20_000
BINS = 48
PAIR_BINS = 12
PAIRS = 10
ROUNDS = 120
RATE = 0.15
PRIOR = 4.0  # weight of a leaf's shrinkage to zero

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "distinct_words", "top_word", "repeated_pairs", "letters",
    "upper", "digits", "spaces", "marks", "symbols", "bars", "marked_words", "log_lines", "repeated_lines", "line_bytes",
)


def _class_table() -> np.ndarray:
    """Bytes by kind: 0 lower, 1 upper, 2 digit, 3 blank, 4 sentence mark, 5 other ASCII sign, 6 control, 7 beyond ASCII."""
    kind = np.full(256, 5, np.uint8)
    kind[:32], kind[127], kind[128:] = 6, 6, 7
    for c in range(256):
        s = chr(c)
        if c < 128 and s.isalnum():
            kind[c] = 0 if s.islower() else 1 if s.isupper() else 2
        elif s in " \t\n\r\x0b\x0c":
            kind[c] = 3
        elif s in ".,;:'\"()-?!":
            kind[c] = 4
    return kind


_KIND = _class_table()
_BAR, _ODD_ENDS = ord("|"), frozenset(b"!#$%&*+=<>@^_~|\\/")


def features_of(text: str | None) -> list[float]:
    """One document's features, in the order of FEATURES; over the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    bytes_ = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_KIND[bytes_], minlength=8) / max(len(raw), 1)
    n = max(len(words), 1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    spread = np.log1p(n)
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        np.log1p(max(map(len, words), default=0)),
        len(counts) / n * spread,
        max(counts.values(), default=0) / n,
        1 - len(set(zip(words, words[1:]))) / max(len(words) - 1, 1),
        kinds[0] + kinds[1] + kinds[7],
        kinds[1],
        kinds[2],
        kinds[3],
        kinds[4],
        kinds[5] + kinds[6],
        raw.count(b"|") / n,
        sum(c for w, c in counts.items() if w[-1] in _ODD_ENDS) / n,
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(len(raw) / max(len(lines), 1)),
    ]


def feature_matrix(texts) -> np.ndarray:
    return np.array([features_of(t) for t in texts], float).reshape(-1, len(FEATURES))


def _cut(x: np.ndarray, bins: int) -> np.ndarray:
    """Edges between at most ``bins`` bins of near equal counts."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _leaf(g, h):
    return g / (h + PRIOR)


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, position) of the best split of a histogram of gradients and hessians into two leaves."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + PRIOR) + (g.sum() - a) ** 2 / (h.sum() - b + PRIOR) - g.sum() ** 2 / (h.sum() + PRIOR)
    i = int(np.argmax(gain))
    return float(gain[i]), i + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves over one feature's bins, as the value it gives each bin."""
    cuts = [0, len(g)]
    for _ in range(2):
        gain, at = max(((s[0], a + s[1]) for a, b in zip(cuts, cuts[1:]) for s in [_best_split(g[a:b], h[a:b])]), default=(0, 0))
        if gain > 1e-9:
            cuts = sorted({*cuts, at})
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, table) of a depth-two tree over two features: one split of the first, one of the second on each side."""
    best, table = 0.0, np.zeros_like(g)
    for turn in (False, True):
        x, y = (g.T, h.T) if turn else (g, h)
        for i in range(1, x.shape[0]):
            sides = [(slice(None, i), *_best_split(x[:i].sum(axis=0), y[:i].sum(axis=0))), (slice(i, None), *_best_split(x[i:].sum(axis=0), y[i:].sum(axis=0)))]
            quarters = [(s, c) for s, _, at in sides for c in (slice(None, at), slice(at, None))]
            gain = sum(x[q].sum() ** 2 / (y[q].sum() + PRIOR) for q in quarters if x[q].size)
            if gain > best:
                best, t = gain, np.zeros_like(x)
                for q in quarters:
                    if x[q].size:
                        t[q] = _leaf(x[q].sum(), y[q].sum())
                table = t.T if turn else t
    return best, table


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> dict:
    """The model: intercept, for each feature its bin edges and table, and the pairs' coarse edges and tables."""
    n, k = x.shape
    rate = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    model = {"intercept": np.log(rate / (1 - rate)), "edges": [_cut(x[:, j], BINS) for j in range(k)], "pairs": []}
    model["tables"] = [np.zeros(len(e) + 1) for e in model["edges"]]
    if not n:
        return model
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model["edges"])]
    raw = np.full(n, model["intercept"])
    for _ in range(rounds):
        for j in range(k):
            p = _sigmoid(raw)
            size = len(model["tables"][j])
            step = RATE * _tree(np.bincount(bins[j], y - p, size), np.bincount(bins[j], p * (1 - p), size))
            model["tables"][j] += step
            raw += step[bins[j]]
    coarse = [_cut(x[:, j], PAIR_BINS) for j in range(k)]
    held = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def histograms(a: int, b: int):
        p, shape = _sigmoid(raw), (len(coarse[a]) + 1, len(coarse[b]) + 1)
        at = held[a] * shape[1] + held[b]
        return at, *(np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p)))

    ranked = sorted(combinations(range(k), 2), key=lambda ab: -_pair_tree(*histograms(*ab)[1:])[0])[:pairs]
    tables = {ab: np.zeros((len(coarse[ab[0]]) + 1, len(coarse[ab[1]]) + 1)) for ab in ranked}
    for _ in range(rounds // 6):
        for ab in ranked:
            at, g, h = histograms(*ab)
            step = RATE * _pair_tree(g, h)[1]
            tables[ab] += step
            raw += step.ravel()[at]
    model["pairs"] = [(a, b, coarse[a], coarse[b], t) for (a, b), t in tables.items()]
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1: additions of table entries."""
    raw = np.full(len(x), model["intercept"])
    for j, (e, t) in enumerate(zip(model["edges"], model["tables"])):
        raw += t[np.searchsorted(e, x[:, j], side="right")]
    for a, b, ea, eb, t in model["pairs"]:
        raw += t[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
    return _sigmoid(raw)


def is_held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the doc_id as text leaves 1 when divided by 3. Null ids: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(text: pd.Series) -> pd.Series:
    return pd.Series(list(feature_matrix(text)), dtype="object")


def _learn(part: pd.DataFrame) -> pd.DataFrame:
    import pickle

    part = part.sort_values(["doc_id", "label"])
    x = np.array([np.asarray(v, float) for v in part["x"]]).reshape(-1, len(FEATURES))
    return pd.DataFrame({"model": [zlib.compress(pickle.dumps(fit(x, part["label"].to_numpy(float))))]})


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Fits on at most ``sample_rows`` labelled documents that are not held out.

    Null labels and labels without a document are left out; a document with several labels counts once
    for each, and of several documents of one doc_id the one with the smallest features. Without any
    labelled document every score is one half.
    """
    import pickle

    known = labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).distinct()
    sample = known.where(~is_held_out("_id")).orderBy(F.xxhash64("_id"), "_id", "label").limit(sample_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    # Texts stay where they are: their features are what one task learns from, ``sample_rows`` rows at most.
    rows = found.select("doc_id", "label", features("text").alias("x")).groupBy("doc_id", "label").agg(F.min("x").alias("x"))
    got = rows.groupBy().applyInPandas(_learn, "model binary").collect()
    return pickle.loads(zlib.decompress(bytes(got[0]["model"]))) if got else fit(np.zeros((0, len(FEATURES))), np.zeros(0))


def scorer(model: dict):
    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(predict(model, feature_matrix(text)), dtype="float64")

    return score


def score_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score (of label 1), predicted (score of 0.5 or more).

    Null texts are scored as empty. Repeated rows are scored alike; other columns are not read.
    """
    score = scorer(train(docs, labels, sample_rows))
    scored = docs.select("doc_id", is_held_out().alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns, whatever their names."""
    return docs.where(scorer(train(docs, labels))(F.col("text")) >= threshold)
