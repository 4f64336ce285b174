"""Text quality by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Labelled texts of each label that are learned from at most, and preference pairs made of them.
SAMPLE, PAIRS = 4000, 40_000
#: What a score must reach to count as good.
THRESHOLD = 0.3

#: Classes of bytes (fixed values): lower case, upper case, digit, space, line end, sentence marks, other marks, beyond ASCII.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".,;:?'\"()-",
           b"!", b"|", b"#$%&*@+=<>/\\^_`{}[]~"]
_CLASS = np.full(256, len(CLASSES))
for _k, _members in enumerate(CLASSES):
    _CLASS[list(_members)] = _k


def features(text: str | None) -> list[float]:
    """Shares of byte classes, repetition of words and lines, length: of the whole text."""
    data = (text or "").encode()
    counts = np.bincount(_CLASS, np.bincount(np.frombuffer(data, np.uint8), minlength=256), len(CLASSES) + 1)
    share = counts / max(1, len(data))
    words = data.lower().split()
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x]
    known = Counter(words)
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n
    expected = n / (1 + n / 2000)  # a long text repeats words by nature
    return [*np.sqrt(share), *share, min(1.0, len(known) / expected), len(set(lines)) / max(1, len(lines)),
            sum(map(len, known)) / max(1, len(known)) / 10, np.log1p(len(words)) / 10, marked,
            max(known.values(), default=0) / n, float(not words)]


WIDTH = len(features(""))


def learn(table: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 7, ridge: float = 1e-4,
          rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights): logistic loss on differences of features, preferred minus other, by Newton's method."""
    mean, scale = table.mean(0), table.std(0) + 1e-6
    unit = (table - mean) / scale
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return mean, scale, np.zeros(table.shape[1])
    draw = np.random.default_rng(seed)
    difference = unit[draw.choice(good, pairs)] - unit[draw.choice(bad, pairs)]
    w = np.zeros(table.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))  # how wrong the order is held to be
        slope = -difference.T @ p / pairs + ridge * w
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5 / (1e-12 + np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def calibrate(scores: np.ndarray, label: np.ndarray, threshold: float = THRESHOLD, points: int = 257) -> tuple[np.ndarray, np.ndarray]:
    """Knots that turn a raw score to its quantile, bent so that the quantile that divides best becomes the threshold.

    The dividing quantile is the one with the fewest wrong labels in the
    sample; of equals, the middle one.
    """
    order = np.argsort(scores, kind="stable")
    y = label[order]
    wrong = np.concatenate([[0], np.cumsum(y == 1)]) + (y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    s = scores[order]
    cut = (s[k - 1] + s[k]) / 2 if 0 < k < len(s) else (s[0] - 1 if k == 0 else s[-1] + 1)
    def side(part: np.ndarray, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
        q = np.linspace(0, 1, points // 2)
        return np.quantile(part, q) if len(part) else np.full(len(q), cut), a + (b - a) * (0.02 + 0.96 * q)
    (x0, y0), (x1, y1) = side(s[:k], 0.0, threshold), side(s[k:], threshold, 1.0)
    x, v = np.concatenate([x0, [cut], x1]), np.concatenate([y0, [threshold], y1])
    keep = np.concatenate([[True], np.diff(np.maximum.accumulate(x)) > 0])
    keep[len(x0)] = True
    return np.maximum.accumulate(x)[keep], v[keep]


def training_table(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, each: int) -> pd.DataFrame:
    """At most ``each`` labelled texts per label (0 and 1), as features; computed by tasks, chosen by a hash of the key.

    The keys drawn are a bounded number, so they go to the texts; no text is
    shuffled.  A fifth more is drawn, as labelled documents may be missing.  Of
    rows with the same key one is learned from.
    """
    wanted = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max(F.col(label).cast("int")).alias("_label"))
    drawn = wanted.withColumn("_u", F.xxhash64(F.lit(11), "_key"))
    parts = [drawn.filter(F.col("_label") == k).orderBy("_u", "_key").limit(each + each // 5) for k in (0, 1)]
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(
        F.broadcast(parts[0].unionByName(parts[1])), "_key")

    @F.pandas_udf("array<double>")
    def describe(column: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in column])

    described = rows.select("_key", "_label", "_u", describe("_text").alias("x"))
    got = described.groupBy("_key", "_label", "_u").agg(F.min("x").alias("x")).toPandas().sort_values(["_u", "_key"])
    return got.groupby("_label").head(each)


def score(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "quality", each: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` (0 to 1, higher is better) and ``predicted`` (1 from the threshold on) to ``docs``.

    Learns from rows of ``learn_from`` that ``labels`` marks, at most ``each``
    per label: a bounded sample; a document with both labels counts as good.
    Every text of ``docs`` is read whole.  NULL counts as empty; empty texts
    get the score of their features.  Without labels of both kinds every score
    is the threshold.  Repeated rows get equal scores; columns ``score`` and
    ``predicted`` that ``docs`` has already are replaced, all others are kept.
    An empty table gives an empty one.
    """
    sample = training_table(learn_from, labels, key, text, label, each)
    if sample["_label"].nunique() < 2:
        return docs.withColumns({"score": F.lit(threshold), "predicted": F.lit(1)})
    table, marks = np.array(sample["x"].tolist()), sample["_label"].to_numpy()
    mean, scale, w = learn(table, marks)
    x, y = calibrate((table - mean) / scale @ w, marks, threshold)

    @F.pandas_udf("double")
    def judge(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            raw = (np.array([features(t) for t in column]).reshape(-1, WIDTH) - mean) / scale @ w
            yield pd.Series(np.interp(raw, x, y) + 1e-4 * np.tanh(raw / 50) * (np.interp(raw, x, y) != threshold))

    judged = docs.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), judge(F.col(text).cast("string")))))
    return judged.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
