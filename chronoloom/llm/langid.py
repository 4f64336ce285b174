"""Language identification by a string kernel: blended n-gram presence, Nyström landmarks, ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chronoloom.session import stage

#: Learned from at most so many different texts of each language, and of all; landmarks likewise.
SAMPLE, SAMPLES, LANDMARKS, LANDMARKS_ALL = 400, 4000, 60, 400
RIDGE = 1e-2
UNKNOWN = "und"
#: Languages to learn at most; more is an error.
MAX_LANGUAGES = 200
#: Texts whose kernel rows are computed in one product.
BATCH = 256


def grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all n-grams of one, two and three bytes; orders don't share codes."""
    one = data.astype(np.int32)
    yield one
    two = (one[:-1] << 8) + one[1:]
    yield two + (1 << 8)
    yield (two[:-1] << 8) + one[2:] + ((1 << 16) + (1 << 8))


#: Bytes that are looked up at once.
PART = 1 << 20


@dataclass
class Model:
    """What a task needs to score texts; bounded by the sample."""

    vocabulary: np.ndarray  # sorted codes of n-grams of the landmarks
    landmarks: np.ndarray  # landmark x n-gram, 0 or 1, scaled to unit length
    weights: np.ndarray  # landmark (and one) x language
    names: list[str]

    def places(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """A class for each byte, and tables of where n-grams of classes stand in the vocabulary, by length.

        Bytes that no n-gram of the vocabulary has share class 0, so the tables
        are as large as the alphabet asks for, not as all bytes would.
        """
        if not hasattr(self, "_places"):
            ends = np.searchsorted(self.vocabulary, [1 << 8, (1 << 16) + (1 << 8)])
            kinds = [c - first for c, first in zip(np.split(self.vocabulary, ends), (0, 1 << 8, (1 << 16) + (1 << 8)))]
            letters = [np.array([(c >> 8 * k) & 255 for k in range(n, -1, -1)]) for n, c in enumerate(kinds)]
            used = np.unique(np.concatenate([x.ravel() for x in letters]))
            classes, base = np.zeros(256, np.int32), len(used) + 1
            classes[used] = np.arange(1, base)
            tables, at = [], 0
            for n, x in enumerate(letters):
                table = np.full(base ** (n + 1), len(self.vocabulary), np.int32)
                code = np.zeros(x.shape[1], np.int32)
                for own in classes[x]:
                    code = code * base + own
                table[code] = np.arange(at, at + x.shape[1], dtype=np.int32)
                tables.append(table)
                at += x.shape[1]
            self._places = classes, tables
        return self._places

    def presence(self, texts: list[bytes]) -> np.ndarray:
        """Which n-grams of the vocabulary each whole text has, at unit length; texts are read part by part."""
        classes, tables = self.places()
        base = np.int32(len(tables[0]))
        out = np.zeros((len(texts), len(self.vocabulary) + 1), np.float32)
        for row, text in zip(out, texts):
            data = np.frombuffer(text, np.uint8)
            for at in range(0, len(data), PART):
                one = classes[data[at:at + PART + 2]]
                two = one[:-1] * base + one[1:]
                row[tables[0][one]] = 1
                row[tables[1][two]] = 1
                row[tables[2][two[:-1] * base + one[2:]]] = 1
        out = out[:, :-1]
        out /= np.maximum(1, np.sqrt(out.sum(1, keepdims=True)))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One-versus-rest outputs: kernel to the landmarks times weights, in one product per batch."""
        kernel = self.presence(texts) @ self.landmarks.T
        return np.hstack([kernel, np.ones((len(texts), 1), np.float32)]) @ self.weights

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_places"}


def prepared(text: str | None) -> bytes:
    return (text or "").lower().encode()


def lettered(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def present(text: bytes) -> np.ndarray:
    """Sorted codes of the n-grams that a whole text has; long texts are read part by part."""
    data = np.frombuffer(text, np.uint8)
    seen = np.zeros(0, np.int32)
    for at in range(0, len(data), PART):
        seen = np.unique(np.concatenate([seen, *grams(data[at:at + PART + 2])]))
    return seen


def train(sample: pd.DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Ridge regression on Nyström features: (K_nm' K_nm + r n K_mm) w = K_nm' y for each language against the rest.

    ``sample`` has ``lang`` and ``codes``, the n-grams that a text has.
    """
    names = sorted(sample["lang"].unique())
    codes, lang = sample["codes"].tolist(), sample["lang"].to_numpy()
    landmarks = max(1, min(landmarks, LANDMARKS_ALL // len(names)))
    chosen = [k for name in names for k in np.flatnonzero(lang == name)[:landmarks]]
    vocabulary = np.unique(np.concatenate([codes[k] for k in chosen]))

    def rows(texts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(texts), len(vocabulary) + 1), np.float32)
        for row, own in zip(out, texts):
            at = np.searchsorted(vocabulary, own)
            row[np.where(vocabulary[np.minimum(at, len(vocabulary) - 1)] == own, at, len(vocabulary))] = 1
        out = out[:, :-1]
        return out / np.maximum(1, np.sqrt(out.sum(1, keepdims=True)))

    model = Model(vocabulary, rows([codes[k] for k in chosen]), np.zeros((0, 0)), names)
    kernel = np.concatenate([rows(codes[k:k + BATCH]) @ model.landmarks.T for k in range(0, len(codes), BATCH)]).astype(float)
    kernel = np.hstack([kernel, np.ones((len(codes), 1))])
    inner = np.zeros((kernel.shape[1],) * 2)
    inner[:-1, :-1] = model.landmarks @ model.landmarks.T
    wanted = np.where(lang[:, None] == np.array(names)[None], 1.0, -1.0)
    each = np.array([1 / max(1, (lang == name).sum()) for name in lang])[:, None]  # languages weigh the same
    left = kernel.T @ (each * kernel) + ridge * inner + 1e-9 * np.eye(len(inner))
    model.weights = np.linalg.solve(left, kernel.T @ (each * wanted)).astype(np.float32)
    return model


def training_sample(docs: DataFrame, text: str = "text", lang: str = "lang", each: int = SAMPLE) -> pd.DataFrame:
    """``lang`` and ``codes`` of at most ``each`` different texts with a letter per language, 4000 in all.

    Of a language's different texts, however often each is repeated, those with
    the smallest hashes are learned from, whole; tasks reduce them to the
    n-grams they have before anything is collected.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("_lang"), F.col(text).cast("string").alias("_text"), F.xxhash64(text).alias("_h"))
    keys = stage(rows.select("_lang", "_h").distinct())
    names = [r[0] for r in keys.select("_lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not names:
        return pd.DataFrame({"lang": [], "codes": []})
    first = Window.partitionBy("_lang").orderBy("_h")
    bars = (keys.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= min(each, SAMPLES // len(names)))
            .groupBy("_lang").agg(F.max("_h").alias("_bar")).collect())
    bar = F.create_map(*[F.lit(x) for r in bars for x in (r["_lang"], r["_bar"])])[F.col("_lang")]

    @F.pandas_udf("array<int>")
    def describe(texts: pd.Series) -> pd.Series:
        return pd.Series([present(prepared(t)) for t in texts], dtype=object)

    near = rows.filter(F.col("_h") <= bar).groupBy("_lang", "_h").agg(F.min("_text").alias("_text"))
    got = near.select("_lang", "_h", describe("_text").alias("codes")).toPandas().sort_values(["_lang", "_h"], ignore_index=True)
    return pd.DataFrame({"lang": got["_lang"], "codes": [np.asarray(c, np.int32) for c in got["codes"]]})


def predict(docs: DataFrame, model: Model, text: str = "text", into: str = "_judged") -> DataFrame:
    """Adds a struct ``into``: ``lang_pred``, ``score`` (0 to 1) and ``margin`` (the winning output, above 0 if a
    language claims the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, margin double")
    def judge(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for column in columns:
            parts = [pd.DataFrame({"lang_pred": [], "score": [], "margin": []}).astype({"lang_pred": object})]
            for at in range(0, len(column), BATCH):
                texts = column.iloc[at:at + BATCH].tolist()
                out = own.scores([prepared(t) for t in texts]).astype(float)
                best = out.argmax(1)
                margin = out[np.arange(len(out)), best]
                share = np.exp(4 * (out - out.max(1, keepdims=True)))
                score = 1 / share.sum(1)
                known = np.array([lettered(t) for t in texts])
                parts.append(pd.DataFrame({
                    "lang_pred": np.where(known, np.array(own.names, object)[best], UNKNOWN),
                    "score": np.where(known, np.clip(score, 0, 1), 0.0), "margin": np.where(known, margin, -1.0)}))
            yield pd.concat(parts, ignore_index=True)

    return docs.withColumn(into, judge(F.col(text).cast("string")))


def judged(docs: DataFrame, learn_from: DataFrame, text: str = "text", lang: str = "lang", into: str = "_judged") -> DataFrame:
    """``docs`` with a struct ``into`` of prediction, score and margin, learned from labelled ``learn_from``."""
    sample = training_sample(learn_from, text, lang)
    if sample.empty:
        return docs.withColumn(into, F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(-1.0).alias("margin")))
    return predict(docs, train(sample), text, into)


def identify(docs: DataFrame, learn_from: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Predicts the language of every text of ``docs`` from labelled ``learn_from``.

    Adds ``lang_pred``, ``score`` (0 to 1) and ``margin``; columns of these
    names that ``docs`` has already are replaced (judged() leaves them and
    writes a struct).  NULL texts and texts without a letter are ``und`` with
    score 0.  Without a labelled text all are ``und``; equal outputs go to the
    language first by name.  Rows keep all other columns, repeated rows get
    equal results, labels are no input of a prediction.  An empty table gives
    an empty one.
    """
    names, into = ("lang_pred", "score", "margin"), "_judged_language"
    found = judged(docs, learn_from, text, lang, into)
    return found.select(*[c for c in docs.columns if c not in names], *[F.col(into)[n].alias(n) for n in names])
