"""Class-based bigrams: Brown clustering by exchange, class transitions and word emissions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoloom.session import stage

#: Words with an entry in the shared table, of them those that the exchange moves, and classes it moves them to.
FREQUENT, MOVED, CLASSES = 50_000, 2_000, 48
#: A word with an entry occurs so often at least; what is rarer tells how likely unknown words are.
LEAST = 3
#: Pseudo-counts: of a word (fixed by the base model too) and of the unigram behind class transitions.
WORD, PRIOR = 0.1, 5.0
#: Kinds of rarer words: with a byte beyond ASCII, ending in a mark, with a digit.
KINDS = 8
_DIGITS = frozenset(b"0123456789")
#: Distinct words that a task counts before it hands them on.
HELD = 400_000


def kind(word: bytes) -> int:
    last = word[-1]
    return 4 * (not word.isascii()) + 2 * (last < 128 and not word[-1:].isalnum()) + (not _DIGITS.isdisjoint(word))


def _texts(docs: DataFrame, text: str, *more) -> DataFrame:
    return docs.select(F.col(text).cast("string").cast("binary").alias("_text"), *more)


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, kind, n) over all texts; counted in each task before the shuffle.  The NULL word is the end of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = list(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([kind(w) if w is not None else -1 for w in words], pa.int32()),
                 pa.array([seen[w] for w in words], pa.int64())], names=["word", "kind", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update((text.as_py() or b"").lower().split())
                seen[None] += 1
                if len(seen) > HELD:
                    yield rows()
                    seen.clear()
        yield rows()

    found = _texts(docs, text).mapInArrow(run, "word binary, kind int, n long")
    return found.groupBy("word", "kind").agg(F.sum("n").alias("n"))


def _sequences(batch: pa.RecordBatch, place: dict[bytes, int]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for text in batch.column(0):
        words = (text.as_py() or b"").lower().split()
        yield words, np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))


def count_codes(docs: DataFrame, text: str, size: int, codes) -> np.ndarray:
    """How often each number below ``size`` occurs in what ``codes`` makes of the batches; at most ``size`` rows are sent.

    Counts are doubles, exact up to 2^53.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            held = []
            for part in codes(batch):
                held.append(part)
                if sum(map(len, held[-1:])) > size or len(held) > 2000:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held = []
            if held:
                total += np.bincount(np.concatenate(held), minlength=size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["code", "n"])

    got = _texts(docs, text).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    for batch in got.to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, words: int, nodes: int, classes: int, rounds: int = 5) -> np.ndarray:
    """Class of each of the first ``words`` nodes; further nodes keep a class of their own.

    ``pairs`` holds counts, at left * nodes + right.  Words are visited by
    frequency; each goes to the class that most raises the mutual information
    of neighbouring classes, until a round moves none.
    """
    codes = np.flatnonzero(pairs)
    left, right, n = (codes // nodes).astype(np.int32), (codes % nodes).astype(np.int32), pairs[codes]
    size = classes + nodes - words
    label = np.concatenate([np.arange(words) % classes, classes + np.arange(nodes - words)])
    table = np.bincount(label[left] * size + label[right], n, size * size).reshape(size, size)

    def neighbours(a: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(a, kind="stable")
        return np.split(order, np.searchsorted(a[order], np.arange(1, nodes)))

    after, before = neighbours(left), neighbours(right)
    every, within = np.arange(size), np.arange(classes)
    for _ in range(rounds):
        moves = 0
        for w in range(words):
            e, b = after[w], before[w]
            if not len(e) and not len(b):
                continue
            own = n[e][right[e] == w].sum()
            e, b = e[right[e] != w], b[left[b] != w]
            r, l = np.bincount(label[right[e]], n[e], size), np.bincount(label[left[b]], n[b], size)
            old = label[w]
            table[old] -= r
            table[:, old] -= l
            table[old, old] -= own
            sums_l, sums_r = table.sum(1)[:classes], table.sum(0)[:classes]
            rows, cols = table[:classes], table[:, :classes].T
            gain_r, gain_l = _f(rows + r) - _f(rows), _f(cols + l) - _f(cols)
            same = table[within, within]
            gain = (gain_r.sum(1) - gain_r[within, within] + gain_l.sum(1) - gain_l[within, within]
                    + _f(same + r[:classes] + l[:classes] + own) - _f(same)
                    - _f(sums_l + r.sum() + own) + _f(sums_l) - _f(sums_r + l.sum() + own) + _f(sums_r))
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            moves += new != old
            label[w] = new
            table[new] += r
            table[:, new] += l
            table[new, new] += own
        if not moves:
            break
    return label[:words]


@dataclass
class Model:
    """Bounded: FREQUENT words, their classes and the tables of classes."""

    place: dict  # word -> number
    label: np.ndarray  # class of each frequent word
    step: np.ndarray  # log10 P(class | class before); the last class is the end
    emit: np.ndarray  # log10 P(word | class) of each frequent word
    base: np.ndarray  # log10 of its base probability
    base_end: float
    tokens: int
    words: int
    kind_size: list  # tokens of rarer words by kind, with pseudo-counts

    @property
    def rare(self) -> int:
        return len(self.step) - 1 - KINDS


def classed(words: list[bytes], ids: np.ndarray, label: np.ndarray, rare: int, end: int) -> np.ndarray:
    """Classes of a text between two ends."""
    out = np.full(len(ids) + 2, end)
    inner = out[1:-1]
    inner[:] = label[ids] if len(label) else 0
    for k in np.flatnonzero(ids < 0):
        inner[k] = rare + kind(words[k])
    return out


def train(docs: DataFrame, text: str = "text", frequent: int = FREQUENT, moved: int = MOVED,
          classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model and the counts of all words.

    Every training text is counted in full.  What reaches the driver is bounded
    by the parameters: the most frequent words, pairs of those that the
    exchange moves, classes beside frequent words, pairs of classes.  Frequent
    words that are not moved join the class whose neighbours are most like
    theirs; rarer words have a class by kind, and their counts stay in Spark.
    """
    counts = stage(count_words(docs, text))
    total = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first()
    tokens, distinct, ends = (int(x or 0) for x in total)
    top = counts.filter(F.col("word").isNotNull() & (F.col("n") >= LEAST)).orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    words = top.column("word").to_pylist()
    n = top.column("n").to_numpy().astype(float)
    place = {w: k for k, w in enumerate(words)}
    moved = min(moved, len(words))
    classes = max(1, min(classes, moved))
    spark = docs.sparkSession.sparkContext

    first = spark.broadcast({w: k for w, k in place.items() if k < moved})
    nodes = moved + 2  # any other word, and the end

    def pairs(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, ids in _sequences(batch, first.value):
            row = np.concatenate([[moved + 1], np.where(ids < 0, moved, ids), [moved + 1]])
            yield row[:-1] * nodes + row[1:]

    label = np.zeros(len(words), np.int64)
    if len(words):
        label[:moved] = exchange(count_codes(docs, text, nodes * nodes, pairs), moved, nodes, classes)
    own = spark.broadcast((place, label, moved))
    wide = classes + 2

    def beside(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        place, label, moved = own.value
        for _, ids in _sequences(batch, place):
            cls = np.full(len(ids) + 2, classes + 1)
            cls[1:-1] = np.where((ids < 0) | (ids >= moved), classes, label[ids] if len(label) else 0)
            known = np.flatnonzero(ids >= 0)
            yield (ids[known] * 2) * wide + cls[known]
            yield (ids[known] * 2 + 1) * wide + cls[known + 2]

    if len(words) > moved:
        near = count_codes(docs, text, 2 * wide * len(words), beside).reshape(len(words), 2, wide)
        member = np.zeros((classes, moved))
        member[label[:moved], np.arange(moved)] = 1
        both = [member.astype(np.float32) @ near[:moved, side] + 0.5 for side in (0, 1)]  # class, class before or after
        affinity = [np.log(b / b.sum(1, keepdims=True) / (b.sum(0) / b.sum())) for b in both]
        label[moved:] = (near[moved:, 0] @ affinity[0].T + near[moved:, 1] @ affinity[1].T).argmax(1)

    end = classes + KINDS
    final = spark.broadcast((place, label))

    def steps(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        place, label = final.value
        for words, ids in _sequences(batch, place):
            row = classed(words, ids, label, classes, end)
            yield row[:-1] * (end + 1) + row[1:]

    table = count_codes(docs, text, (end + 1) ** 2, steps).reshape(end + 1, end + 1)
    single = (table.sum(0) + WORD) / (table.sum() + WORD * (end + 1))
    step = np.log10((table + PRIOR * single) / (table.sum(1, keepdims=True) + PRIOR))
    in_class = np.bincount(label, n, classes) if len(words) else np.zeros(classes)
    kinds = {r["kind"]: (r["n"], r["words"]) for r in counts.filter("kind >= 0").groupBy("kind").agg(
        F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    for w, c in zip(words, n):
        a, b = kinds[kind(w)]
        kinds[kind(w)] = a - c, b - 1
    size = [float(kinds.get(k, (0, 0))[0] + WORD * (kinds.get(k, (0, 0))[1] + 1)) for k in range(KINDS)]
    below = tokens + WORD * (distinct + 1)
    return Model(place, label, step, np.log10(n / in_class[label]) if len(words) else n, np.log10((n + WORD) / below),
                 float(np.log10((ends + WORD) / below)), tokens, distinct, size), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, key: str = "doc_id", text: str = "text",
          carry: tuple = ()) -> DataFrame:
    """(key, carry, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of whole texts.

    Frequent words, which are the hot keys, are scored where the text is read.
    Only rarer words, once per document, are joined with their counts.  NULL
    counts as empty, which is the end alone; repeated rows each give a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        end = len(m.step) - 1
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for words, ids in _sequences(batch, m.place):
                row = classed(words, ids, m.label, m.rare, end)
                known = ids[ids >= 0]
                rare = Counter(words[k] for k in np.flatnonzero(ids < 0))
                values = (len(words) + 1, len(known) + (m.tokens > 0),
                          float(m.base[known].sum()) + m.base_end,
                          float(m.step[row[:-1], row[1:]].sum() + m.emit[known].sum()),
                          list(rare), [c * KINDS + kind(w) for w, c in rare.items()])
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *[pa.array(v, t) for v, t in zip(out, kinds)]],
                names=[*batch.schema.names[1:], "n_tokens", "n_known", "base", "model", "_words", "_codes"])

    rows = _texts(docs, text, F.col(key).alias("_key"), *carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    read = stage(rows.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, base double, model double, "
                                      "_words array<binary>, _codes array<long>")
                 .withColumn("_row", F.monotonically_increasing_id()))
    rare = read.select("_row", F.explode(F.arrays_zip("_words", "_codes")).alias("_r")).select(
        "_row", F.col("_r._words").alias("word"), F.col("_r._codes").alias("_code"))
    found = rare.join(counts.filter("word IS NOT NULL").select("word", F.col("n").alias("_c")), "word", "left")
    times, own = F.shiftright("_code", 3), F.coalesce(F.col("_c"), F.lit(0))
    below = F.array(*[F.lit(x) for x in model.kind_size])
    sums = found.groupBy("_row").agg(
        F.sum(F.when(F.col("_c").isNotNull(), times)).alias("_known"),
        F.sum(times * F.log10((own + WORD) / (model.tokens + WORD * (model.words + 1)))).alias("_base"),
        F.sum(times * F.log10((own + WORD) / F.get(below, F.col("_code").bitwiseAND(KINDS - 1).cast("int")))).alias("_model"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    return read.drop("_words", "_codes").join(sums, "_row", "left").select(
        F.col("_key").alias(key), *carry, "n_tokens", (F.col("n_known") + none("_known")).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + none("_base")).alias("base_score"),
        (F.col("model") + none("_model")).alias("score"))
