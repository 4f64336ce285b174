"""URL filters: rules by host and path, and the ratio of two character models for the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chronoloom.llm.text import ascii_lower

#: URLs of each verdict that are learned from at most, and the longest context in bytes.
SAMPLE, ORDER = 20_000, 5


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (verdict, host and path) that fits, as a struct (rule, verdict); NULL if none does.

    Rules are looked up by the host and each domain above it, in a map of the
    caller's list: no join, and long lists cost no more per URL than short ones.
    """
    table: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        table.setdefault(name, []).append((slash + rest, rule, verdict))
    literal = F.create_map(*[x for name, rows in table.items() for x in (
        F.lit(name), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"))
                               for p, r, v in rows]))])
    labels = F.split(host, r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))
    fitting = F.filter(F.flatten(F.filter(F.transform(names, lambda x: F.element_at(literal, x)), lambda x: x.isNotNull())),
                       lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"),
                                                              r["verdict"].alias("verdict"))))
    return F.when(F.size(fitting) > 0, best)


@dataclass
class Chars:
    """A variable-order Markov model of bytes: counts of contexts up to ORDER, smoothed by Witten-Bell."""

    tables: list  # per order: sorted codes of context and byte, their counts, sorted contexts, totals, distinct followers

    @staticmethod
    def codes(data: np.ndarray, order: int) -> np.ndarray:
        """Numbers of the last ``order`` bytes and the next, at each position with as many before it."""
        out = np.zeros(max(0, len(data) - order), np.int64)
        for k in range(order + 1):
            out = (out << 8) | data[k:k + len(out)]
        return out

    @classmethod
    def of(cls, urls: Sequence[bytes], order: int = ORDER) -> Chars:
        data, edge = joined(urls, order)
        tables = []
        for k in range(order + 1):
            codes = cls.codes(data, k)[edge[k:]]
            grams, n = np.unique(codes, return_counts=True)
            contexts, place = np.unique(grams >> 8, return_inverse=True)
            tables.append((grams, n, contexts, np.bincount(place, n), np.bincount(place)))
        return cls(tables)

    def logs(self, data: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Natural log-probability of every byte that is not padding; an unseen context hands on to the shorter one."""
        p = np.full(int(edge.sum()), 1 / 256)
        for k, (grams, n, contexts, total, kinds) in enumerate(self.tables):
            codes = self.codes(data, k)[edge[k:]]

            def found(keys: np.ndarray, of: np.ndarray, values: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(keys, of), max(0, len(keys) - 1))
                return np.where(keys[at] == of, values[at], 0) if len(keys) else np.zeros(len(of))

            all_, new = found(contexts, codes >> 8, total), found(contexts, codes >> 8, kinds)
            p = np.where(all_ > 0, (found(grams, codes, n) + new * p) / np.maximum(1, all_ + new), p)
        return np.log(p)


def joined(urls: Sequence[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All URLs in one array, each after ``order`` zero bytes and before one, and which bytes are to be predicted."""
    pad = b"\0" * order
    data = np.frombuffer(b"".join(pad + u + b"\0" for u in urls), np.uint8).astype(np.int64)
    edge = np.ones(len(data), bool)
    starts = np.cumsum([0] + [len(u) + order + 1 for u in urls])[:-1]
    for k in range(order):
        edge[starts + k] = False
    return data, edge


def ratio(urls: Sequence[bytes], good: Chars, bad: Chars) -> np.ndarray:
    """Log-likelihood difference per byte."""
    if not len(urls):
        return np.zeros(0)
    data, edge = joined(urls)
    difference = good.logs(data, edge) - bad.logs(data, edge)
    lengths = np.array([len(u) + 1 for u in urls])
    return np.add.reduceat(difference, np.cumsum(lengths) - lengths) / lengths


def calibrated(scores: np.ndarray, good: np.ndarray) -> float:
    """The bar with the fewest wrong verdicts, both kinds weighing the same; of equals, the middle one."""
    if not good.any() or good.all():
        return -np.inf if good.any() else np.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    wrong = np.concatenate([[0], np.cumsum(g) / g.sum()]) + 1 - np.concatenate([[0], np.cumsum(~g) / (~g).sum()])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    k = int(best[len(best) // 2])
    return s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url",
          each: int = SAMPLE) -> DataFrame:
    """(key, host, path, rule, verdict, ratio) of every row.

    URLs that a rule decides teach the two models: at most ``each`` per
    verdict, those with the smallest hashes.  One half sets the models, the other
    the bar, as a model is too sure of what it has seen; then both halves set
    the models.  A URL no rule fits is allowed if its ratio reaches the bar.
    NULL and URLs without :// have empty host and path and are judged as they
    are, NULL as the empty text.  If rules decide nothing, all are allowed.
    Extra columns are ignored; repeated rows get the same verdict.
    """
    rows = pages.select(F.col(key), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_url"))
    rows = rows.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    taught = rows.filter("_rule IS NOT NULL").select(
        F.col("_rule.verdict").alias("verdict"), F.encode("_url", "UTF-8").alias("u"), F.xxhash64("_url").alias("h"))
    parts = [taught.filter(F.col("verdict") == v).orderBy("h", "u").limit(each) for v in ("allow", "block")]
    sample = parts[0].unionByName(parts[1]).toPandas()
    texts, good = [bytes(u) for u in sample["u"]], (sample["verdict"] == "allow").to_numpy(bool)
    half = (sample["h"].to_numpy(np.int64) & 1) == 0
    pick = lambda mask: [t for t, m in zip(texts, mask) if m]
    trial = ratio(pick(~half), Chars.of(pick(half & good)), Chars.of(pick(half & ~good)))
    bar = float(calibrated(trial, good[~half])) if good.any() and not good.all() else -np.inf if good.any() or not len(good) else np.inf
    shared = pages.sparkSession.sparkContext.broadcast((Chars.of(pick(good)), Chars.of(pick(~good))))

    @F.pandas_udf("double")
    def differ(column: pd.Series) -> pd.Series:
        return pd.Series(ratio([u.encode() for u in column], *shared.value))

    return rows.withColumn("ratio", differ("_url")).select(
        key, "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("ratio") >= bar, "allow").otherwise("block")).alias("verdict"), "ratio")
