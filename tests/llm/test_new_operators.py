"""Jaccard join, alignment of tokenizers, ranked search: against SQL, brute force and odd rows."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import alignment as al, jaccard as jc, lexical as lx, queries as qs
from chronoloom.operators import skew
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, component_id long, _set string, rank int, n_a string, _key int"
TEXTS = [(1, "One fish two fish"), (2, "ONE  fish two FISH"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "wort " * 30_000),
         (7, "wort " * 30_000), (None, "no key"), (9, "123 !!"), (None, None), (10, " \t\n"), (11, "one fish\vtwo fish")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, 5, "s", 1, "n", 3) for k, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", ["op11_jaccard", "op13_lexical"])
def test_sql(spark, name):
    assert compare(qs.QUERIES[name](spark, SF), connect(SF), qs.ORACLES[name]) == ""


def sets_of(texts, n=3):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOW))
        out.append({" ".join(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    return out


def linked(keys, sets, percent=90):
    root = list(range(len(keys)))
    for i, j in itertools.combinations(range(len(keys)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    least = {}
    for k, r in zip(keys, root):
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return [least.get(r) for r in root]


def test_jaccard_odd_rows(odd, none):
    got = sorted(jc.near_sets(odd).collect(), key=str)
    keys, sets = [k for k, _ in TEXTS], sets_of([t for _, t in TEXTS])
    want = sorted(zip(keys, map(len, sets), linked(keys, sets)), key=lambda r: f"Row(doc_id={r[0]}, n_shingles={r[1]}")
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert jc.near_sets(none).collect() == []
    with pytest.raises(ValueError):
        jc.near_sets(odd, percent=100)


@pytest.mark.parametrize("percent, cells, block", [(90, 1 << 18, 4096), (70, 7, 8), (50, 1, 3)])
def test_jaccard_loses_no_link(spark, monkeypatch, percent, cells, block):
    """Copies at many distances, chains, a common passage and a hub, against all pairs; orders and blocks do not matter."""
    monkeypatch.setattr(jc, "CELLS", cells)
    monkeypatch.setattr(jc, "BLOCK", block)
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words, 40))
    texts = []
    for base in range(12):
        own = list(rng.choice(words, int(rng.integers(3, 90))))
        texts.append(" ".join(own))
        for _ in range(12):
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(0, len(own)))] = str(rng.choice(words))
            texts.append(" ".join(own))
        texts.append(" ".join(own) + " " + passage)
    hub = list(rng.choice(words, 60))
    for k in range(40):
        one = list(hub)
        one[k] = f"x{k}"
        texts.append(" ".join(one))
    texts += texts[:20] + [" ".join(hub)]
    keys = [int(k) for k in rng.permutation(len(texts))]
    table = spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string")
    sets = sets_of(texts)
    want = dict(zip(keys, linked(keys, sets, percent)))
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jc.near_sets(table, percent=percent).collect()}
    assert got == {k: (want[k], len(s)) for k, s in zip(keys, sets)}


def test_parity_never_hides_a_link(spark):
    """Parities of any two widths tell no more differences than there are."""
    rng = np.random.default_rng(8)
    for n in (9, 500, 513, 1500):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.95)], rng.integers(0, 1 << 62, n // 20 + 30).astype(np.uint64)]))
        pa, pb = jc.parity(a), jc.parity(b)
        w = min(len(pa), len(pb))
        fold = lambda p: p if len(p) == w else p[:w] ^ p[w:]
        assert np.bitwise_count((fold(pa) ^ fold(pb)).view(np.uint64)).sum() <= len(np.setxor1d(a, b))
        row = spark.createDataFrame([(pa.tolist(), pb.tolist(), len(a) + len(b))], "a array<long>, b array<long>, n long")
        differ = len(np.setxor1d(a, b))
        assert 100 * differ * 2 > (len(a) + len(b)) * 10 or row.filter(jc.parity_bound(F.col("a"), F.col("b"), F.col("n"), 90)).count() == 1


def test_join_with_hot_keys(spark):
    rows = spark.range(5000).select((F.when(F.col("id") < 3000, 7).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    got = skew.join_one(rows, table, ["k"], "n", rows_each=100)
    assert got.count() == 5000 and got.filter("k = 7 AND top != 2999").count() == 0
    left = skew.join_one(rows, table.filter("k = 7"), ["k"], "n", rows_each=100, how="left")
    assert left.count() == 5000 and left.filter("top IS NULL").count() == 2000


def by_hand(texts):
    """What align() has to return, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    side_a = Tokenizer.from_file(qs.tokenizer_path())
    side_a.encode_special_tokens = True
    side_b = sentencepiece.SentencePieceProcessor(model_file=qs.tokenizer_path("piece_bpe_32k.model"))
    alphabet = al.byte_alphabet()
    spelt_a = {k: bytes(alphabet[c] for c in t) for t, k in side_a.get_vocab().items()}
    spelt_b = [bytes([int(p[3:5], 16)]) if side_b.is_byte(k) else p.replace("▁", " ").encode()
               for k, p in enumerate(map(side_b.id_to_piece, range(side_b.get_piece_size())))]
    found, count = [], collections.Counter()
    for t in texts:
        a = side_a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = side_b.encode(t) if t else []
        full = (" " + t).encode() if t else b""
        if not t or b"".join(spelt_a[k] for k in a) != full or b"".join(spelt_b[k] for k in b) != full:
            found.append(None)
            continue
        spans = lambda ids, spelt: list(zip(ids, itertools.accumulate((len(spelt[k]) for k in ids), initial=0)))
        at_a, at_b = spans(a, spelt_a), spans(b, spelt_b)
        pairs = [(x, y) for x, p in at_a for y, q in at_b if p < q + len(spelt_b[y]) and q < p + len(spelt_a[x])] if len(a) < 300 else [
            (x, y) for x, p in at_a for y, q in at_b[max(0, np.searchsorted([v for _, v in at_b], p) - 2):] if q < p + len(spelt_a[x]) and p < q + len(spelt_b[y])]
        cuts = sorted({p for _, p in at_a} & {q for _, q in at_b}) + [len(full)]
        groups = [(",".join(str(x) for x, p in at_a if lo <= p < hi), ",".join(str(y) for y, q in at_b if lo <= q < hi))
                  for lo, hi in zip(cuts, cuts[1:])]
        count.update(pairs)
        found.append((len(a), len(b), pairs, groups))
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(0,) * 6 + ("",) if f is None else (
        f[0], f[1], len(f[3]), len(f[2]), sum(count[p] == best[p[1]] for p in f[2]), sum(count[p] for p in f[2]),
        hashlib.sha256(";".join(f"{x}|{y}" for x, y in f[3]).encode()).hexdigest()) for f in found]


@pytest.mark.parametrize("segment, block", [(1 << 20, 1 << 22), (20, 64)])
def test_alignment(spark, monkeypatch, segment, block):
    monkeypatch.setattr(al, "SEGMENT", segment)
    monkeypatch.setattr(al, "BLOCK", block)
    rng = np.random.default_rng(6)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "9", "!", "<|endoftext|>", "<s>", "\0", "\xa0", "한국", " x", "ing", "ﬁ", "▁"]
    texts = [None, "", " ", "  a  b ", "x▁y", "<|endoftext|> <s>", "a\n\nb\t c", "日本語 ﬁ①", "x" * 200, "word " * 60]
    texts += ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(150)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if len(r["text"]) < 400][:20]
    texts.append(texts[-1])
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in al.align(table, qs.tokenizer_path(), qs.tokenizer_path("piece_bpe_32k.model")).collect()}
    assert got == dict(enumerate(by_hand(texts)))


def test_alignment_odd_rows(odd, none):
    paths = qs.tokenizer_path(), qs.tokenizer_path("piece_bpe_32k.model")
    got = al.align(odd, *paths).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(k for k, _ in TEXTS)
    long = [r for r in got if r["doc_id"] == 7]
    assert long[0] == long[1] and long[0]["n_a"] > 30_000 and long[0]["groups_sha256"]
    assert all(r["n_links"] == 0 and r["groups_sha256"] == "" for r in got if r["doc_id"] in (3, 4))
    assert al.align(none, *paths).collect() == []


def test_terminals_by_chains():
    """A long chain of overlaps is one component; doubling needs few rounds and ends."""
    a, b = np.arange(2, 4002, 2), np.append(np.arange(1, 4000, 2), 4000)
    last_a, last_b = al.terminals(a, b)
    assert set(last_a) == set(last_b) == {len(b) - 1}
    last_a, last_b = al.terminals(np.array([3, 5, 9]), np.array([1, 3, 7, 9]))
    assert last_a.tolist() == [1, 3, 3] and last_b.tolist() == [1, 1, 3, 3]


def scores_by_hand(docs, items, k):
    held = [(key, collections.Counter(TERM.findall((t or "").translate(LOW)))) for key, t in docs]
    held = [(key, c) for key, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    out = collections.Counter()
    for item, text in items:
        asked = TERM.findall((text or "").translate(LOW))
        found = []
        for key, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 12 * m))
                    for w in asked if w in c)
            if s > 0:
                found.append((-s, key is None, key or 0, key))
        out.update((item, rank, key, -s) for rank, (s, _, _, key) in enumerate(sorted(found)[:k], 1))
    return out


@pytest.mark.parametrize("sizes", [(1024, 4096, 512, 400_000), (3, 2, 2, 4)])
def test_search(spark, monkeypatch, sizes):
    """Ties, repeated rows and items, NULLs; small tiles and many blocks give the same."""
    for name, v in zip(("DOCS", "TERMS", "ITEMS"), sizes):
        monkeypatch.setattr(lx, name, v)
    monkeypatch.setattr(lx.dense_products, "__defaults__", (sizes[1],))
    rng = np.random.default_rng(1)
    words = ["a", "B", "é", "x1", "Ünd", "the", "z"]
    docs = [(int(k), " ".join(rng.choice(words, int(rng.integers(0, 12))))) for k in rng.permutation(60)]
    docs += docs[:5] + [(None, "a b"), (None, "a b"), (70, None), (71, ""), (72, "!!"), (73, "the " * 50_000 + "q")]
    items = [(1, "a the-Z"), (1, "a the-Z"), (2, "a a a B"), (3, None), (4, ""), (5, "nothing"), (None, "é ünd X1"), (6, "q," * 9)]
    table = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, rank int, score int")
    asked = spark.createDataFrame([(k, t, 1, 2) for k, t in items], "item_id int, text string, rank int, doc_id int")
    got = lx.search(table, asked, k=4, block=sizes[3])
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == scores_by_hand(docs, items, 4)
    assert lx.search(table.limit(0), asked).collect() == lx.search(table, asked.limit(0)).collect() == []


def test_layers_stay_exact():
    """Weights beyond 2^53 in sum are divided, and the layers add up to them."""
    item, term = np.array([0, 0, 0, 1]), np.array([2, 0, 1, 0])
    weight = np.array([lx.LIMIT * 2 + 5, lx.LIMIT - 1, 7, 3])
    parts = lx.layers(item, term, weight)
    back = collections.Counter()
    for i, t, w in parts:
        sums = np.bincount(i, w, minlength=2)
        assert (sums <= lx.LIMIT).all()
        back.update({(int(a), int(b)): int(c) for a, b, c in zip(i, t, w)})
    assert +back == {(int(a), int(b)): int(c) for a, b, c in zip(item, term, weight)}
    scores = lx.dense_products(1, np.zeros(3, int), np.arange(3), np.full(3, lx.IMPACT - 1), parts, 3, 0, 2)
    assert scores.tolist() == [[int(weight[:3].sum()) * (lx.IMPACT - 1), 3 * (lx.IMPACT - 1)]]
