"""The text operators against brute force, exact round trips and held-out labels, on small tables with odd rows."""

import collections
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as cp
from chronoloom.llm import (
    brown as br, exact_dedup as dd, langid as li, mixing as mx, packing as pk, quality as ql, queries as qs,
    rabitq as rq, sharding as sh, simhash_trie as st, urls as ur)
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string"
ODD = [
    (1, "One fish two fish", "en", "a", 1, "x", "y"), (2, "ONE FISH TWO FISH", "en", "a", 1, "x", "y"),
    (3, None, None, None, None, None, None), (4, "", "en", "b", 0, None, None), (5, "É", "fr", "b", 1, None, None),
    (6, "é", "fr", "b", 1, None, None), (7, "wort " * 30_000, "de", "c", 9, None, None),
    (7, "wort " * 30_000, "de", "c", 9, None, None), (None, "no key", "en", "c", 6, None, None), (9, "123 !!", None, "", 6, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_exact_dedup(spark, odd, none):
    got = rows(dd.exact_dedup(odd, carry=["lang", "size"]))
    assert len(got) == len(ODD) and sum(r["kept"] for r in got) == 7
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[1][0]["keep_id"] == 2 and by[1][0]["group_size"] == 2 and not by[1][0]["kept"]
    assert by[3][0]["keep_id"] == 4 and by[5][0]["kept"] and by[6][0]["kept"]
    assert sorted(r["kept"] for r in by[7]) == [False, True]
    assert rows(dd.exact_dedup(none)) == []


def test_exact_dedup_slots_may_collide(odd):
    few = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows(dd.exact_dedup(odd, slots=1, prefix=1))}
    assert few == {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows(dd.exact_dedup(odd))}


def test_exact_dedup_sql(spark):
    assert compare(qs.QUERIES["op2_exact_dedup"](spark, SF), connect(SF), qs.ORACLES["op2_exact_dedup"]) == ""


def test_sharding(spark, odd, none):
    got = rows(sh.rendezvous(odd))
    assert len(got) == len(ODD)
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["size"] == len((t or "").encode()) + 8 for r in got for i, t, *_ in ODD if i == r["doc_id"])
    assert all(r["text_crc32"] == zlib.crc32((t or "").encode()) for r in got for i, t, *_ in ODD if i == r["doc_id"])
    assert rows(sh.rendezvous(none)) == []
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    few, more = (sh.rendezvous(many, weights=w) for w in ([1, 1, 2], [1, 1, 2, 1]))
    pair = few.select("doc_id", "shard", "grown_shard").join(more.select("doc_id", F.col("shard").alias("new")), "doc_id")
    assert pair.filter("new != grown_shard OR (new != shard AND new != 3)").count() == 0
    share = {r["shard"]: r["count"] / 20_000 for r in few.groupBy("shard").count().collect()}
    assert abs(share[2] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02


def test_flow_prefers_first_passes():
    flow = mx.min_cost_flow([(["a", "b"], 10), (["a"], 10)], {"a": 12, "b": 8}, 2)
    assert sum(flow[0].values()) <= 10 + 1e-6 and flow[0]["b"] == pytest.approx(8)
    assert flow[0].get("a", 0) + flow[1]["a"] == pytest.approx(12)


def test_water_fill():
    got = mx.water_fill({"a": 10, "b": 100, None: 10}, {"a": 3, "b": 1, None: 2}, 180, 2)
    assert got["a"] == 20 and got[None] == 20 and got["b"] == pytest.approx(140)


def test_mixing(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sized = docs.select("doc_id", "source", qs.word_count(F.col("text")).alias("size"))
    a, b = (sorted(map(tuple, mx.mix_by_source(sized).collect())) for _ in range(2))
    assert a == b and len(a) == docs.count()
    text = {r["doc_id"]: r for r in docs.collect()}
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for i, n, source_size, t, k in a:
        assert n == len(WORD.findall(text[i]["text"] or "")) and 0 <= k <= 2 * n
        s = text[i]["source"]
        taken[s] += k
        size[s] += n
        target[s] = t
        assert source_size == sum(len(WORD.findall(r["text"] or "")) for r in text.values() if r["source"] == s)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(target[s] <= 2 * size[s] + 1e-6 for s in target)
    assert sum(abs(taken[s] - target[s]) for s in target) < 0.1 * sum(target.values())
    assert len(mx.mix_by_source(odd.select("doc_id", "source", F.lit(3).alias("size"))).collect()) == len(ODD)
    assert mx.mix_by_source(none.select("doc_id", "source", F.lit(3).alias("size"))).collect() == []


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    path = qs.tokenizer_path()
    coder = Tokenizer.from_file(path)
    told = spark.createDataFrame([(20, "hello <|endoftext|> world"), (21, "<|endoftext|>" * 3 + "x")], "doc_id long, text string")
    some = odd.select("doc_id", "text", F.lit(3).alias("length"), F.lit(4).alias("offset")).dropDuplicates(["doc_id"])
    got = pk.pack_documents(some.unionByName(told, allowMissingColumns=True), path, keep_ids=True).toPandas()
    for i, text in {i: t for i, t, *_ in ODD}.items() | {(20, "hello <|endoftext|> world"), (21, "<|endoftext|>" * 3 + "x")}:
        mine = got[got["doc_id"].isna() if i is None else got["doc_id"] == i].sort_values("piece")
        ids = coder.encode(text or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(b"".join(mine["ids"]), "<u4").tolist() == ids
        assert mine["ids_crc32"].tolist() == [zlib.crc32(x) for x in mine["ids"]]
        assert mine["length"].tolist() == [len(ids) - 2048 * (len(mine) - 1)] + [2048] * (len(mine) - 1)
    full = pk.pack_documents(odd, path)
    table = full.toPandas().sort_values(["sequence_id", "offset"])
    for _, g in table.groupby("sequence_id"):
        assert g["length"].sum() <= 2048 and g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
    assert pk.pack_documents(none, path).collect() == []


def test_chunks_are_whole_tokens():
    from tokenizers import Tokenizer

    path, rng = qs.tokenizer_path(), np.random.default_rng(5)
    own, plain, coder = pk.Coder(path), pk.Coder(path, plain=True), Tokenizer.from_file(path)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "9", "!", "<|endoftext|>", "\0", "\xa0", "\x1c", "\x85", "한", " x"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(3000)]
    for side in (own, plain):
        coder.encode_special_tokens = side is plain
        for text, ids in zip(texts, side.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == coder.encode(text, add_special_tokens=False).ids


def test_plan_packs_what_there_is():
    rng = np.random.default_rng(2)
    counts = collections.Counter(int(x) for x in np.minimum(2048, rng.lognormal(6, 1, 20_000)) + 1 if x < 2048)
    plan = pk.plan(counts, 2048)
    used = collections.Counter()
    for n, lengths in plan:
        assert n > 0 and sum(lengths) <= 2048
        for v in lengths:
            used[v] += n
    assert used == counts
    assert sum(n for n, _ in plan) <= 1.01 * sum(k * v for k, v in counts.items()) / 2048 + 1
    assert pk.plan({}, 2048) == []


def test_rules(spark):
    def by_hand(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host):])[0], host.translate(LOW)
        fits = [r for _, r in qs.URL_RULES if (lambda n, p: (host == n or host.endswith("." + n)) and path.startswith(p))(
            r.split("/")[0], "/" + r.split("/", 1)[1])]
        return host, path, max(fits, key=len, default=None)

    urls = ["http://a.example.com/en/1", "http://WWW.example.com/en/2?x", "https://x.net/es/1#t", "net", None, "", "://", "a://com",
            "a://com/", "x://notcom/", "http://m.x.net/fr/://y.com/", "http://é.net/fr/"]
    table = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r["page_id"]: r for r in ur.judge(table, qs.URL_RULES).collect()}
    for k, u in enumerate(urls):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == by_hand(u), u
        if got[k]["rule"]:
            assert got[k]["verdict"] == dict((r, v) for v, r in qs.URL_RULES)[got[k]["rule"]]
    assert ur.judge(table.limit(0), qs.URL_RULES).collect() == []
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: by_hand(r["url"]) for r in pages.collect()}
    assert all((r["host"], r["path"], r["rule"]) == want[r["page_id"]] for r in qs.QUERIES["op4_url_filter"](spark, SF).collect())


def test_characters_tell_apart():
    good = [b"http://news.org/en/%d" % k for k in range(200)]
    bad = [b"http://casino.biz/win/%d" % k for k in range(200)]
    a, b = ur.Chars.of(good[:100]), ur.Chars.of(bad[:100])
    assert (ur.ratio(good[100:], a, b) > 0).all() and (ur.ratio(bad[100:], a, b) < 0).all()
    data, edge = ur.joined([b"ab"])
    total = sum(np.exp(a.logs(np.where(np.arange(len(data)) == ur.ORDER, c, data), edge)[0]) for c in range(256))
    assert total == pytest.approx(1)


def test_language(spark, odd, none):
    got = {r["doc_id"]: r for r in rows(qs.QUERIES["op5_language"](spark, "/root/testdata/sf0.01"))}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    held = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in held) and len(got) == len(docs)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.98
    judged = rows(li.identify(odd, odd))
    assert len(judged) == len(ODD) and all((r["lang_pred"] == "und") == (r["doc_id"] in (3, 4, 9)) for r in judged)
    assert all(0 <= r["score"] <= 1 for r in judged)
    assert li.identify(none, odd).collect() == []
    assert {r["lang_pred"] for r in rows(li.identify(odd, none))} == {"und"}


def test_language_learns_from_texts_not_copies(spark):
    """A text repeated 200,000 times is one text of its language."""
    copies = spark.range(200_000).select(F.lit("the weather is fine and they are here").alias("text"), F.lit("en").alias("lang"))
    some = [(f"this is the {k} thing that they have with them", "en") for k in range(40)]
    some += [(f"das ist die {k} Sache und sie haben es nicht", "de") for k in range(40)]
    table = copies.union(spark.createDataFrame(some, "text string, lang string"))
    sample = li.training_sample(table)
    assert sample["lang"].value_counts().to_dict() == {"en": 41, "de": 40}
    got = li.identify(spark.createDataFrame(some, "text string, lang string"), table).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
    first = li.training_sample(table, each=5)
    assert first["lang"].value_counts().to_dict() == {"en": 5, "de": 5}
    long = spark.createDataFrame([("a " * 5000 + "z q x", "en"), ("b", "de")], "text string, lang string")
    codes = li.training_sample(long).set_index("lang")["codes"]["en"]
    assert ord("q") in codes  # read to its end


def test_results_beside_columns_of_their_names(spark):
    """Names of results in the input: replaced in the result, kept by the stage of the pipeline."""
    rows_ = [(k, "this is a text about nothing " * 9, "en", 7, "lp", "m", 8, 9) for k in range(30)]
    table = spark.createDataFrame(rows_, "doc_id long, text string, lang string, score int, lang_pred string, margin string, predicted int, component_id int")
    judged = li.identify(table, table)
    assert sorted(judged.columns) == sorted(table.columns) and {r["lang_pred"] for r in judged.collect()} == {"en"}
    kept = cp.language(spark, table, SF)
    assert kept.columns == table.columns and {tuple(r)[3:] for r in kept.collect()} == {(7, "lp", "m", 8, 9)}
    marks = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    scored = ql.score(table, table, marks)
    assert sorted(scored.columns) == sorted(table.columns) and all(0 <= r["score"] <= 1 for r in scored.collect())
    for work in (cp.exact_copies, cp.near_copies):
        assert work(spark, table, SF).columns == table.columns


def test_language_stage_rejects(spark):
    """No letter, no known language, but never for being short."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    strange = [(-1, "Это русский текст о погоде и ни о чём другом. " * 8, None), (-2, "12 34", None), (-3, "Ja.", None), (-4, None, None),
               (-5, "日本語のテキストです。" * 30, None)]
    left = cp.language(spark, docs.union(spark.createDataFrame(strange, docs.schema)), SF)
    assert {r["doc_id"] for r in left.collect() if r["doc_id"] < 0} == {-3} and left.count() >= 0.99 * docs.count()


def test_quality(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in rows(qs.QUERIES["op6_quality"](spark, sf)) if r["held_out"] and r["doc_id"] in label]
    good, bad = ([r["score"] for r in got if label[r["doc_id"]] == k] for k in (1, 0))
    assert np.mean([(a > b) for a in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in got]) > 0.95
    marks = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1)], "doc_id long, quality int")
    judged = rows(ql.score(odd, odd, marks))
    assert len(judged) == len(ODD) and all(0 <= r["score"] <= 1 for r in judged)
    assert ql.score(none, none, marks).collect() == []


def test_brown(spark, odd, none):
    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    tokens = {r["doc_id"]: WORD.findall((r["text"] or "").translate(LOW)) + [None] for r in docs}
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t in tokens.items() if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    got = rows(qs.QUERIES["op7_brown"](spark, sf))
    assert len(got) == len(docs)
    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            out(r["doc_id"]), len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    model, counts = br.train(odd, frequent=3, moved=2, classes=2)
    scored = rows(br.score(odd, model, counts, carry=("size",)))
    assert len(scored) == len(ODD) and all(np.isfinite(r["score"]) and r["score"] < 0 for r in scored)
    assert np.allclose((10 ** model.step).sum(1), 1)
    model, counts = br.train(none)
    assert len(br.score(odd, model, counts).collect()) == len(ODD)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((3000, 32)) + 2 * rng.standard_normal((20, 32))[rng.integers(0, 20, 3000)]
    vectors[7] = vectors[8]
    data = [(k, v.tolist(), "x") for k, v in enumerate(vectors)]
    data += [(3001, None, ""), (3002, [0.0] * 32, ""), (3003, [float("nan")] * 32, ""), (3004, [None] * 32, ""), (3005, [1.0], ""),
             (0, vectors[0].tolist(), "again"), (None, vectors[1].tolist(), "")]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, rank string")
    got = collections.defaultdict(list)
    for r in sorted(rows(rq.search(table, F.col("_id") % 50 == 0)), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(3000), -s))[:5]
        hits += len({i for i, _ in got[q]} & set(want.tolist()))
        assert [x for _, x in got[q]] == pytest.approx([s[i] for i, _ in got[q]])
    assert hits >= 0.98 * 300 and len(got) == 60
    assert rq.search(table.limit(0), F.col("_id") % 50 == 0).collect() == []


def test_nearest_of_extreme_vectors(spark):
    """Neither squares that overflow nor squares that vanish take a vector out."""
    base = [3.0, 4.0, 1.0]
    data = [(0, base), (1, [x * 1e200 for x in base]), (2, [x * 1e-200 for x in base]), (3, [x * 1e3 for x in base]),
            (4, [1e300, -1e300, 1e-300]), (5, [5e-324, 0.0, 0.0]), (50, [-x * 1e200 for x in base])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in sorted(rq.search(table, F.col("_id") % 50 == 0, k=6).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert [i for i, _ in got[0]] == [1, 2, 3, 5, 4, 50] and [s for _, s in got[0]][:3] == pytest.approx([1, 1, 1])
    assert len(got[50]) == 6 and got[50][-1][1] == pytest.approx(-1)
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1e200, 1e200]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert rq.search(two, F.col("_id") % 2 == 0).count() == 6


def test_nearest_breaks_ties_by_id(spark):
    table = spark.createDataFrame([(k, [1.0, 1.0 if k < 9 else -1.0]) for k in range(12)], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"]) for r in rq.search(table, F.col("_id") == 5).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def links(prints, most=3):
    keys = sorted(prints)
    a = np.array([prints[k] for k in keys], np.uint64)
    label, near = np.arange(len(keys)), np.bitwise_count(a[:, None] ^ a[None]) <= most
    while True:
        new = np.array([label[near[i]].min() for i in range(len(keys))])
        if (new == label).all():
            return {k: keys[i] for k, i in zip(keys, label)}
        label = new


def simhash(text, shingle=3):
    words = WORD.findall((text or "").translate(LOW))
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, odd, none):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: simhash(t) for i, t in docs.items()}
    roots = links(prints)
    got = rows(qs.QUERIES["op9_simhash"](spark, SF))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {
        i: (format(prints[i], "016x"), roots[i]) for i in docs}
    strange = rows(st.near_copies(odd, carry=("kept",)))
    assert len(strange) == len(ODD)
    assert {r["component_id"] for r in strange if r["doc_id"] in (3, 4)} == {3}
    assert st.near_copies(none).collect() == []


@pytest.mark.parametrize("block", [4, 10_000])
def test_trie_loses_no_link(spark, block):
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2)
    prints = {}
    for k in range(500):
        p = int(centres[k % 12])
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            p ^= 1 << int(b)
        prints[k] = p
    table = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in prints.items()], "k long, _fp long")
    nodes = table.groupBy("_fp").agg(F.min("k").alias("least"))
    found = st.components(st.links(nodes.select("_fp"), block=block))
    placed = nodes.join(found, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    least = placed.groupBy("_root").agg(F.min("least").alias("c"))
    got = {r["k"]: r["c"] for r in table.join(placed.join(least, "_root").select("_fp", "c"), "_fp").collect()}
    assert got == links(prints)


def test_pipeline(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = cp.language(spark, docs, SF)
    assert first.columns == docs.columns and first.count() == len(table)  # all have letters
    second = cp.exact_copies(spark, cp.stage(first), SF)
    last = {}
    for i, t in table.items():
        last[t.translate(LOW)] = max(i, last.get(t.translate(LOW), i))
    assert sorted(r["doc_id"] for r in second.collect()) == sorted(last.values())
    third = cp.near_copies(spark, cp.stage(second), SF)
    roots = links({i: simhash(table[i]) for i in last.values()})
    stays = sorted(set(roots.values()))
    assert sorted(r["doc_id"] for r in third.collect()) == stays
    fourth = cp.stage(cp.mixture(spark, cp.stage(third), SF))
    assert fourth.columns == docs.columns
    copies = collections.Counter(r["doc_id"] for r in fourth.collect())
    assert set(copies) <= set(stays) and max(copies.values()) <= 2
    packed = cp.packing(spark, fourth, SF).toPandas()
    assert packed[packed["piece"] == 0].groupby("doc_id").size().to_dict() == dict(copies)
    assert sum(packed["length"]) and packed.groupby("sequence_id")["length"].sum().max() <= 2048
    strange = cp.near_copies(spark, cp.exact_copies(spark, cp.language(spark, odd, SF), SF), SF)
    assert sorted(r["doc_id"] for r in strange.filter("doc_id IS NOT NULL").collect()) == [2, 5, 6, 7]


def test_language_tables_follow_the_alphabet():
    """Tables as large as the bytes that n-grams have ask for; every n-gram is found where the vocabulary has it."""
    texts = [b"abc abd", "grün blau".encode(), b"z", b"", b"abzz ab"]
    vocabulary = np.unique(np.concatenate([li.present(t) for t in texts[:2]]))
    model = li.Model(vocabulary, np.zeros((1, len(vocabulary)), np.float32), np.zeros((2, 1)), ["a"])
    got = model.presence(texts)
    want = np.array([np.isin(vocabulary, li.present(t)) for t in texts])
    assert ((got > 0) == want).all()
    assert sum(t.size for t in model.places()[1]) < 10_000
