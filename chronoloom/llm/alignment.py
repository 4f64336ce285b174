"""Alignment of two tokenizations of the same bytes by pointer jumping.

Every token points to its farthest-right overlapping token of the other side;
doubling the pointers of a whole batch at once leads each token to the last one
of its component, which names the group.  Both tokenizers end a token in front
of a space that follows something else, so texts fall apart into chunks there;
equal chunks are aligned once per worker.  Links of all documents are counted in
blocks of bounded size: a block knows its chunks and id pairs, only counts of
pairs are shuffled, and totals come back to the block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoloom.llm.packing import SPACE, coder
from chronoloom.session import stage

#: Characters that are cut into chunks at once, chunks of a block (with repeats), chunks and links that a worker remembers.
SEGMENT, BLOCK, REMEMBERED, LINKS = 1 << 20, 1 << 19, 400_000, 4_000_000
#: Neither tokenizer has a token over this border, given that no piece has a space after another character.
BORDER = re.compile(f"(?<=[^{SPACE}])(?= )")
#: Where this is not found, the words between single spaces are the chunks.
ODD = re.compile(f"[{SPACE}] | [{SPACE}]")

_PIECES: dict[str, Pieces] = {}
_CHUNKS: dict[tuple[str, str], Chunks] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Spelling:
    """The bytes of each id of a vocabulary, to put tokens together again."""

    def __init__(self, tokens: dict[int, bytes]):
        self.length = np.zeros(max(tokens, default=0) + 1, np.int64)
        for k, token in tokens.items():
            self.length[k] = len(token)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens.get(k, b"") for k in range(len(self.length))), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.length[ids]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.flat[np.repeat(self.start[ids], size) + inside].tobytes()


class Pieces:
    """A SentencePiece model and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.spelling = Spelling({
            k: bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("\u2581", " ").encode()
            for k, p in enumerate(pieces)})
        if any(re.search("[^\u2581]\u2581", p) for p in pieces) or "\u2581" not in pieces:
            raise ValueError("a piece reaches over a space: texts cannot be cut there")
        self.space = pieces.index("\u2581")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that start with a space, the one which the model puts there itself."""
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [ids if t != " " else [self.space] for t, ids in zip(texts, found)]


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def words_of(text: str, most: int = SEGMENT) -> Iterator[list[str]]:
    """Chunks of space+text, some at a time.  A chunk that is a space and a word is given as the word, others start
    with the space."""
    text, at = " " + text, 0
    while at < len(text):
        border = BORDER.search(text, at + most) if len(text) - at > most else None
        end = border.end() if border else len(text)
        part = text[at:end]
        at = end
        if ODD.search(part) or part[-1] == " ":
            yield [c[1:] if c[1:] and not c[1:2].isspace() else c for c in BORDER.split(part)]
        else:
            yield part[1:].split(" ")


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B the last B token of its component.

    Ends are offsets of tokens without gaps over the same bytes.  Nodes are the
    tokens of A, then of B.  A token points to the token of the other side that
    holds its last byte, which is the farthest it overlaps; where both end
    together, A points to B and B to itself.
    """
    n, m = len(a_end), len(b_end)
    to_b = np.searchsorted(b_end, a_end, "left")
    to_a = np.searchsorted(a_end, b_end, "left")
    ends = a_end[to_a] == b_end if m else np.zeros(0, bool)
    succ = np.concatenate([n + to_b, np.where(ends, n + np.arange(m), to_a)])
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ[:n] - n, succ[n:] - n
        succ = further


class Aligned:
    """Groups and links of a batch of documents that both sides spell alike."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray):
        self.a, self.b = a, b
        a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
        last_a, last_b = terminals(a_end, b_end)
        names, label = np.unique(last_b, return_inverse=True)
        self.groups = len(names)
        self.b_group = label
        self.a_group = np.searchsorted(names, last_a)
        low = np.searchsorted(b_end, a_end - a_len, "right")
        high = np.searchsorted(b_end, a_end, "left")
        self.per_a = high - low + 1
        inside = np.arange(self.per_a.sum()) - np.repeat(np.cumsum(self.per_a) - self.per_a, self.per_a)
        self.links = (np.repeat(a, self.per_a) << 32) | b[np.repeat(low, self.per_a) + inside]

    def written(self, name: list[list[bytes]]) -> list[bytes]:
        """Tokens in order of groups, A before B in each; ``name`` has an id's text by what follows it."""
        n, m = len(self.a), len(self.b)
        at_a = np.arange(n) + np.searchsorted(self.b_group, self.a_group, "left")
        at_b = np.arange(m) + np.searchsorted(self.a_group, self.b_group, "right")
        code = np.empty(n + m, np.int64)
        ends_a = np.append(self.a_group[1:] != self.a_group[:-1], True)[:n]
        ends_b = np.append(self.b_group[1:] != self.b_group[:-1], True)[:m]
        code[at_a] = np.where(ends_a, 1, 0) + 3 * self.a
        code[at_b] = np.where(ends_b, 2, 0) + 3 * self.b
        self.code = code
        return list(map(name.__getitem__, code.tolist()))


def names_of(ids: int) -> list[bytes]:
    """Decimal ids followed by ',' inside a side, '|' after A and ';' after a group."""
    return [b"%d%s" % (k, end) for k in range(ids) for end in (b",", b"|", b";")]


class Chunks:
    """Chunks met so far: how both sides write them, aligned when first seen."""

    def __init__(self, path_a: str, path_b: str):
        self.side_a, self.side_b = coder(path_a, True).coder, pieces(path_b)
        alphabet = byte_alphabet()
        self.spelt = Spelling({k: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
                               for t, k in self.side_a.get_vocab().items()})
        self.name = names_of(max(len(self.spelt.length), len(self.side_b.spelling.length)))
        self.name_length = np.array([len(w) for w in self.name])
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[bytes] = []
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links; all 0 where the sides differ
        self.start = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)

    def spelt_alike(self, parts: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For chunks that are encoded as one text: tokens of A and of B, and chunks that both sides spell as they are.

        Where a text comes out otherwise, or a token reaches over a chunk's end, its halves are tried.
        """
        texts = ["".join(part) for part in parts]
        sides = zip(self.side_a.encode_batch_fast(texts, add_special_tokens=False), self.side_b.encode(texts))
        for part, text, (a, b) in zip(parts, texts, sides):
            raw = text.encode()
            a, b = np.array(a.ids, np.int64), np.array(b, np.int64)
            ends = np.cumsum([len(c.encode()) for c in part])
            if all(side.joined(ids) == raw and np.isin(ends, np.cumsum(side.length[ids])).all()
                   for side, ids in ((self.spelt, a), (self.side_b.spelling, b))):
                yield a, b, np.ones(len(part), bool)
            elif len(part) == 1:
                yield a[:0], b[:0], np.zeros(1, bool)
            else:
                yield from self.spelt_alike([part[:len(part) // 2], part[len(part) // 2:]])

    def learn(self, new: list[str]) -> None:
        """Encodes chunks, many as one text, and aligns them all in one batch of pointers."""
        last = [c for c in new if c[-1:].isspace()]  # what follows would change how a text ends
        rest = [c for c in new if not c[-1:].isspace()]
        new = rest + last
        full = [c if c[:1] == " " else " " + c for c in new]
        parts = [full[at:at + 1000] for at in range(0, len(rest), 1000)]
        if parts:
            parts[-1] = parts[-1][:len(rest) - 1000 * (len(parts) - 1)]
        a, b, good = (np.concatenate(x) for x in zip(*self.spelt_alike(parts + [[c] for c in full[len(rest):]])))
        sizes = np.zeros((len(new), 4), np.int64)
        texts = [b""] * len(new)
        links = np.zeros(0, np.int64)
        if len(a):
            a_len, b_len = self.spelt.length[a], self.side_b.spelling.length[b]
            both = Aligned(a, b, a_len, b_len)
            ends = np.cumsum([len(c.encode()) for c, ok in zip(full, good) if ok])
            to_a, to_b = np.searchsorted(np.cumsum(a_len), ends) + 1, np.searchsorted(np.cumsum(b_len), ends) + 1
            upto = np.stack([to_a, to_b, both.b_group[to_b - 1] + 1, np.cumsum(both.per_a)[to_a - 1]], 1)
            sizes[good] = np.diff(upto, axis=0, prepend=0)
            written = b"".join(both.written(self.name))
            cuts = np.cumsum(self.name_length[both.code])[to_a + to_b - 1].tolist()
            for k, lo, hi in zip(np.flatnonzero(good).tolist(), [0, *cuts], cuts):
                texts[k] = written[lo:hi - 1]
            links = both.links
        self.index.update(zip(new, range(len(self.text), len(self.text) + len(new))))
        self.text += texts
        self.start = np.append(self.start, len(self.links) + np.cumsum(sizes[:, 3]) - sizes[:, 3])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.links = np.concatenate([self.links, links])

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))

    def block(self, number: int, parts: list[tuple[int, np.ndarray]]) -> dict[str, object]:
        """Columns of a block: its pairs with counts, the pairs of its chunks, the chunks of its documents."""
        used, place, count = np.unique(np.concatenate([x for _, x in parts]), return_inverse=True, return_counts=True)
        size = self.sizes[used, 3]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        pairs, at = np.unique(self.links[np.repeat(self.start[used], size) + inside], return_inverse=True)
        small = lambda x, n: x.astype(np.uint16 if n <= 1 << 16 else np.uint32).tobytes()
        return {"_block": number, "_pairs": pairs, "_counts": np.bincount(at, np.repeat(count, size), len(pairs)).astype(np.int64),
                "_links": small(at, len(pairs)), "_link_ends": np.cumsum(size), "_places": small(place, len(used)),
                "_rows": np.array([k for k, _ in parts]), "_ends": np.cumsum([len(x) for _, x in parts])}


def chunks_of(path_a: str, path_b: str) -> Chunks:
    """One memory per worker and pair of files; tasks that follow each other share it."""
    if (path_a, path_b) not in _CHUNKS:
        _CHUNKS[path_a, path_b] = Chunks(path_a, path_b)
    return _CHUNKS[path_a, path_b]


LONGS, BYTES = pa.list_(pa.int64()), pa.binary()
FIELDS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
          ("groups_sha256", pa.string()), ("_row", pa.int64()), ("_block", pa.int64()), ("_pairs", LONGS), ("_counts", LONGS),
          ("_links", BYTES), ("_link_ends", LONGS), ("_places", BYTES), ("_rows", LONGS), ("_ends", LONGS)]


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str, text: str) -> DataFrame:
    """Rows of two kinds: documents (``_block`` NULL), and blocks of chunks that documents consist of."""
    segment, most = SEGMENT, BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = TaskContext.get().partitionId() << 33
        chunks, row, number = chunks_of(path_a, path_b), own, own
        kind = None
        held: list[tuple[int, np.ndarray]] = []
        filled = 0

        def table(keys: pa.Array, columns: dict[str, object]) -> pa.RecordBatch:
            arrays = [columns[c] if c in columns else pa.nulls(len(keys), t) for c, t in FIELDS]
            return pa.RecordBatch.from_arrays([keys, *arrays], names=["_key", *[c for c, _ in FIELDS]])

        def flush() -> pa.RecordBatch:
            nonlocal held, filled, number
            columns = chunks.block(number, held)
            held, filled, number = [], 0, number + 1
            return table(pa.nulls(1, kind), {c: pa.array([columns[c]], t) for c, t in FIELDS if c in columns})

        for batch in batches:
            kind = batch.column(0).type
            lo = 0
            while lo < batch.num_rows:
                # as many documents as have about a segment's characters, or one that is longer
                cut, size = [], 0
                while lo + len(cut) < batch.num_rows and size < segment:
                    value = batch.column(1)[lo + len(cut)].as_py() or ""
                    cut.append(list(words_of(value, segment)) if value else [])
                    size += len(value) + 64
                part = batch.slice(lo, len(cut))
                lo += len(cut)
                new = set().union(*[words for each in cut for words in each]).difference(chunks.index)
                if new:
                    chunks.learn(list(new))
                sizes, digests = np.zeros((part.num_rows, 4), np.int64), [""] * part.num_rows
                for k, lists in enumerate(cut):
                    ids = np.concatenate([np.zeros(0, np.int32), *map(chunks.numbers, lists)])
                    each = chunks.sizes[ids]
                    if not len(ids) or not each[:, 0].all():
                        continue
                    sizes[k] = each.sum(0)
                    digest = hashlib.sha256()
                    for at in range(0, len(ids), 1 << 16):
                        digest.update(b";" * (at > 0) + b";".join(map(chunks.text.__getitem__, ids[at:at + (1 << 16)].tolist())))
                    digests[k] = digest.hexdigest()
                    at = 0
                    while at < len(ids):
                        held.append((row + k, ids[at:at + most - filled]))
                        at += len(held[-1][1])
                        filled += len(held[-1][1])
                        if filled >= most:
                            yield flush()
                if len(chunks.text) > REMEMBERED or len(chunks.links) > LINKS:
                    if held:
                        yield flush()
                    chunks.forget()
                yield table(part.column(0), {"groups_sha256": pa.array(digests), "_row": pa.array(np.arange(row, row + part.num_rows)),
                                             **{c: pa.array(sizes[:, j]) for j, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}})
                row += part.num_rows
        if held:
            yield flush()

    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kinds = {pa.int64(): "long", pa.string(): "string", LONGS: "array<long>", BYTES: "binary"}
    return rows.mapInArrow(run, ", ".join([f"_key {rows.schema['_key'].dataType.simpleString()}", *[f"{c} {kinds[t]}" for c, t in FIELDS]]))


def pair_totals(blocks: DataFrame) -> DataFrame:
    """(_pair, _total, _best): how many links hold an id pair, and whether no other pair of its B id is in more."""
    counts = (blocks.select(F.explode(F.arrays_zip("_pairs", "_counts")).alias("_z"))
              .groupBy(F.col("_z._pairs").alias("_pair")).agg(F.sum("_z._counts").alias("_total")))
    counts = stage(counts.withColumn("_b", F.col("_pair").bitwiseAND(F.lit((1 << 32) - 1))))
    most = counts.groupBy("_b").agg(F.max("_total").alias("_most"))  # one row per id of B: bounded by the vocabulary
    return counts.join(F.broadcast(most), "_b").select("_pair", "_total", (F.col("_total") == F.col("_most")).alias("_best"))


def document_sums(blocks: DataFrame, totals: DataFrame) -> DataFrame:
    """(_row, n_best, count_sum): totals are sent to the blocks that hold a pair, where documents sum them up."""
    held = blocks.select(F.col("_block").alias("_of"), F.posexplode("_pairs").alias("_at", "_pair"))
    values = held.join(totals, "_pair").select("_of", "_at", "_total", "_best")

    def sums(own: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        own, at = own.iloc[0], values["_at"].to_numpy()
        read = lambda raw, n: np.frombuffer(raw, np.uint16 if n <= 1 << 16 else np.uint32)
        upto = lambda x, ends: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.asarray(ends, np.int64)])])
        links, places = read(own["_links"], len(values)), read(own["_places"], len(own["_link_ends"]))
        out = {"_row": own["_rows"]}
        for name, column in (("n_best", "_best"), ("count_sum", "_total")):
            worth = np.zeros(len(values), np.int64)
            worth[at] = values[column]
            out[name] = upto(upto(worth[links], own["_link_ends"])[places], own["_ends"])
        return pd.DataFrame(out)

    parts = (blocks.select("_block", "_links", "_link_ends", "_places", "_rows", "_ends").groupBy("_block").cogroup(values.groupBy("_of"))
             .applyInPandas(sums, "_row long, n_best long, count_sum long"))
    return parts.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: numbers of tokens, groups and links, and what the corpus says of its links.

    ``path_a`` is a byte-level vocabulary of the tokenizers library, which gets
    space+text, ``path_b`` a SentencePiece model, which adds the space itself;
    special tokens are plain text.  A group ends where both sides end a token.
    A link is an overlapping pair of tokens; ``count_sum`` adds up how many
    links corpus-wide hold the id pairs of a document's links, ``n_best`` counts
    links whose pair is, ties included, the commonest of its B id.
    ``groups_sha256`` hashes ``a1,a2|b1;a3|b2,b3``.

    NULL and empty texts, and those that a side spells otherwise, have no
    tokens: zeros and an empty string.  Long texts fall to several blocks.  Repeated rows each give a row and count each time;
    NULL keys are kept; further columns are ignored, whatever their names; an
    empty table gives an empty one.
    """
    both = stage(aligned(docs, path_a, path_b, key, text))
    rows = both.filter(F.col("_block").isNull())
    blocks = both.filter(F.col("_block").isNotNull())
    sums = document_sums(blocks, pair_totals(blocks))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "_row", "left").select(
        F.col("_key").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
