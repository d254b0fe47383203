"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, kept as sorted hash arrays that workers map.

1. Words: each task counts the hashes of its training words; groups by hash range sum them. Words are
   numbered by their counts within a range, range after range, so that frequent ones have small numbers.
2. n-grams of the highest order: each task maps its words to numbers, counts n-grams and deals them by
   the hash of the context, all words but the last; a group has all n-grams of its contexts and writes
   their sorted keys and counts. For the next lower order it deals out how many words stand before
   each shorter n-gram; these counts are summed and written in the same way, down to single words.
3. Scoring: each task maps the arrays and looks its sorted keys up, order by order.

A key has the context's hash in its upper 36 bits and the last word's in the lower 28, so that a context's
n-grams stand side by side; its sums are added up on the spot, those of contexts with many n-grams are
kept. Within a shard two contexts fall together with odds of one in 7e10, two words of a context in 3e8.

The arrays are files in the session's shared folder (spark.checkpoint.dir, mounted on all machines);
a task writes a file under a name of its own and renames it, so that a task that is run again is harmless.
The driver holds a few numbers for each range only. Ranges follow the number of shuffle partitions.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import mounted, remainder_of_id, shared_path, table

U = np.uint64
START = 0  # stands before a text's first word
UNKNOWN = (1 << 64) - 1
#: Words, and n-grams, that are counted together before they are dealt out.
HELD_WORDS, HELD = 1 << 22, 1 << 20
#: Bits of a key that the last word has.
WORD_BITS = 28
#: The sums of contexts with more n-grams than this are kept.
RUN = 16


def squeezed(x: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers as bytes: differences if they ascend, their bytes by place, compressed."""
    d = np.diff(x.astype(np.uint64), prepend=U(0)) if ascending else x.astype(np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(len(d), 8).T).tobytes())


def restored(b: bytes, ascending: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    x = np.ascontiguousarray(raw.reshape(8, len(raw) // 8).T).reshape(-1).view(np.uint64)
    return np.cumsum(x, dtype=np.uint64) if ascending else x


def saved(folder: str, name: str, x: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, x)
    os.replace(own, f"{folder}/{name}.npy")


def mapped(folder: str, name: str) -> np.ndarray:
    path = f"{folder}/{name}.npy"
    return np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    c = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], (np.add.reduceat(c, at) if len(at) else c)


def dealt_rows(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and their counts by range; bounds: first key of each range but the first."""
    edges = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    shards = np.flatnonzero(np.diff(edges))
    parts = [slice(edges[s], edges[s + 1]) for s in shards]
    return rows(shards, [[squeezed(keys[p], True)] for p in parts], [squeezed(counts[p]) for p in parts])


ROW = "shard int, w array<binary>, c binary"


def rows(shards, w: list[list[bytes]], c: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(w, pa.list_(pa.binary())), pa.array(c, pa.binary())], names=["shard", "w", "c"])


def told(*numbers: int) -> pa.RecordBatch:
    """A row for the driver; it passes through the groups below."""
    return rows([-1], [[]], [np.asarray(numbers, "<i8").tobytes()])


def merged(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """The shard, its keys and their sums; parts are summed a few at a time."""
    keys, counts, size = [], [], 0
    for w, c in zip(t["w"].to_pylist(), t["c"].to_pylist(), strict=True):
        keys.append(restored(w[0], True))
        counts.append(restored(c))
        size += len(keys[-1])
        if size > 1 << 22:
            k1, c1 = summed(keys, counts)
            keys, counts, size = [k1], [c1], 0
    return t["shard"][0].as_py(), *summed(keys, counts)


def chain(words: list[np.ndarray]) -> np.ndarray:
    """Hash of runs of word numbers, given place by place."""
    h = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        h = hashing.mix(h * hashing.P + w)
    return h


def key_of(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (context >> U(WORD_BITS) << U(WORD_BITS)) | (hashing.mix(word + U(1)) >> U(64 - WORD_BITS))


def shard_of(context: np.ndarray, n: int) -> np.ndarray:
    return ((hashing.mix(context) >> U(20)) % U(n)).astype(np.int64)


def dealt_grams(words: list[np.ndarray], counts: np.ndarray, n: int) -> pa.RecordBatch:
    """Distinct n-grams (their words place by place) and counts by the shard of their context."""
    shard = shard_of(chain(words[:-1]), n)
    order = np.lexsort((*words[:0:-1], (shard.astype(np.uint64) << U(48)) | (words[0] & U((1 << 48) - 1))))
    words, counts, edges = [w[order] for w in words], counts[order], np.searchsorted(shard[order], np.arange(n + 1))
    shards = np.flatnonzero(np.diff(edges))
    parts = [slice(edges[s], edges[s + 1]) for s in shards]
    return rows(shards, [[squeezed(w[p], k == 0) for k, w in enumerate(words)] for p in parts], [squeezed(counts[p]) for p in parts])


def merged_grams(t: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of one shard: sorted keys, counts, and the words place by place."""
    held: list[tuple[np.ndarray, list[np.ndarray]]] = []
    size = 0

    def together() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        counts, words = np.concatenate([c for c, _ in held]), [np.concatenate(w) for w in zip(*(w for _, w in held), strict=True)]
        keys = key_of(chain(words[:-1]), words[-1])
        at = np.argsort(keys, kind="stable")
        keys = keys[at]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts[at], first), [w[at[first]] for w in words]

    for w, c in zip(t["w"], t["c"], strict=True):
        held.append((restored(c.as_py()), [restored(x.as_py(), k == 0) for k, x in enumerate(w)]))
        size += len(held[-1][0])
        if size > 1 << 22:
            _, c1, w1 = together()
            held, size = [(c1, w1)], 0
    return together()


def distinct(words: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    h, first, back = np.unique(chain(words), return_index=True, return_inverse=True)
    return [w[first] for w in words], np.bincount(back, counts, len(h)).astype(np.uint64)


def write_grams(t: pa.Table, order: int, folder: str, n: int, top: int) -> pa.Table:
    """Writes the arrays of one shard of n-grams; returns what it has for the next lower order, and its counts of counts."""
    s = t["shard"][0].as_py()
    if s < 0:
        return t
    keys, counts, words = merged_grams(t, order)
    context = keys >> U(WORD_BITS)
    at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    long = np.diff(np.append(at, len(keys))) > RUN
    sums = np.stack([context[at], *(np.add.reduceat(x.astype(np.uint64), at) for x in (counts, counts == 1, counts == 2, counts >= 3))])
    many = np.flatnonzero(counts >= 255)
    saved(folder, f"long-{order}-{s}", sums[:, long])
    saved(folder, f"many-{order}-{s}", np.stack([many.astype(np.uint64), counts[many]]))
    saved(folder, f"counts-{order}-{s}", np.minimum(counts, 255).astype(np.uint8))
    saved(folder, f"keys-{order}-{s}", keys)  # the file that is written last
    # an n-gram is one word before the rest; nothing stands before a text's begin, so there it counts as often as it stands
    first = (words[0] == U(START)) & (words[1] == U(START)) if order > 2 else np.zeros(len(keys), bool)
    less, follow = distinct(words[1:], np.where(first, counts, 1))
    if order > 2:
        out = dealt_grams(less, follow, n)
    else:
        by = np.argsort(less[0])
        out = dealt_rows(less[0][by], follow[by], word_bounds(top, n))
    return pa.Table.from_batches([out, told(order, *of_counts(counts))])


def spread(top: int, n: int) -> np.ndarray:
    """Bounds that cut 0..top into n ranges of one length."""
    return np.asarray([top * i // n for i in range(1, n)], np.uint64)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end; where each text begins, and the total."""
    h, at = hashing.documents(texts)
    n = np.diff(at) + 1
    starts = np.concatenate([[0], np.cumsum(n)])
    out = np.full(starts[-1], hashing.END, np.uint64)
    inner = np.ones(starts[-1], bool)
    inner[starts[1:] - 1] = False
    out[inner] = h
    return out, starts


class Words:
    """Numbers of words, by hash, from the mapped arrays."""

    def __init__(self, folder: str, sizes: list[int]) -> None:
        self.parts = [mapped(folder, f"words-{s}") if n else np.zeros(0, np.uint64) for s, n in enumerate(sizes)]
        self.counts = [mapped(folder, f"counts-{s}") if n else np.zeros(0, np.int64) for s, n in enumerate(sizes)]
        self.ranks = [mapped(folder, f"ranks-{s}") if n else np.zeros(0, np.uint32) for s, n in enumerate(sizes)]
        self.bounds = spread(1 << 64, len(sizes))

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted hashes: numbers (UNKNOWN if not in training) and counts."""
        out, count = np.full(len(h), UNKNOWN, np.uint64), np.zeros(len(h), np.int64)
        edges = np.concatenate([[0], np.searchsorted(h, self.bounds), [len(h)]])
        for s, part in enumerate(self.parts):
            lo, hi = edges[s], edges[s + 1]
            if lo < hi and len(part):
                at = np.minimum(np.searchsorted(part, h[lo:hi]), len(part) - 1)
                known = part[at] == h[lo:hi]
                out[lo:hi][known] = 1 + self.ranks[s][at[known]].astype(np.uint64) * U(len(self.parts)) + U(s)
                count[lo:hi][known] = self.counts[s][at[known]]
        return out, count


def numbered(words: Words, texts: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of the texts' tokens: the numbers of the n-gram that ends there, place by place, and their counts; and where each text begins."""
    h, starts = tokens(texts)
    u, back = np.unique(h, return_inverse=True)
    ids, count = words(u)
    out = [ids[back]]
    for _ in range(order - 1):
        before = np.empty_like(out[0])
        before[1:] = out[0][:-1]
        before[starts[:-1]] = START
        out.insert(0, before)
    return out, count[back], starts


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4; 0.5, 1, 1.5 where those don't tell."""
    d = np.asarray([0.0, 0.5, 1.0, 1.5])
    if (n[:4] > 0).all():
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            v = k - (k + 1) * y * n[k] / n[k - 1]
            d[k] = v if 0 < v < k else d[k]
    return d


def of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


class Model:
    """What a worker needs to score: the folder's arrays and a few numbers. Small enough to be sent with a task."""

    def __init__(self, folder: str, sizes: list[int], total: int, ranges: int, order: int, counts: dict[int, np.ndarray]) -> None:
        """counts: of each order how many n-grams have a count of 1 to 4; of order 1 also the sum of the counts and how many are 3 and more."""
        self.folder, self.sizes, self.total, self.ranges, self.order = folder, sizes, total, ranges, order
        self.v, self.top = sum(sizes), top_number(sizes)
        self.d = {m: discounts(c[:4].astype(float)) for m, c in counts.items()}
        self.follow_total, self.opened = int(counts[1][4]), False
        self.left1 = float(np.dot([*counts[1][:2], counts[1][5]], self.d[1][1:]))  # what the discounts take from the words

    def open(self) -> Model:
        if not self.opened:
            self.words = Words(self.folder, self.sizes)
            self.arrays: dict[tuple[int, int], tuple] = {}
            self.opened = True
        return self

    def shard(self, order: int, s: int) -> tuple | None:
        """keys, counts, counts from 255 on, sums of long contexts; None if the shard is empty."""
        if (order, s) not in self.arrays:
            there = os.path.exists(f"{self.folder}/keys-{order}-{s}.npy")
            self.arrays[order, s] = tuple(mapped(self.folder, f"{x}-{order}-{s}") for x in ("keys", "counts", "many", "long")) if there else None
        return self.arrays[order, s]

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        """Probabilities of distinct sorted word numbers from how many contexts they follow."""
        n = np.zeros(len(ids), np.int64)
        bounds = word_bounds(self.top, self.ranges)
        edges = np.concatenate([[0], np.searchsorted(ids, bounds), [len(ids)]])
        for s in range(self.ranges):
            lo, hi = edges[s], edges[s + 1]
            if lo < hi and os.path.exists(path := f"{self.folder}/follow-{s}.npy"):
                own = np.load(path, mmap_mode="r")
                known = ids[lo:hi] < self.top
                n[lo:hi][known] = own[(ids[lo:hi][known] - U(int(bounds[s - 1]) if s else 0)).astype(np.int64)]
        rest = 1 / (self.v + 1)
        if not self.follow_total:
            return np.full(len(ids), rest)
        return np.maximum(n - self.d[1][np.minimum(n, 3)], 0) / self.follow_total + self.left1 / self.follow_total * rest

    def found(self, order: int, s: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted keys of a shard: their counts, their contexts' totals, and what the discounts take from these."""
        d = self.d[order]
        c, total, left = np.zeros(len(k), np.int64), np.zeros(len(k)), np.zeros(len(k))
        if (arrays := self.shard(order, s)) is None:
            return c, total, left
        own, small, many, long = arrays

        def counts(at: np.ndarray) -> np.ndarray:
            x = small[at].astype(np.int64)
            if len(full := np.flatnonzero(x == 255)):
                x[full] = many[1][np.searchsorted(many[0], at[full].astype(np.uint64))]
            return x

        at = np.minimum(np.searchsorted(own, k), len(own) - 1)
        hit = own[at] == k
        c[hit] = counts(at[hit])
        context, back = np.unique(k >> U(WORD_BITS), return_inverse=True)
        first = np.searchsorted(own, context << U(WORD_BITS))
        n = np.searchsorted(own, (context << U(WORD_BITS)) | U((1 << WORD_BITS) - 1), side="right") - first
        sums = np.zeros((len(context), 4))
        some = np.flatnonzero((n > 0) & (n <= RUN))
        if len(some):
            m = n[some]
            begin = np.cumsum(m) - m
            x = counts(np.arange(m.sum()) + np.repeat(first[some] - begin, m))
            sums[some] = np.stack([np.add.reduceat(y, begin) for y in (x, x == 1, x == 2, x >= 3)], 1)
        if len(some := np.flatnonzero(n > RUN)):
            sums[some] = long[1:, np.searchsorted(long[0], context[some])].T
        return c, sums[back, 0], (sums[:, 1:] @ d[1:])[back]

    def probabilities(self, words: list[np.ndarray]) -> np.ndarray:
        """Of the last word of n-grams, given place by place."""
        u, back = np.unique(words[-1], return_inverse=True)
        p = self.unigram(u)[back]
        for order in range(2, self.order + 1):
            context = chain(words[-order:-1])
            key, shard = key_of(context, words[-1]), shard_of(context, self.ranges)
            by = np.lexsort((key, shard))
            key, edges = key[by], np.searchsorted(shard[by], np.arange(self.ranges + 1))
            c, total, left = np.zeros(len(by), np.int64), np.zeros(len(by)), np.zeros(len(by))
            for s in np.flatnonzero(np.diff(edges)):
                part = slice(edges[s], edges[s + 1])
                c[by[part]], total[by[part]], left[by[part]] = self.found(order, int(s), key[part])
            seen = total > 0
            safe = np.where(seen, total, 1)
            p = np.where(seen, np.maximum(c - self.d[order][np.minimum(c, 3)], 0) / safe + left / safe * p, p)
        return p


def top_number(sizes: list[int]) -> int:
    """All words have smaller numbers."""
    return max(sizes) * len(sizes) + 1


def word_bounds(top: int, n: int) -> np.ndarray:
    return spread(top, n)


def train(docs: DataFrame, order: int = 3, folder: str | None = None) -> Model:
    """The model of n-grams of up to `order` (2 or more) words of all rows of docs(text); null is an empty text. An empty table gives a model without words."""
    spark = docs.sparkSession
    folder = mounted(folder or shared_path(spark, "kneser-ney"))
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = docs.select(F.col("text").cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch], of, dealt, most: int) -> Iterator[pa.RecordBatch]:
        """dealt(what of(texts) gives, for about `most` tokens)."""
        held, n = [], 0
        for b in batches:
            for _, texts in hashing.batches(b.column(0)):
                held.append(of(texts))
                n += len(held[-1][0])
                if n >= most:
                    yield dealt(held)
                    held, n = [], 0
        if n:
            yield dealt(held)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = spread(1 << 64, ranges)
        return counted(batches, tokens, lambda held: dealt_rows(*np.unique(np.concatenate([h for h, _ in held]), return_counts=True), bounds), HELD_WORDS)

    def write_words(t: pa.Table) -> pa.Table:
        s, k, c = merged(t)
        saved(folder, f"counts-{s}", c.astype(np.uint32) if c.max(initial=0) < 1 << 32 else c)
        rank = np.empty(len(k), np.uint32 if len(k) < 1 << 32 else np.uint64)
        rank[np.argsort(-c, kind="stable")] = np.arange(len(k))
        saved(folder, f"ranks-{s}", rank)
        saved(folder, f"words-{s}", k)
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(k)], pa.int64()), "total": pa.array([int(c.sum())], pa.int64())})

    got = text.mapInArrow(words, ROW).groupBy("shard").applyInArrow(write_words, "shard int, n bigint, total bigint").collect()  # a row a range
    sizes = [0] * ranges
    for r in got:
        sizes[r["shard"]] = r["n"]
    top = top_number(sizes)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(folder, sizes)

        def dealt(held: list[list[np.ndarray]]) -> pa.RecordBatch:
            joined = [np.concatenate(w) for w in zip(*held, strict=True)]
            return dealt_grams(*distinct(joined, np.ones(len(joined[0]))), ranges)

        return counted(batches, lambda texts: numbered(own, texts, order)[0], dealt, HELD)

    def write_follows(t: pa.Table) -> pa.Table:
        if t["shard"][0].as_py() < 0:
            return t
        s, k, c = merged(t)
        edges = [0, *word_bounds(top, ranges).tolist(), top]
        out = np.zeros(edges[s + 1] - edges[s], np.uint32 if c.max(initial=0) < 1 << 32 else np.uint64)
        out[(k - U(edges[s])).astype(np.int64)] = c
        saved(folder, f"follow-{s}", out)
        return pa.Table.from_batches([told(1, *of_counts(c), int(c.sum()), int((c >= 3).sum()))])

    def writer(m: int):
        return lambda t: write_grams(t, m, folder, ranges, top)

    dealt = text.mapInArrow(grams, ROW)
    for m in range(order, 1, -1):
        dealt = dealt.groupBy("shard").applyInArrow(writer(m), ROW)
    counts = {m: np.zeros(6, np.int64) for m in range(1, order + 1)}
    for r in dealt.groupBy("shard").applyInArrow(write_follows, ROW).select("c").collect():  # a row a range and order
        m, *n = np.frombuffer(r["c"], "<i8").tolist()
        counts[m][: len(n)] += n
    return Model(folder, sizes, int(sum(r["total"] for r in got)), ranges, order, counts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs(doc_id, text).

    A null or empty text is the end token alone; with no training words, every word has the probability of the one unknown word;
    null ids and repeated rows are kept; other columns are dropped. perplexity = 10 ** (-score / n_tokens).
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.open()
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for _, texts in hashing.batches(b.column(1)):
                grams, count, starts = numbered(m.words, texts, m.order)
                at = starts[:-1]
                base = np.log10((count + 0.1) / (m.total + 0.1 * (m.v + 1)))
                p = np.log10(np.maximum(m.probabilities(grams), 1e-300))
                for col, x in zip(cols, (np.diff(starts), np.add.reduceat((count > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(p, at)), strict=True):
                    col += x.tolist()
            n = len(cols[0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([m.total] * n, pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(scored, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out(doc_id) -> F.Column:
    return F.coalesce(remainder_of_id(doc_id, 10) == 0, F.lit(False))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
