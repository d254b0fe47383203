"""Packing documents into fixed windows: an order-preserving dynamic programme over cut points.

Each input partition is a run of documents in the order in which they stand. Their ids form one
stream; the programme picks the windows' ends among document ends (free), sentence ends (cheap) and
a grid of points within long sentences (dear), so that padding plus cut penalties is least:

    cost[j] = penalty[j] + min(  min over i, p[j]-p[i] <= size, of cost[i] + size - (p[j]-p[i]),
                                 min over lengths 2^k < size   of cost[i at p[j]-2^k] + extra[k]  )

The first minimum slides over cost[i] + p[i] and is kept in a monotone queue; the second covers
windows that need no padding as their length is a power of two. No shuffle: a partition's last
window is all that splitting the input costs. Memory is bounded by `block` tokens and one document.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import small_batches, table

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded_length bigint"
)
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Frequent words whose ids are kept.
KNOWN_WORDS = 100_000
#: Long texts are encoded in slices of about so many characters, short ones in runs of RUN.
SLICE, RUN = 1 << 20, 1 << 19
LEADING_SPACE = r"^(?:$|[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])"


class Encoder:
    """Token ids, the same as the tokenizers library gives with add_special_tokens=False.

    A space before a visible character always starts a new pre-token, so each distinct word of many texts is encoded once and
    the texts are put together from them; frequent words are kept. Texts with other spacing are encoded as a whole."""

    def __init__(self, vocab: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocab}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        self.ends, self.spaced = (np.zeros(max(SPECIAL_ID, *ranks.values()) + 1, bool) for _ in range(2))
        for piece, i in ranks.items():
            self.ends[i] = piece.rstrip()[-1:] in (b".", b"!", b"?") or b"\n" in piece
            self.spaced[i] = piece[:1] == b" "
        self.known, self.known_ids = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.known_at = np.zeros(1, np.int64)  # where each kept word's ids begin, and their total

    def whole(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, allowed_special={SPECIAL}) if text else np.zeros(0, np.uint32)

    def slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > 2 * SLICE and (m := re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])").search(text, at + SLICE)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; texts of a few million characters together, or one long one, bound the memory."""
        if any(len(t) > 2 * SLICE for t in texts):
            return [np.concatenate([x for part in self.slices(t) for x in self.short([part])]) for t in texts]
        return self.short(texts)

    def short(self, texts: list[str]) -> list[np.ndarray]:
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = words.values.dictionary_encode()
        word, index, at = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(), words.offsets.to_numpy()
        mask = lambda x: x.to_numpy(zero_copy_only=False)
        special = mask(pc.match_substring(word, "<|"))
        odd = mask(pc.match_substring_regex(word, LEADING_SPACE))
        other = odd[index]
        other[at[:-1]] = False
        apart = ~np.logical_or.reduceat(other | special[index], at[:-1])
        begin, n, ids = self.of_words(word, ~odd & ~special, index)
        n = n[index]
        n[at[:-1]] = 0  # a text's first word has no space before it
        total = np.append(0, np.cumsum(n))
        ids = ids[np.arange(total[-1]) + np.repeat(begin[index] - total[:-1], n)]
        bounds = total[at].tolist()
        return [np.concatenate([self.whole(t.split(" ", 1)[0]), ids[bounds[i] : bounds[i + 1]]]) if apart[i] else self.whole(t) for i, t in enumerate(texts)]

    def of_words(self, word: pa.Array, plain: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct word with a space before it: where its ids begin and how many they are; and the ids. Words that aren't plain have none."""
        kept = pc.index_in(word, self.known).fill_null(-1).to_numpy()
        fresh = np.flatnonzero((kept < 0) & plain)
        begin, n = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        old = kept >= 0
        begin[old], n[old] = self.known_at[kept[old]], np.diff(self.known_at)[kept[old]]
        if not len(fresh):
            return begin, n, self.known_ids
        new = word.take(pa.array(fresh))
        # encoded as one text: only a word's first id begins with a space
        spaced = pc.binary_join_element_wise("", new, " ")
        _, offsets, data = spaced.buffers()
        ids = self.bpe.encode_to_numpy(data.to_pybytes()[: np.frombuffer(offsets, "<i4")[len(new)]].decode())
        at = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
        base = len(self.known_ids)
        begin[fresh], n[fresh] = base + at[:-1], np.diff(at)
        every = np.concatenate([self.known_ids, ids])
        often = np.flatnonzero(np.bincount(index, minlength=len(word))[fresh] > 1)[: max(0, KNOWN_WORDS - len(self.known))]
        if len(often):
            own = np.concatenate([ids[at[i] : at[i + 1]] for i in often.tolist()])
            self.known = pa.concat_arrays([self.known, new.take(pa.array(often))])
            self.known_at = np.append(self.known_at, base + np.cumsum(np.diff(at)[often]))
            self.known_ids = np.concatenate([self.known_ids, own])
        return begin, n, every


_encoders: dict[str, Encoder] = {}


def encoder(vocab: str) -> Encoder:
    if vocab not in _encoders:
        _encoders[vocab] = Encoder(vocab)
    return _encoders[vocab]


def cut_points(ids: np.ndarray, lengths: list[int], ends: np.ndarray, grid: int, sentence: float, inside: float) -> tuple[np.ndarray, np.ndarray]:
    """Where the documents of these lengths, one after the other, may be cut, their ends included, and what each cut costs."""
    last = np.cumsum(lengths)
    edge = np.append(False, ends[ids])  # at each place: does a sentence end before it
    edge[last] = True
    free = np.zeros(len(edge), bool)
    free[last] = True
    edges = np.flatnonzero(edge)
    gaps = np.diff(edges, prepend=0)
    extra = np.maximum(gaps - 1, 0) // grid
    total = int(extra.sum())
    step = np.arange(1, total + 1) - np.repeat(np.cumsum(extra) - extra, extra)
    points = np.concatenate([edges, np.repeat(edges - gaps, extra) + step * grid])
    cost = np.concatenate([np.where(free[edges], 0.0, sentence), np.full(total, inside)])
    order = np.argsort(points, kind="stable")
    return points[order], cost[order]


def best_cuts(points: np.ndarray, penalty: np.ndarray, size: int, short: float) -> list[int]:
    """Ends of the windows of least cost from 0 to points[-1]; neighbouring points lie at most size apart."""
    at = np.append(0, points)
    # by point, the points that lie a power of two below it; few have any
    below, of = [np.zeros((2, 0))], [np.zeros(0, np.int64)]
    for k in range(1, 6):
        if size >> k > 1 and size & (size - 1) == 0:
            i = np.minimum(np.searchsorted(at, at - (size >> k)), len(at) - 1)
            of.append(np.flatnonzero(at[i] == at - (size >> k)))
            below.append(np.stack([i[of[-1]], np.full(len(of[-1]), short * k)]))
    order = np.argsort(np.concatenate(of), kind="stable")
    until = np.searchsorted(np.concatenate(of)[order], np.arange(1, len(at)), side="right").tolist()
    source, extra = np.concatenate(below, axis=1)[:, order]
    source, extra = source.astype(int).tolist(), extra.tolist()
    p = at.tolist()
    cost, back = [0.0] * len(p), [0] * len(p)
    keys, which, head, q = [0.0], [0], 0, 0  # the queue: keys rise from its head on
    for j, (x, pen, end) in enumerate(zip(points.tolist(), penalty.tolist(), until, strict=True), 1):
        least = x - size
        while p[which[head]] < least:
            head += 1
        c, i = keys[head] - least, which[head]
        while q < end:
            if (other := cost[source[q]] + extra[q]) < c:
                c, i = other, source[q]
            q += 1
        c += pen
        cost[j], back[j] = c, i
        key = c + x
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            which.pop()
        keys.append(key)
        which.append(j)
    out, j = [], len(p) - 1
    while j:
        out.append(p[j])
        j = back[j]
    return out[::-1]


def powers(n: int) -> list[int]:
    """Powers of two, the largest first, that add up to n."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Packs a stream of documents; windows come out as rows, one for each piece."""

    def __init__(self, ends: np.ndarray, size: int, block: int, first_id: int, grid: int, sentence: float, inside: float, short: float) -> None:
        self.ends, self.size, self.block, self.next_id = ends, size, block, first_id
        self.grid, self.sentence, self.inside, self.short = grid, sentence, inside, short
        self.held: list[tuple[int | None, int, int, np.ndarray]] = []  # id, tokens of the document, start, ids
        self.n = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.held.append((doc_id, len(ids), 0, ids))
        self.n += len(ids)
        return self.flush(False) if self.n >= self.block else []

    def flush(self, last: bool) -> list[tuple]:
        if not self.n:
            return []
        ids, lengths = np.concatenate([h[3] for h in self.held]), [len(h[3]) for h in self.held]
        cuts = best_cuts(*cut_points(ids, lengths, self.ends, self.grid, self.sentence, self.inside), self.size, self.short)
        if last:
            start = cuts[-2] if len(cuts) > 1 else 0
            if (parts := powers(cuts[-1] - start)) and self.size - (cuts[-1] - start) > self.inside * len(parts):
                cuts = [*cuts[:-1], *(start + np.cumsum(parts)).tolist()]
        else:  # windows near the end would change with what follows
            cuts = [x for x in cuts if x <= self.n - 16 * self.size] or cuts[:1]
        return self.emit(cuts)

    def emit(self, cuts: list[int]) -> list[tuple]:
        rows, held = [], deque(self.held)
        at = 0
        for end in cuts:
            offset, length = 0, end - at
            padded = length if length & (length - 1) == 0 else self.size
            while at < end:
                doc_id, total, start, ids = held.popleft()
                n = min(len(ids), end - at)
                rows.append((doc_id, start, n, zlib.crc32(ids[:n].astype("<u4")), total, self.next_id, offset, padded))
                if n < len(ids):
                    held.appendleft((doc_id, total, start + n, ids[n:]))
                at, offset = at + n, offset + n
            self.next_id += 1
        self.held, self.n = list(held), self.n - at
        return rows


def pack(
    docs: DataFrame, vocab: str = "byte_bpe_50k", size: int = 2048, end_id: int = 1, block: int = 1 << 20,
    grid: int = 32, sentence: float = 1.0, inside: float = 24.0, short: float = 4.0,
) -> DataFrame:
    """One row per piece of docs(doc_id, text): its document, place in the document, crc32 of its ids, sequence and place there.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed as often as they stand;
    an empty table gives no rows; other columns are ignored. `padded_length` is the length of the piece's sequence with padding.
    Penalties are in tokens of padding: `sentence` for a cut at a sentence's end, `inside` for one within a sentence,
    `short` for each halving of a window below `size`.
    """
    columns = [x.split()[0] for x in SCHEMA.split(", ")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab)
        packer = Packer(encode.ends, size, block, TaskContext.get().partitionId() << 40, grid, sentence, inside, short)
        tail = np.asarray([end_id], np.uint32)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=columns)

        for b in batches:
            for first, texts in hashing.batches(b.column(1), RUN):
                rows = []
                for doc_id, ids in zip(b.column(0).slice(first, len(texts)).to_pylist(), encode(texts), strict=True):
                    rows += packer.add(doc_id, np.concatenate([ids, tail]))
                if rows:
                    yield batch(rows)
        if rows := packer.flush(True):
            yield batch(rows)
        pa.default_memory_pool().release_unused()  # workers go on to other stages

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(packed, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
