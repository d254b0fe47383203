"""Set-similarity join of documents' word n-grams at a Jaccard threshold, with set-relation skipping.

Sets are ordered by (is it frequent, hash); two sets over the threshold share a token among their
first few (prefix filter). The tokens' lists are the index. Two relations between sets save work:

* index level: a list is cut into blocks by place and size; what a block's smallest place and its
  sizes leave too little to share with is skipped as a block;
* answer level: equal sets are one set with one answer, and in a long list the sets are compared with
  the one of most frequent tokens (the centre of a group of near copies) first. What links to the centre
  takes over the centre's answer, its component. Only pairs whose components still differ are compared
  after, and of these only such as the answers of one set, its distances to all, don't rule out.

So a group of m near copies costs about m comparisons, and no link between components is lost.
Lists of frequent tokens are dealt out in parts, and pairs of parts are groups of their own, so no list
is one task. Hashes have 64 bits; a found pair is decided on the two texts' own sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import checkpointed, small_batches, table
from .components import components

U = np.uint64
#: Tokens are counted for frequency if their hash is in the lowest quarter: prefixes lie there.
ZONE = U(1 << 62)
#: A list of up to so many sets is compared in full at once; a longer one goes by its centre first.
FULL_LIST = 8
#: The broadcast array of frequent tokens has this many at most: the limit of frequency rises with the corpus.
MOST_FREQUENT = 1 << 20
#: Least bits of a set's sketch; a set of more tokens has the next power of two. A bit is the parity of the set's tokens
#: that fall on it, so that two sketches differ in no more bits than the sets differ in tokens: pairs that differ in
#: more than the threshold allows go unread. A sketch folds to half its bits, as sets in a pair may lie on either side of a power.
SKETCH = 1024
#: Texts of this many partners, or of so many bytes, are compared with a set in one task.
PARTNERS, PARTNER_BYTES = 256, 1 << 23
#: A frequent token's list is dealt out in so many parts; of a list with several components, so many entries make a part.
PARTS, ENTRIES = 16, 2048
#: From so many documents on a token is frequent enough for that.
SPLIT = 1024
#: Entries of a list that are skipped together.
BLOCK = 64
#: Bytes of text, n-grams and rows of sets that a task works on at once: they bound what its Python process holds and keeps.
TEXT_BYTES, GRAMS, ROWS = 1 << 19, 1 << 19, 1 << 10
#: So many ids (8 bytes each) may be broadcast to pick the texts that are compared; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the n-grams of a text's word hashes, sorted; with fewer words, of the whole sequence."""
    if not len(h):
        return h
    if len(h) < n:
        n = len(h)
    m = len(h) - n + 1
    x = np.full(m, n, np.uint64)
    for k in range(n):
        x = hashing.mix(x * U(0x9E3779B97F4A7C15) + h[k : k + m])
    return np.unique(x)


def sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    for _, texts in hashing.batches(column, TEXT_BYTES):
        h, at = hashing.documents(texts)
        for i in range(len(texts)):
            yield shingles(h[at[i] : at[i + 1]], n)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def packed(parts: list[np.ndarray], shard: np.ndarray, k: int) -> Iterator[tuple]:
    """Rows (shard, bytes of each array) of arrays dealt by shard."""
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(k + 1))
    parts = [p[order] for p in parts]
    for s in range(k):
        if edges[s] < edges[s + 1]:
            yield (s, *(p[edges[s] : edges[s + 1]].tobytes() for p in parts))


def sketch(s: np.ndarray) -> list[int]:
    bits = max(SKETCH, 1 << max(0, len(s) - 1).bit_length())
    odd = np.bincount((s >> U(11)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


class Sketches:
    """Sketches of different widths, rows side by side."""

    def __init__(self, column: pa.ListArray, order: np.ndarray) -> None:
        self.values, starts = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        self.starts, self.width = starts[:-1][order], np.diff(starts)[order]
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def level(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """At w words: the sketches of width w and, folded, of 2w; which row of them each set has."""
        if w not in self.levels:
            at, parts, n = np.full(len(self.width), -1), [], 0
            for own in (w, 2 * w):
                rows = np.flatnonzero(self.width == own)
                x = self.values[self.starts[rows][:, None] + np.arange(own)]
                parts.append(x if own == w else x[:, :w] ^ x[:, w:])
                at[rows] = n + np.arange(len(rows))
                n += len(rows)
            self.levels[w] = np.concatenate(parts), at
        return self.levels[w]

    def from_one(self, p: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits in which rows differ from row p at its width, and of which rows that is known; at one width these are distances."""
        m, at = self.level(int(self.width[p]))
        known = at[rows] >= 0
        return np.where(known, np.bitwise_count(m[at[rows]] ^ m[at[p]]).sum(1, dtype=np.int64), 0), known

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which pairs differ; widths of a pair are equal or one twice the other."""
        out, least = np.zeros(len(a), np.int64), np.minimum(self.width[a], self.width[b])
        for w in np.unique(least):
            m, at = self.level(int(w))
            k = np.flatnonzero(least == w)
            out[k] = np.bitwise_count(m[at[a[k]]] ^ m[at[b[k]]]).sum(1, dtype=np.int64)
        return out


def unpacked(t: pa.Table, **kinds: str) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in kinds.items()]


def frequent(docs: DataFrame, n: int, shards: int, most: int = MOST_FREQUENT, split: int = SPLIT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes (below ZONE) of n-grams that stand in many documents, `most` of them or fewer, and of those that stand in `split` or more."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            rows = list(packed([h, c.astype("<u4")], (h >> U(30)) % U(shards), shards))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "h", "c"])

        held, size = [], 0
        for b in batches:
            for s in sets(b.column(0), n):
                held.append(s[: np.searchsorted(s, ZONE)])
                size += len(held[-1])
                if size > GRAMS:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    def merged(t: pa.Table) -> pa.Table:
        h, c = unpacked(t, h="<u8", c="<u4")
        h, at = np.unique(h, return_inverse=True)
        c = np.bincount(at, c).astype(np.int64)
        many = c >= 32
        return pa.table({"h": pa.array(h[many].view(np.int64), pa.int64()), "c": pa.array(c[many], pa.int64())})

    got = checkpointed(docs.select(F.col("text").cast("string")).mapInArrow(counted, "shard int, h binary, c binary").groupBy("shard").applyInArrow(merged, "h bigint, c bigint"))
    least = 32
    while got.where(F.col("c") >= least).count() > most:
        least *= 2
    got = got.where(F.col("c") >= least).toArrow()
    h, c = got["h"].to_numpy().view(np.uint64), got["c"].to_numpy()
    return np.sort(h), np.sort(h[c >= split])


def described(docs: DataFrame, n: int, percent: int, hot) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (of the whole set), share of frequent tokens, sketch, prefix (tokens by the order), row by row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = hot.value
        for b in sliced(batches):
            size, f1, f2, share, bits, prefix = [], [], [], [], [], []
            n_bytes = pc.coalesce(pc.binary_length(b.column(1)), pa.scalar(0, pa.int32())).cast(pa.int64())
            for s in sets(b.column(1), n):
                size.append(len(s))
                f1.append(int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0)
                f2.append(int(hashing.mix(s + U(1)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                low = s[: np.searchsorted(s, ZONE)]
                at = np.searchsorted(freq, low)
                often = np.zeros(len(s), bool)
                if len(freq):
                    often[: len(low)] = freq[np.minimum(at, len(freq) - 1)] == low
                share.append(float(often.sum() / max(1, len(low))))
                bits.append(sketch(s))
                keep = len(s) - -(-percent * len(s) // 100) + 1
                prefix.append(np.concatenate([s[~often][:keep], s[often][:keep]])[:keep].tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(share, pa.float32()), pa.array(bits, pa.list_(pa.int64())), pa.array(prefix, pa.binary()), n_bytes],
                names=["doc_id", "n_shingles", "f1", "f2", "share", "sketch", "prefix", "bytes"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(rows, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, share float, sketch array<bigint>, prefix binary, bytes bigint")


def postings(nodes: DataFrame, shards: int, hot) -> DataFrame:
    """The index: lists' entries dealt by token into `shards` groups, those of the tokens in hot also by set. nodes: id, n_shingles, share, prefix."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = hot.value
        for b in sliced(batches):
            tokens = [np.frombuffer(x.as_py(), "<u8") for x in b.column(3)]
            if not (total := sum(map(len, tokens))):
                continue
            reps = np.asarray([len(t) for t in tokens])
            tok = np.concatenate(tokens)
            place = np.arange(total) - np.repeat(np.cumsum(reps) - reps, reps)
            one = lambda k, kind: np.repeat(b.column(k).to_numpy(zero_copy_only=False).astype(kind), reps)
            ids = one(0, "<i8")
            often = freq[np.minimum(np.searchsorted(freq, tok), len(freq) - 1)] == tok if len(freq) else np.zeros(total, bool)
            part = np.where(often, hashing.mix(ids.view(np.uint64)) % U(PARTS), U(0))
            shard = ((tok >> U(20)) + part * U(0x9E3779B1)) % U(shards)
            rows = list(packed([tok, ids, one(1, "<i4"), one(2, "<f4"), place.astype("<i4"), often.astype("<i1")], shard, shards))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 6], strict=True)], names=["shard", "tok", "id", "size", "share", "place", "often"])

    return nodes.select("id", "n_shingles", "share", "prefix").mapInArrow(dealt, "shard int, tok binary, id binary, size binary, share binary, place binary, often binary")


def fits(percent: int, size_i, size_j, place_i, place_j) -> np.ndarray:
    """Whether sets of these sizes (size_i <= size_j) with a common token at these places may reach the threshold."""
    need = -(-percent * (size_i.astype(np.int64) + size_j) // (100 + percent))
    return (size_i * 100 >= percent * size_j.astype(np.int64)) & (np.minimum(place_i, place_j) + np.minimum(size_i - place_i, size_j - place_j) >= need)


MET = "a bigint, b bigint, tok bigint, size int, place int, share float"


def partners(t: pa.Table, percent: int, full_list: int) -> pa.Table:
    """Of one group of lists: pairs a, b to compare (tok null), of long lists those with the centre; the long lists' entries (b null); and
    the centres of frequent tokens' parts (share not null)."""
    tok, ids, size, share, place, often = unpacked(t, tok="<u8", id="<i8", size="<i4", share="<f4", place="<i4", often="<i1")
    order = np.lexsort((ids, size, tok))
    tok, ids, size, share, place, often = (x[order] for x in (tok, ids, size, share, place, often))
    edges = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1], [True]])) if len(tok) else np.zeros(1, np.int64)
    runs = np.diff(edges)
    frequent = often[edges[:-1]] > 0
    pairs = [np.zeros((0, 2), np.int64)]

    def take(i: np.ndarray, j: np.ndarray) -> None:
        ok = fits(percent, size[i], size[j], place[i], place[j])
        pairs.append(np.sort(np.stack([ids[i[ok]], ids[j[ok]]], 1), axis=1))

    for length in np.unique(runs[(runs > 1) & (runs <= full_list) & ~frequent]):  # all short lists of one length at once
        i, j = np.triu_indices(length, 1)
        at = edges[:-1][(runs == length) & ~frequent]
        for part in np.array_split(at, max(1, len(at) * len(i) // 2_000_000)):
            take((part[:, None] + i).ravel(), (part[:, None] + j).ravel())
    long, centres = np.zeros(len(tok), bool), []
    for k in np.flatnonzero((runs > full_list) | frequent):
        lo, hi = edges[k], edges[k + 1]
        long[lo:hi] = True
        c = lo + int(np.lexsort((ids[lo:hi], -share[lo:hi]))[0])  # the fullest of frequent tokens
        rest = np.delete(np.arange(lo, hi), c - lo)
        take(np.minimum(rest, c), np.maximum(rest, c))
        if frequent[k]:
            centres.append(c)
    c = np.asarray(centres, np.int64)
    found = np.unique(np.concatenate(pairs), axis=0)
    column = lambda *parts, kind: pa.concat_arrays([pa.array([None] * p if isinstance(p, int) else p, kind) for p in parts])
    n, m = len(found), int(long.sum())
    return pa.table({
        "a": column(found[:, 0], ids[long], ids[c], kind=pa.int64()), "b": column(found[:, 1], m, len(c), kind=pa.int64()), "tok": column(n, tok[long].view(np.int64), tok[c].view(np.int64), kind=pa.int64()),
        "size": column(n, size[long], size[c], kind=pa.int32()), "place": column(n, place[long], place[c], kind=pa.int32()), "share": column(n, m, share[c], kind=pa.float32()),
    })


def between_centres(met: DataFrame) -> DataFrame:
    """Pairs a, b of the fullest centre of a frequent token with those of the other parts; a token has PARTS centres at most."""
    one = met.where("share is not null").groupBy("tok").agg(F.sort_array(F.collect_list(F.struct("share", (-F.col("a")).alias("id"))), asc=False).alias("x")).where("size(x) > 1")
    both = one.select((-F.get("x", F.lit(0))["id"]).alias("c"), F.explode(F.slice("x", 2, PARTS)).alias("o"))
    return both.select(F.least("c", -F.col("o.id")).alias("a"), F.greatest("c", -F.col("o.id")).alias("b"))


def in_parts(long: DataFrame) -> DataFrame:
    """Of long lists (tok, id, size, place, label) with several labels: the entries, once for each pair of parts (i, j) to be compared.

    i from 0 on: part i of the list's largest component against part j of the rest; i below 0: parts -1 - i and j of the rest."""
    by = long.groupBy("tok", "label").agg(F.count("*").alias("n"))
    of = by.groupBy("tok").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    parts = lambda n: F.ceil(n / ENTRIES).cast("int")
    of = of.select("tok", F.col("top.label").alias("most"), parts(F.col("top.n")).alias("k"), parts(F.col("n") - F.col("top.n")).alias("m"))
    # a frequent token's entries are spread over PARTS keys
    of = of.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    long = long.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).join(of, ["tok", "part"])
    major = F.col("label") == F.col("most")
    own = F.pmod(F.hash("id"), F.when(major, F.col("k")).otherwise(F.col("m")))
    all_of = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda i, j, first: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(first).alias("first"))
    long = long.withColumn("own", own)
    with_major = F.transform(all_of(F.col("k")), lambda i: pair(i, F.col("own"), False))
    lower, upper = F.transform(F.sequence(F.lit(0), F.col("own")), lambda i: pair(-1 - i, F.col("own"), False)), F.transform(F.sequence(F.col("own"), F.col("m") - 1), lambda j: pair(-1 - F.col("own"), j, True))
    where = F.when(major, F.transform(all_of(F.col("m")), lambda j: pair(F.col("own"), j, True))).otherwise(F.concat(with_major, lower, F.filter(upper, lambda x: x["j"] > F.col("own"))))
    return long.select("tok", "id", "size", "place", "label", F.explode(where).alias("x")).select("tok", "id", "size", "place", "label", "x.*")


def crossing(t: pa.Table, percent: int) -> pa.Table:
    """Of pairs of parts of long lists: pairs with different labels that may reach the threshold, by place, size and sketch."""
    tok, ids, size, place, label, i_part, j_part, first = (t[c].to_numpy(zero_copy_only=False) for c in ("tok", "id", "size", "place", "label", "i", "j", "first"))
    order = np.lexsort((ids, place, size, ~first, j_part, i_part, tok))
    bits = Sketches(t["sketch"].combine_chunks(), order)
    tok, ids, size, place, label, i_part, j_part, first = (x[order] for x in (tok, ids, size, place, label, i_part, j_part, first))
    new = (tok[1:] != tok[:-1]) | (i_part[1:] != i_part[:-1]) | (j_part[1:] != j_part[:-1])
    edges = np.flatnonzero(np.concatenate([[True], new, [True]]))
    pairs = [np.zeros((0, 2), np.int64)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        cut = lo + int(first[lo:hi].sum())  # the first part, then the second; a part with itself has no first
        alone = i_part[lo] < 0 and -1 - i_part[lo] == j_part[lo]
        if alone:
            cut = hi
        elif cut in (lo, hi):
            continue
        sizes = size[lo:cut]
        block = np.arange(lo, cut, BLOCK)
        least, places, rests = np.minimum.reduceat(size[lo:cut], block - lo), np.maximum.reduceat(place[lo:cut], block - lo), np.maximum.reduceat((size - place)[lo:cut], block - lo)
        far, known = bits.from_one(lo, np.arange(lo, hi))  # from one set to all, where sketches can be compared
        for i in range(lo if alone else cut, hi):
            # sizes rise: what is too large or too small for i is skipped, then blocks whose places and sizes leave too little
            begin = lo + np.searchsorted(sizes, -(-percent * int(size[i]) // 100))
            end = lo + np.searchsorted(sizes, int(size[i]) * 100 // percent, side="right")
            most = np.minimum(place[i], places) + np.minimum(size[i] - place[i], rests)
            may = most >= -(-percent * (int(size[i]) + least.astype(np.int64)) // (100 + percent))
            j = np.flatnonzero(np.repeat(may, BLOCK)[: cut - lo]) + lo
            j = j[np.searchsorted(j, max(begin, i + 1) if alone else begin) : np.searchsorted(j, end)]
            j = j[label[j] != label[i]]
            small = j < i if alone else (size[j] < size[i])
            a, b = np.where(small, j, i), np.where(small, i, j)
            ok = fits(percent, size[a], size[b], place[a], place[b])
            j, a, b = j[ok], a[ok], b[ok]
            total = size[a].astype(np.int64) + size[b]
            limit = total - 2 * -(-percent * total // (100 + percent))
            # the first set's distances are answers for i too: what is much nearer to it or farther than i is out of i's reach
            ok = ~known[j - lo] | ~known[i - lo] | (np.abs(far[j - lo] - far[i - lo]) <= limit)
            a, b, limit = a[ok], b[ok], limit[ok]
            ok = bits.differ(a, b) <= limit
            pairs.append(np.sort(np.stack([ids[a[ok]], ids[b[ok]]], 1), axis=1))
    found = np.unique(np.concatenate(pairs), axis=0)
    return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches don't differ in more bits than sets over the threshold may differ in tokens."""
    one = nodes.select("id", "n_shingles", "sketch")
    both = pairs.join(one.toDF("a", "n_a", "s_a"), "a").join(one.toDF("b", "n_b", "s_b"), "b")

    def folded(s, other):
        half = F.size(other)
        return F.when(F.size(s) > half, F.zip_with(F.slice(s, 1, half), F.slice(s, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(s)

    bits = F.aggregate(F.zip_with(folded(F.col("s_a"), F.col("s_b")), folded(F.col("s_b"), F.col("s_a")), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    total = F.col("n_a") + F.col("n_b")
    return both.where(bits <= total - 2 * F.ceil(percent * total / (100 + percent) - 1e-9)).select("a", "b")


def decided(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int, most_broadcast: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets reach the threshold. A set's partners are dealt into chunks of about PARTNERS texts or PARTNER_BYTES."""
    sized = pairs.join(nodes.select(F.col("id").alias("b"), "bytes"), "b")
    chunks = sized.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / PARTNERS, F.sum("bytes") / PARTNER_BYTES)).cast("int").alias("k"))
    member = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("chunk"), F.col("b").alias("id"))
    own = chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("chunk"), F.col("a").alias("id"))
    wanted = checkpointed(member.unionByName(own))
    ids = wanted.select("id").distinct()
    if ids.count() <= most_broadcast:
        ids = F.broadcast(ids)
    rows = wanted.join(texts.join(ids, "id", "left_semi"), "id")

    def compared(t: pa.Table) -> pa.Table:
        ids, a, text = t["id"].to_pylist(), t["a"][0].as_py(), t["text"].combine_chunks()
        own, out = next(sets(text.slice(ids.index(a), 1), n)), []
        for b, s in zip(ids, sets(text, n), strict=True):  # one set at a time
            if b != a:
                at = np.searchsorted(own, s)
                both = int((own[np.minimum(at, len(own) - 1)] == s).sum())
                if 100 * both >= percent * (len(own) + len(s) - both):
                    out.append(b)
        return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return rows.groupBy("a", "chunk").applyInArrow(compared, "a bigint, b bigint")


def similar(docs: DataFrame, n: int = 3, percent: int = 90, full_list: int = FULL_LIST, most_frequent: int = MOST_FREQUENT, split: int = SPLIT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text): links are pairs with 100 * both >= percent * either.

    Null texts and those without words have an empty set, link with nothing and are their own component; equal texts link; a null
    doc_id has a null component; rows that repeat an id are one node with several sets; other columns are dropped; an empty table gives
    no rows. The last four arguments choose between plans; the rows don't depend on them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    often, longest = map(spark.sparkContext.broadcast, frequent(docs, n, shards, most_frequent, split))
    rows = checkpointed(described(docs, n, percent, often))
    key = ["n_shingles", "f1", "f2"]
    some = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    equal = checkpointed(some.groupBy(*key).agg(F.min("doc_id").alias("id"), F.first("share").alias("share"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"), F.max("bytes").alias("bytes")))
    nodes = equal.select("id", "n_shingles", "share", "prefix")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    whole = rows.select("doc_id", *key)
    of = whole.where(F.col("n_shingles") > 0).join(equal.select(*key, "id"), key).select("doc_id", "id").distinct()
    twice = of.groupBy("doc_id").agg(F.count("*").alias("m"), F.min("id").alias("lo")).where("m > 1").select("doc_id", "lo")
    same = of.join(twice, "doc_id").select(F.col("lo").alias("a"), F.col("id").alias("b"))  # an id with several sets

    # of an id that repeats, the text of the set that the node stands for
    single = texts if not twice.head(1) else one_text(texts, equal, n)
    settled = lambda pairs: decided(pairs, equal, single, n, percent, most_broadcast)
    met = checkpointed(postings(nodes, shards, longest).groupBy("shard").applyInArrow(lambda t: partners(t, percent, full_list), MET))
    first = met.where("tok is null").select("a", "b").unionByName(between_centres(met)).distinct()
    label = checkpointed(components(settled(checkpointed(possible(first, equal, percent))).unionByName(same)))
    long = met.where("tok is not null and share is null").select(F.col("a").alias("id"), "tok", "size", "place").join(label, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    long = in_parts(long).join(equal.select("id", "sketch"), "id").withColumn("shard", F.pmod(F.xxhash64("tok", "i", "j"), F.lit(shards)))
    cross = long.groupBy("shard").applyInArrow(lambda t: crossing(t, percent), "a bigint, b bigint")
    more = checkpointed(settled(checkpointed(cross.distinct())))
    if more.head(1):
        label = components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    out = whole.join(equal.select(*key, "id"), key, "left").join(label, "id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id")).alias("component_id"))


def one_text(texts: DataFrame, equal: DataFrame, n: int) -> DataFrame:
    """id, text of each node where ids repeat with different texts: the text whose set is the node's."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(sets(b.column(1), n))
            f1 = [int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0 for s in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f1, pa.int64())], names=["id", "text", "f1"])

    rows = texts.mapInArrow(keyed, "id bigint, text string, f1 bigint").join(equal.select("id", "f1"), ["id", "f1"])
    return rows.groupBy("id").agg(F.first("text").alias("text"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (word 5-grams, Jaccard 0.8) one row stays, that with the smallest id.

    Rows without an id come after all ids; of rows that repeat id and text one stays, and texts that share an id are decided each for itself.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").head(1):
        return one_row_each(docs, 5, 80)
    found = similar(docs, n=5, percent=80)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def one_row_each(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """docs, one row of each group of near duplicates, where ids are null or repeat: the texts are compared by their hash instead."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("row_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))
    found = similar(rows.groupBy(F.col("row_hash").alias("doc_id")).agg(F.first("text").alias("text")), n, percent)
    found = found.where("n_shingles > 0").select(F.col("doc_id").alias("row_hash"), "component_id")
    of = rows.groupBy("row_id", "row_hash").agg(F.count("*").alias("n")).join(found, "row_hash")
    of = checkpointed(of.withColumn("rank", F.struct(F.col("row_id").isNull().alias("none"), "row_id", "row_hash")))
    least = of.groupBy("component_id").agg(F.min("rank").alias("least"))
    of = of.join(least, "component_id").withColumn("stays", F.col("rank").eqNullSafe(F.col("least")))
    gone, twice = of.where(~F.col("stays")), of.where(F.col("stays") & (F.col("n") > 1))
    met = lambda d, k: d["doc_id"].cast("bigint").eqNullSafe(k["row_id"]) & (F.xxhash64(d["text"].cast("string")) == k["row_hash"])
    left = docs.join(gone, met(docs, gone), "left_anti")
    return left.join(twice, met(left, twice), "left_anti").unionByName(left.join(twice, met(left, twice), "left_semi").dropDuplicates(["doc_id", "text"]))
