"""Phrase collocation mining by Rabin-Karp fingerprints.

Workers hash all words of a buffer at once and take prefix polynomials over them, so that the
fingerprint of each run of k words is one subtraction and one product. What is shuffled is a
fingerprint, its count, the sum of a second, independent check value of its occurrences, and a pointer
to a text in which it occurs; no text. Lengths are counted one after the other: a run of k words can
be frequent only if both of its runs of k - 1 words are, and a bitmap of those says so without a miss.
Texts that frequent fingerprints point to are read again to materialise the phrases and verify them: if
the sum of check values isn't count times the phrase's own, or the text holds two phrases of one
fingerprint, phrases have collided, and all phrases of that fingerprint are counted by their text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, small_batches, table
from .hashing import LETTER, U, mix, powers

BREAKS = re.compile(rb"[.,;:!?\x0A-\x0D]")
BREAK, EDGE = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
EDGE[[0x20, 0x09, *np.flatnonzero(BREAK)]] = True
#: Bytes that are hashed at once; a longer piece of a text makes a longer buffer.
BYTES = 1 << 19
#: Runs whose counts a task holds, over its buffers, until it sends them.
HELD = 1 << 18
#: Letters of the check values, independent of those of the fingerprints.
OTHER = np.random.default_rng(20250911).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
#: What tells runs of different lengths apart.
LENGTHS = np.random.default_rng(20250912).integers(1, 1 << 63, 64, dtype=np.uint64)
#: Bits of a check value: sums of 2^43 of them fit a long.
CHECK_BITS = 20
#: A bitmap has 16 bits for each member, but 2^29 (64 MB) at most; a full bitmap only prunes less.
MOST_BITS = 29
#: In whole numbers of up to 38 digits; counts have up to 17.
SCORE = "(cast(a as decimal(17,0)) * cast(n_all as decimal(17,0)) * 1000) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))"
COUNTED = "key bigint, n bigint, checks bigint, row bigint"
READ = "row bigint, key bigint, n bigint, own bigint, lang string, words int, phrase string"


@lru_cache(maxsize=4096)
def lang_value(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Buffer:
    """The words of some texts, each of a language, with the fingerprints of their runs; runs stay within pieces."""

    def __init__(self, texts: list[bytes], langs: list[str], bits: int = 64):
        self.data, self.langs, self.bits = b"\n".join(texts), langs, U(64 - bits)  # a line feed ends a piece
        b = np.frombuffer(self.data, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], EDGE[b], [True]]).view(np.int8)))
        self.first, self.last = edge[::2], edge[1::2]
        self.piece = np.cumsum(BREAK[b], dtype=np.int64)[self.first] if len(b) else np.zeros(0, np.int64)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.text = np.searchsorted(starts, self.first, side="right") - 1
        self.lang = np.asarray([lang_value(x) for x in langs], np.uint64)[self.text] if texts else np.zeros(0, np.uint64)
        self.prefixes = [self.polynomials(b, letters) for letters in (LETTER, OTHER)]

    def polynomials(self, b: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Prefix sums of word hashes times powers of P; a word's hash comes from prefix sums of its letters in the same way."""
        up, down = powers(len(b))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(letters[b] * up, out=total[1:])
        words = mix((total[self.last] - total[self.first]) * down[self.first] + (self.last - self.first).astype(np.uint64))
        out = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=out[1:])
        return out

    def places(self, k: int) -> np.ndarray:
        """First words of the runs of k words (of none: all words)."""
        n = len(self.first) - max(k, 1) + 1
        return np.flatnonzero(self.piece[:n] == self.piece[max(k, 1) - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def values(self, which: int, k: int, at: np.ndarray) -> np.ndarray:
        sums = self.prefixes[which]
        return mix((sums[at + k] - sums[at]) * powers(len(sums))[1][at] + self.lang[at] + LENGTHS[k])

    def keys(self, k: int, at: np.ndarray) -> np.ndarray:
        return self.values(0, k, at) >> self.bits << self.bits

    def checks(self, k: int, at: np.ndarray) -> np.ndarray:
        return (self.values(1, k, at) >> U(64 - CHECK_BITS)).astype(np.int64)

    def phrase(self, k: int, at: int) -> str:
        return b" ".join(self.data[self.first[at] : self.last[at + k - 1]].split()).decode("utf-8", "surrogatepass") if k else ""


class Bitmap:
    """A set of 64-bit values without misses: a bit for the first digits of each."""

    def __init__(self, digits: int, data: bytes):
        self.digits, self.data = digits, np.frombuffer(data, np.uint8)

    def __contains__(self, value: int) -> bool:
        return bool(self.has(np.asarray([value]).view(np.uint64))[0])

    def has(self, values: np.ndarray) -> np.ndarray:
        spot = values >> U(64 - self.digits)
        return (self.data[(spot >> U(3)).astype(np.int64)] >> (spot & U(7)).astype(np.uint8)) & 1 == 1


def bitmap(values: DataFrame) -> Bitmap:
    """The bitmap of the one column of values, put together by Spark in chunks of 4 KB; the driver gets 64 MB at most, whatever the number of values."""
    (name,) = values.columns
    digits = min(MOST_BITS, max(16, math.ceil(math.log2(16 * values.count() + 1))))
    spot = F.shiftrightunsigned(F.col(name), 64 - digits)
    chunks = values.groupBy(F.shiftright(spot, 15).alias("chunk")).agg(F.bitmap_construct_agg(spot % 32768).alias("bits"))
    out = bytearray(1 << (digits - 3))
    for r in chunks.collect():
        out[r.chunk << 12 : (r.chunk + 1) << 12] = r.bits
    return Bitmap(digits, bytes(out))


def buffers(batches: Iterator[pa.RecordBatch], bits: int, only: Bitmap | None = None) -> Iterator[tuple[Buffer, np.ndarray]]:
    """Buffers of about BYTES with their texts' rows, from batches of row, lang, text. Long texts are cut where a piece ends.

    only: rows to take, those of equal texts once.
    """
    done: set[int] = set()
    for b in batches:
        texts, langs, rows, n = [], [], [], 0
        for row, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if only is not None:
                if row in done or row not in only:
                    continue
                done.add(row)
            data, at = text.as_buffer().to_pybytes().lower(), 0  # of bytes, lower() changes A-Z alone
            while at < len(data):
                end = len(data)
                if end - at > BYTES and (m := BREAKS.search(data, at + BYTES)):
                    end = m.end()
                texts.append(data[at:end])
                langs.append(lang)
                rows.append(row)
                n, at = n + end - at, end
                if n >= BYTES:
                    yield Buffer(texts, langs, bits), np.asarray(rows, np.int64)
                    texts, langs, rows, n = [], [], [], 0
        if texts:
            yield Buffer(texts, langs, bits), np.asarray(rows, np.int64)


def runs_of_equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys, where in it each distinct one begins, and how often it occurs."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return order, first, np.diff(np.append(first, len(own)))


def summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """keys, n, checks, row of the runs in all of held, each key once."""
    keys, n, checks, row = (np.concatenate(x) for x in zip(*held, strict=True))
    order, first, _ = runs_of_equal(keys)
    return keys[order[first]], np.add.reduceat(n[order], first), np.add.reduceat(checks[order], first), np.minimum.reduceat(row[order], first)


def run_counts(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], shorter: Bitmap | None, bits: int) -> Iterator[pa.RecordBatch]:
    """key, n, checks, row of the runs in batches of row, lang, text; a key comes again only after others have filled HELD."""

    def sent(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys, *others = summed(held)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.view(np.int64), *others)], names=["key", "n", "checks", "row"])

    held, size = [], 0
    for buffer, numbers in buffers(batches, bits):
        for k in lengths:
            at = buffer.places(k)
            if shorter is not None:
                at = at[shorter.has(buffer.keys(k - 1, at))]
                at = at[shorter.has(buffer.keys(k - 1, at + 1))]
            if len(at):
                keys = buffer.keys(k, at)
                order, first, n = runs_of_equal(keys)
                checks = np.add.reduceat(buffer.checks(k, at)[order], first)
                held.append((keys[order[first]], n, checks, np.minimum.reduceat(numbers[buffer.text[at[order]]], first)))
                size += len(first)
        if size > HELD:
            held = [summed(held)]
            size = len(held[0][0])
            if size > HELD // 2:
                yield sent(held)
                held, size = [], 0
    if held:
        yield sent(held)


def fingerprints(rows: DataFrame, lengths: tuple[int, ...], shorter: Bitmap | None, bits: int) -> DataFrame:
    """key, n, checks, row of the runs of these lengths in rows(row, lang, text): occurrences, sum of check values, and the smallest row with one.

    shorter: the frequent runs that are one word shorter; runs that don't begin and end with one are left out.
    """
    held = rows.sparkSession.sparkContext.broadcast(shorter)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run_counts(batches, lengths, held.value, bits)

    return rows.mapInArrow(counted, COUNTED).groupBy("key").agg(F.sum("n").alias("n"), F.sum("checks").alias("checks"), F.min("row").alias("row"))


def read_again(rows: DataFrame, longest: int, keys: Bitmap, only: Bitmap | None, bits: int) -> DataFrame:
    """row, key, n, own (the check value), lang, words, phrase of the runs in rows that `keys` may hold, a row for each buffer; only: rows to read."""
    sent = rows.sparkSession.sparkContext.broadcast((keys, only))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer, numbers in buffers(batches, bits, sent.value[1]):
            for k in range(longest + 1):
                at = buffer.places(k)
                at = at[sent.value[0].has(buffer.keys(k, at))]
                if not len(at):
                    continue
                # a row for each distinct run of each text: all 128 bits tell those of one key apart
                each = [buffer.text[at], buffer.values(0, k, at), buffer.values(1, k, at)]
                order = np.lexsort(each)
                first = np.flatnonzero(np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in each], axis=0)]))
                n, spots = np.diff(np.append(first, len(order))), at[order[first]]
                text = buffer.text[spots]
                columns = [
                    numbers[text], buffer.keys(k, spots).view(np.int64), n, buffer.checks(k, spots), pa.array([buffer.langs[i] for i in text.tolist()], pa.string()),
                    np.full(len(n), k, np.int32), pa.array([buffer.phrase(k, i) for i in spots.tolist()], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in READ.split(", ")])

    return rows.mapInArrow(texts, READ)


def stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def phrases(docs: DataFrame, longest: int = 5, least: int = 100, bits: int = 64) -> DataFrame:
    """lang, words, phrase, n: exact counts of all runs of up to `longest` words with at least `least` occurrences; of no words (''), n is that of all words.

    bits: width of the fingerprints; fewer make more of them collide, which changes nothing but the work.
    """
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.where(text.isNotNull()).select(F.xxhash64(lang, text).alias("row"), lang.alias("lang"), text.alias("text"))
    levels, shorter = [], None
    for lengths in [(0, 1), *((k,) for k in range(2, longest + 1))]:
        level = stored(fingerprints(rows, lengths, shorter, bits).where(F.col("n") >= least), f"fingerprints-{lengths[-1]}")
        levels.append(level)
        shorter = bitmap(level.select("key"))
    # with few bits, runs of different lengths may share a fingerprint: each has a row of its own
    frequent = levels[0]
    for level in levels[1:]:
        frequent = frequent.unionByName(level)
    pointed = read_again(rows, longest, bitmap(frequent.select("key")), bitmap(frequent.select("row")), bits)
    pointed = pointed.select("row", "key", "own", "lang", "words", "phrase").distinct()
    f = frequent.alias("f")
    met = f.join(pointed.alias("p"), (F.col("f.key") == F.col("p.key")) & (F.col("f.row") == F.col("p.row")), "left")
    one = F.struct("lang", "words", "phrase")
    met = met.groupBy("f.key").agg(F.min(one).alias("low"), F.max(one).alias("high"), F.bool_and(F.col("checks") == F.col("f.n") * F.col("own")).alias("agrees"), F.max("f.n").alias("n"))
    met = stored(met.withColumn("sure", (F.col("low") == F.col("high")) & F.col("agrees")), "phrases")
    sure = met.where("sure").select("low.*", "n")
    collided = met.where("sure is null or not sure").select("key")
    if not collided.head(1):
        return sure
    again = read_again(rows, longest, bitmap(collided), None, bits).join(collided, "key", "left_semi")
    return sure.unionByName(again.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, most: int = 2000, contained: int = 100, bits: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the `most` best phrases of each language of docs(text, lang).

    A phrase has 2 to `longest` words and at least `least` occurrences (a); n: words of its language; of its cuts the one with the lowest
    score counts, the first of equal ones, l and r being how often its parts occur. Phrases go whose words stand in a longer phrase that
    occurs at least `contained` per cent as often. Null and empty texts have no words; a null language is `und`; repeated rows count
    each; ties of score and occurrences go by the phrase; ids and further columns are ignored; an empty table gives no rows.
    """
    grams = stored(phrases(docs, longest, least, bits), "grams")
    total = grams.where("words = 0").select("lang", F.col("n").alias("n_all"))
    found = grams.where("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"))
    part = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    split = found.withColumn("w", F.split("phrase", " "))
    # contained in a longer one that is as frequent
    places = lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - F.lit(k) + 1), lambda i: part(i, F.lit(k)))
    inner = F.flatten(F.array(*(F.when(F.col("words") > k, places(k)).otherwise(F.array().cast("array<string>")) for k in range(2, longest))))
    longer = split.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = split.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(contained) * F.col("a")))
    cuts = alone.select("lang", "words", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("one"), part(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("two"))
    side = lambda c, n: grams.where("words > 0").select("lang", F.col("phrase").alias(c), F.col("n").alias(n))
    cuts = cuts.join(side("one", "l"), ["lang", "one"]).join(side("two", "r"), ["lang", "two"]).join(total, "lang")
    best = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", F.col("n_all").alias("n"))).alias("x"))
    best = best.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
