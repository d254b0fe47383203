"""Language identification as a mixture: EM over the words' character n-gram likelihoods.

Training counts, for each language, the hashed character trigrams of all training texts (Spark sums
them by language and bucket). A document is a mixture of languages; each word's likelihood under
each language is the product over its trigrams. EM estimates the proportions, once with all
languages and again for the 1, 2, ... up to all of them, most likely first, and the set with the best
penalised likelihood is kept. A text's fit is its likelihood per trigram against equally likely buckets.
The model has buckets x languages cells, at most CELLS: with more than 512 languages neighbouring buckets are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder_of_id, small_batches, table

BITS = 16
#: Most cells of the model, 128 MB: the bound of what the driver holds and sends to the workers.
CELLS = 1 << 25
#: Characters that are worked on at once, with up to eight languages; with more it is less.
CHARS = 1 << 20

_folded: list[np.ndarray] = []


def folding() -> np.ndarray:
    """Of each code point: its lower-case letter, or a space if it isn't a letter."""
    if not _folded:
        t = np.full(0x110000, 32, np.uint32)
        for i in range(len(t)):
            if (c := chr(i)).isalpha():
                t[i] = ord(low) if len(low := c.lower()) == 1 else i
        _folded.append(t)
    return _folded[0]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of the texts, spaces around each; where each text begins."""
    code = folding()[np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), "<u4")]
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return code, starts


def trigrams(code: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places of letters and the bucket, of 2^bits, of the trigram around each."""
    at = np.flatnonzero(code != 32)
    at = at[(at > 0) & (at < len(code) - 1)]
    h = code[at - 1] * np.uint32(0x9E3779B1) + code[at] * np.uint32(0x85EBCA77) + code[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return at, (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits)


def chunks(batch: pa.RecordBatch, text: int, size: int = CHARS) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of runs of rows of about `size` characters."""
    first, run, n = 0, [], 0
    for i, t in enumerate(batch.column(text)):
        run.append(t.as_py() or "")
        n += len(run[-1])
        if n >= size:
            yield first, run
            first, run, n = i + 1, [], 0
    if run:
        yield first, run


def counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows of docs(lang, text) with a language."""

    def rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], names=["lang", "bucket", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for first, texts in chunks(b, 1):
                by: dict[str, list[str]] = {}
                for lang, t in zip(langs[first : first + len(texts)], texts, strict=True):
                    by.setdefault(lang, []).append(t)
                for lang, own in by.items():
                    got = np.bincount(trigrams(letters(own)[0])[1], minlength=1 << BITS)
                    sums[lang] = sums[lang] + got if lang in sums else got
                    if len(sums) > 256:
                        yield from rows(sums)
                        sums = {}
        yield from rows(sums)

    kept = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return kept.mapInArrow(counted, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, alpha: float = 0.5, cells: int = CELLS) -> tuple[list[str], np.ndarray]:
    """The languages of docs(lang, text), sorted, and log probabilities by bucket and language.

    More languages make fewer buckets, so that the model stays within `cells`. More than cells / 2 languages are an error.
    """
    summed = counts(docs).persist()
    try:
        langs = sorted(r[0] for r in summed.select("lang").distinct().limit(cells // 2 + 1).collect())
        bits = min(BITS, (cells // max(1, len(langs))).bit_length() - 1)
        if bits < 1:
            raise ValueError(f"more than {cells // 2} languages")
        less = summed.groupBy("lang", F.shiftright("bucket", BITS - bits).alias("bucket")).agg(F.sum("n").alias("n")) if bits < BITS else summed
        got = less.toArrow()
    finally:
        summed.unpersist()
    n = np.full((1 << bits, len(langs)), alpha)
    where = {x: i for i, x in enumerate(langs)}
    if got.num_rows:
        column = np.asarray([where[x] for x in got["lang"].to_pylist()])
        n[got["bucket"].to_numpy(), column] += got["n"].to_numpy()
    return langs, np.log(n / n.sum(0)).astype(np.float32)


def chars(model: np.ndarray) -> int:
    """How many characters are worked on at once: tables of words x languages bound the memory."""
    return CHARS * 8 // max(8, model.shape[1])


def mixture(like: np.ndarray, doc: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM: proportions by document, and the documents' log likelihoods. like: words x languages; share: documents x languages, 0 where left out."""
    n = np.diff(np.append(starts, len(like)))[:, None]
    for _ in range(rounds):
        r = share[doc] * like
        r /= r.sum(1, keepdims=True) + 1e-30
        share = np.add.reduceat(r, starts, axis=0) / n
    total = np.log((share[doc] * like).sum(1) + 1e-30)
    return share, np.add.reduceat(total, starts)


def identify(texts: list[str], model: np.ndarray, most: int | None, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: whether it has a letter, proportions by language, the size of the chosen set, and its fit.

    most: the largest set, all languages if None. fit: what the chosen mixture's log likelihood per trigram is above that
    of equally likely buckets; 0 or less where the learned languages tell nothing about the text.
    """
    code, begins = letters(texts)
    bits = max(1, len(model).bit_length() - 1)
    at, bucket = trigrams(code, bits)
    has = np.zeros(len(texts), bool)
    out, sizes, fits = np.zeros((len(texts), model.shape[1]), np.float32), np.zeros(len(texts), np.int32), np.zeros(len(texts))
    if not len(at) or not model.shape[1]:
        has[:] = np.diff(np.searchsorted(at, begins)) > 0
        return has, out, sizes, fits
    first = np.flatnonzero(np.diff(at, prepend=-5) > 1)  # of each word
    ll = np.add.reduceat(model[bucket], first, axis=0)
    top = ll.max(1, keepdims=True)
    like = np.maximum(np.exp(ll - top), np.float32(1e-12))
    doc = np.searchsorted(begins, at[first], side="right") - 1
    docs, starts = np.unique(doc, return_index=True)
    has[docs] = True
    n = np.diff(np.append(starts, len(doc)))
    d = np.repeat(np.arange(len(docs)), n)
    langs = model.shape[1]
    full, likely = mixture(like, d, starts, np.full((len(docs), langs), 1 / langs, np.float32), 8)
    # no mixture of any languages is likelier than this: the likelihood is concave in the proportions
    gain = np.add.reduceat(like / ((full[d] * like).sum(1, keepdims=True) + 1e-30), starts, axis=0).max(1) / n
    bound = likely + n * np.log(np.maximum(gain, 1)) + 1e-3 * (1 + np.abs(likely))
    order = np.argsort(-full, axis=1, kind="stable")
    best, kept, size, fitted = np.full(len(docs), -np.inf), np.zeros_like(full), np.zeros(len(docs), np.int32), np.zeros(len(docs))
    cost = penalty * np.log(n + 1)
    for k in range(1, min(most or langs, langs) + 1):
        left = np.flatnonzero(bound - k * cost > best)  # the others can't gain by k languages or more
        if not len(left):
            break
        of = slice(None) if len(left) == len(docs) else (bound - k * cost > best)[d]
        m, rows = n[left], np.arange(len(left))[:, None]
        begin, member = np.cumsum(m) - m, np.repeat(np.arange(len(left)), m)
        share = np.zeros((len(left), langs), np.float32)
        share[rows, order[left, :k]] = full[left[:, None], order[left, :k]] + 1e-6
        share /= share.sum(1, keepdims=True)
        share, got = mixture(like[of], member, begin, share, 0 if k == 1 else 6)
        value = got - k * cost[left]
        better = value > best[left]
        won = left[better]
        best[won], kept[won], size[won], fitted[won] = value[better], share[better], k, got[better]
    grams = np.add.reduceat(np.diff(np.append(first, len(at))), starts)
    out[docs], sizes[docs] = kept, size
    fits[docs] = (fitted + np.add.reduceat(top[:, 0].astype(float), starts)) / grams + bits * np.log(2)
    return has, out, sizes, fits


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, most: int | None = None, penalty: float = 1.0) -> DataFrame:
    """Adds to docs(doc_id, text, ...) its lang_pred, score (the share of that language), languages (the chosen set, largest first) and fit.

    The set may hold all learned languages, or `most`. fit: nats per trigram by which the chosen mixture explains the text better than
    equally likely trigrams do; letters of no learned language have 0 or less. A null text or one without a letter is `und` with score 0,
    fit 0 and no languages, as is every text where nothing was learned. Only doc_id and text are read; repeated rows are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            pred, score, sets, fits = [], [], [], []
            for _, texts in chunks(b, 1, chars(m)):
                has, share, size, fit = identify(texts, m, most, penalty)
                order = np.argsort(-share, axis=1, kind="stable")
                for i, known in enumerate(has):
                    known = known and bool(langs)
                    pred.append(langs[order[i, 0]] if known else "und")
                    score.append(min(1.0, float(share[i, order[i, 0]])) if known else 0.0)
                    sets.append([langs[x] for x in order[i, : size[i]]] if known else [])
                    fits.append(float(fit[i]))
            columns = [b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(fits, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "languages", "fit"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(predicted, "doc_id bigint, lang_pred string, score double, languages array<string>, fit double")


def held_out(doc_id) -> F.Column:
    return F.coalesce(remainder_of_id(doc_id, 4) == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, langs, model).withColumn("held_out", held_out(F.col("doc_id")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a letter go, those of which no language makes up `0.3` of the words, and those that fit no learned language.

    Each row is decided by its own text, whatever its doc_id: repeated rows share their fate, null ids are kept or go like others; null
    and empty texts go. Where no row has a language nothing is learned, and all rows go. All columns pass through, whatever their names;
    an empty table gives no rows.
    """
    small_batches(spark)
    _, model = fit(docs.where(~held_out(F.col("doc_id"))))
    shared = spark.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [np.zeros(0, bool)]
            for _, texts in chunks(b, at, chars(shared.value) // 4):  # other stages' processes need memory too
                has, share, _, fits = identify(texts, shared.value, None, 1.0)
                keep.append(has & (share.max(1, initial=0) >= 0.3) & (fits > 0))
            yield b.select(list(range(width))).filter(pa.array(np.concatenate(keep)))

    width = len(docs.columns)
    if ("text", "string") in docs.dtypes:  # sent as it is, once
        at = docs.columns.index("text")
        return docs.mapInArrow(kept, docs.schema)
    at, other = width, "t" * (1 + max(map(len, docs.columns)))  # a name that no column has
    return docs.select("*", F.col("text").cast("string").alias(other)).mapInArrow(kept, docs.schema)
