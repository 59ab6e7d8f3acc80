"""Toxicity by maximum-scoring segments: passages whose words are likelier in toxic documents than in clean ones.

A word's score is the log of the ratio of its probabilities in toxic and in clean training documents. Both are
posterior means under a Dirichlet prior whose weights follow the counts of all documents (`PRIOR` pseudo-words). What
counts is a word's distinct contexts (the word before, itself, the word after), so copied texts and repeated lines
count once, in training and again within a text that is scored. Words whose signed root of the likelihood-ratio statistic is under `Z_LEAST` share one class with one
score. So the scores are a log-likelihood ratio over a finite alphabet: the mean score of clean text is negative.

`passages` finds all maximal scoring segments of every text in linear time: running sums over the words, one stack of
open segments, visited at words of positive score only. Their scores follow an extreme-value law in clean text, the
chance of one above s in n words is 1 - exp(-K n exp(-lambda s)); lambda and K are fitted on the clean documents of the
calibration part. A passage with an expected count K n exp(-lambda s) of at most `E_MOST` is significant. A document's
evidence is the sum of -log of that count over its significant passages (of its best passage where none is), turned
into a score by a logistic curve that the calibration part fits.

Words: A-Z lower-cased, then runs of bytes other than \\x00-\\x2F, \\x3A-\\x60, \\x7B-\\x7F, known by 2^22 buckets of
their 64-bit hash: counts and weights have a bound however many words there are. Learned from at most `TRAIN_DOCS`
labelled rows, the ones with the smallest hashes of their id, each with its whole text; three quarters of them give
counts, one quarter calibrates. The counts of the prior come from all documents.

Labels, language, source and id are never inputs of a score. Cases: null and empty texts have no words and get the
score of no evidence; a text of any length is scored whole (the worker's memory follows the longest text); repeated
rows are scored each; null labels are ignored, of several labels of one document the least counts, of several texts
under one id each is learned from; with no labels, or of one kind only, every score is 0. A null doc_id is not held
out and not learned from. Tables may be empty. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import NOT_ALNUM, arrow_rows, discard, lower, mix, slices, stored, utf8, word_hash, words

TRAIN_DOCS = 20_000
BUCKETS = 1 << 22
PRIOR = 5_000.0
Z_LEAST = 4.0
E_MOST = 0.01
THRESHOLD = 0.5


@dataclass
class Model:
    """Scores of the buckets that have one of their own, the score of all others, and the calibration."""

    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rest: float = 0.0
    lam: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float] | None = None

    def table(self) -> np.ndarray:
        """The score of every bucket, 16 MB."""
        out = np.full(BUCKETS, self.rest, np.float32)
        out[self.buckets] = self.scores
        return out

    def evidence(self, score: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """-log of the expected count of passages with such scores in n words of clean text; none where that is over one or there is no passage."""
        return np.where(score > 0, np.maximum(self.lam * score - self.log_k - np.log(np.maximum(n_words, 1)), 0), 0)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * evidence, -500, 500)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _calibrates(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 4


@dataclass
class Words:
    """The words of a slice of texts: 64-bit hashes, hashes of their contexts, the bytes where each starts and ends (within all texts), each text's first word and first byte."""

    hashes: np.ndarray
    contexts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        data, offsets = utf8(column)
        data = lower(data)  # before words are cut: capitals aren't among their bytes
        starts, ends, first = words(data, offsets, NOT_ALNUM)
        h = word_hash(data, starts, ends)
        before, after = np.zeros_like(h), np.zeros_like(h)
        before[1:], after[:-1] = h[:-1], h[1:]
        some = first[:-1] < first[1:]
        before[first[:-1][some]], after[first[1:][some] - 1] = 0, 0
        context = mix(mix(before + np.uint64(1)) + mix(h) * np.uint64(3) + mix(after + np.uint64(2)) * np.uint64(5))
        return cls(h, context, starts, ends, first, offsets)

    @property
    def buckets(self) -> np.ndarray:
        return (self.hashes % np.uint64(BUCKETS)).astype(np.int64)

    def scored(self, table: np.ndarray, rest: float) -> np.ndarray:
        """Scores by word; where a text has a context of positive score again, the score of the rest."""
        score = table[self.buckets].astype(np.float64)
        plus = np.flatnonzero(score > 0)
        text = np.searchsorted(self.first, plus, side="right").astype(np.uint64)
        _, new = np.unique(mix(self.contexts[plus] + mix(text)), return_index=True)
        score[np.delete(plus, new)] = min(rest, 0.0)
        return score


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence as (start, end, score), in linear time; they don't overlap.

    Each open segment holds the running sum before it and after it. A word of positive score opens one; it is merged
    with the nearest open one whose sum before is less, if that one's sum after is less too, and so on."""
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    open_: list[list] = []  # [start, end, before, after, index of the nearest earlier one with a smaller sum before]
    for at in np.flatnonzero(scores > 0).tolist():
        start, end, before, after = at, at + 1, float(sums[at]), float(sums[at + 1])
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= before:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= after:
                open_.append([start, end, before, after, j])
                break
            start, before = open_[j][0], open_[j][2]
            del open_[j:]
    return [(s, e, b - a) for s, e, a, b, _ in open_]


def corpus_counts(docs: DataFrame, wanted: np.ndarray, text: str = "text") -> DataFrame:
    """(bucket, corpus): occurrences in all texts of the words of flagged buckets. A partition's counts are one array of a fixed size."""
    flags = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))  # BUCKETS / 8 bytes

    def run(batches):
        wanted, counts = np.unpackbits(flags.value).astype(bool), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, 0):
            bucket = Words.of(batch.column(0)).buckets
            name, n = np.unique(bucket[wanted[bucket]], return_counts=True)
            counts[name] += n
        name = np.flatnonzero(counts)
        for a in range(0, len(name), 1 << 16):
            part = name[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["bucket", "corpus"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, corpus long").groupBy("bucket").agg(F.sum("corpus").alias("corpus"))


def context_counts(sample: DataFrame) -> DataFrame:
    """(bucket, bad, good): distinct contexts of words in toxic and in other texts of the sample."""

    def run(batches):
        for batch in slices(batches):
            w = Words.of(batch.column("text"))
            kind = np.repeat((batch.column("toxic").to_numpy(zero_copy_only=False) != 0).astype(np.uint64), np.diff(w.first))
            _, at = np.unique(w.contexts + kind, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.buckets[at]), pa.array(kind[at].astype(np.int64)), pa.array(w.contexts[at].view(np.int64))], names=["bucket", "toxic", "context"])

    each = sample.select("toxic", "text").mapInArrow(run, "bucket long, toxic long, context long").groupBy("bucket", "toxic", "context").agg(F.lit(1).alias("n"))
    return each.groupBy("bucket").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))


def _sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(id, toxic, text) of the bounded sample, stored."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long"))).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("toxic").cast("long").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(limit).collect()
    ids = F.broadcast(spark.createDataFrame(chosen, "id long, toxic long"))  # `limit` rows at most
    return stored(docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(ids, "id").select("id", "toxic", "text"), "toxic-sample")


def _stands_out(bad: Column, good: Column, n_bad: int, n_good: int) -> Column:
    """Signed root of the likelihood-ratio statistic of a word's two counts: positive where toxic texts have it oftener."""
    share = (bad + good) / F.lit(float(n_bad + n_good))
    part = lambda y, n: F.when(y > 0, y * F.log(y / (share * n))).otherwise(0.0)
    return F.signum(bad / n_bad - good / n_good) * F.sqrt(2 * F.greatest(part(bad, float(n_bad)) + part(good, float(n_good)), F.lit(0.0)))


def word_scores(docs: DataFrame, sample: DataFrame, prior: float = PRIOR, z_least: float = Z_LEAST) -> Model:
    """Word scores from the counting part of the sample, under the prior of all documents."""
    counts = stored(context_counts(sample.where(~_calibrates(F.col("id")))), "toxic-counts")
    total = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    if not total.bad or not total.good:
        discard(counts)
        return Model()
    # Only words of toxic texts can stand out; their buckets reach the tasks as one bit each.
    wanted = np.zeros(BUCKETS, bool)
    for batch in counts.where("bad > 0").select("bucket").toArrow().to_batches():  # BUCKETS rows at most
        wanted[batch.column(0).to_numpy()] = True
    words = stored(counts.where("bad > 0").join(corpus_counts(docs, wanted), "bucket"), "toxic-prior")
    mass = words.agg(F.sum("corpus").alias("m")).first().m
    weight = F.lit(prior) * F.col("corpus") / F.lit(float(mass))  # a word's share of all words that toxic texts have
    own = words.where(_stands_out(F.col("bad"), F.col("good"), total.bad, total.good) >= z_least)
    own = own.select("bucket", ((F.col("bad") + weight) / F.lit(total.bad + prior)).alias("q"), ((F.col("good") + weight) / F.lit(total.good + prior)).alias("p")).orderBy("bucket").toPandas()  # BUCKETS rows at most
    discard(counts, words)
    q, p = own["q"].to_numpy(float), own["p"].to_numpy(float)
    left = lambda x: max(1 - float(x.sum()), 1e-9)
    return Model(own["bucket"].to_numpy(np.int64), np.log(q / p), float(np.log(left(q) / left(p))))


_PASSAGE = {"first_word": T.LongType(), "last_word": T.LongType(), "start": T.LongType(), "end": T.LongType(), "score": T.DoubleType(), "expected": T.DoubleType()}
_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("best", T.DoubleType()), T.StructField("evidence", T.DoubleType()), T.StructField("passages", T.ArrayType(T.StructType([T.StructField(*f) for f in _PASSAGE.items()])))]


def passages(docs: DataFrame, model: Model, least: float | None = None, text: str = "text") -> DataFrame:
    """The columns of docs, n_words, best (score of the best passage), evidence, and the significant passages, best first.

    A passage: its first and last word by number, its bytes in the text (from 0, the end not included), its score and
    the expected count of such in clean text. least: the largest expected count of a significant one, E_MOST if not given."""
    spark = docs.sparkSession
    arrow_rows(spark)
    shared, most, place = spark.sparkContext.broadcast(model), E_MOST if least is None else least, len(docs.columns)
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches):
        model = shared.value
        table = model.table()
        for batch in slices(batches, place):
            w = Words.of(batch.column(place))
            score, first = w.scored(table, model.rest), w.first
            n = np.diff(first)
            best, proof, found = np.zeros(len(n)), np.zeros(len(n)), []
            for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                segments = sorted(maximal_segments(score[a:b]), key=lambda s: (-s[2], s[0]))
                proofs = model.evidence(np.array([s[2] for s in segments] or [0.0]), np.full(max(len(segments), 1), b - a))
                best[k] = segments[0][2] if segments else 0.0
                strong = proofs >= -np.log(most)
                proof[k] = proofs[strong].sum() if strong.any() else proofs[0]
                found.append([{"first_word": s, "last_word": e - 1, "start": int(w.starts[a + s] - w.base[k]), "end": int(w.ends[a + e - 1] - w.base[k]), "score": x, "expected": float(np.exp(-p))} for (s, e, x), p, yes in zip(segments, proofs.tolist(), strong.tolist(), strict=False) if yes and segments])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n.astype(np.int64)), pa.array(best), pa.array(proof), pa.array(found, kind)], names=[*batch.schema.names[:-1], "n_words", "best", "evidence", "passages"])

    taken = {c.lower() for c in docs.columns} & {f.name for f in _FIELDS}
    if taken:
        raise ValueError(f"docs has columns of the result's names: {sorted(taken)}")
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{text}`").cast("string").alias("_scored_text")).mapInArrow(run, T.StructType([*docs.schema.fields, *_FIELDS]))


def extreme_values(score: np.ndarray, n_words: np.ndarray) -> tuple[float, float]:
    """lambda and log K of best scores in clean texts, by maximum likelihood: for each lambda of a fine grid the best K has a closed form.

    A best score of zero only says that nothing positive occurred, so it counts by its probability exp(-K n). Scores that
    are exact log-likelihood ratios have lambda 1: few clean texts with a positive score leave it there (a normal prior of
    log lambda, deviation 0.1), and K is counted from half a text at least."""
    n, some = np.maximum(n_words, 1).astype(float), score > 0
    seen = some.sum() + 0.5
    at, best = (1.0, 0.0), -np.inf
    for log_lam in np.linspace(-1.5, 1.5, 301).tolist():
        lam = float(np.exp(log_lam))
        weight = (n * np.exp(-lam * score)).sum() + 1.0
        k = seen / weight
        value = seen * np.log(lam * k) - lam * score[some].sum() - k * weight - 50 * log_lam**2
        if value > best:
            at, best = (lam, float(np.log(k))), value
    return at


def curve(evidence: np.ndarray, toxic: np.ndarray, noise: float = 0.02) -> tuple[float, float]:
    """Intercept and slope of the logistic curve from evidence to the chance of a toxic label, the best of a grid.

    Labels are taken to be wrong at a rate of `noise`, so that toxic texts without a known word don't flatten the curve.
    With few rows it stays near a slope of one, with a half where a passage has an expected count of E_MOST / 10."""
    middle, slope = np.meshgrid(np.linspace(0, 20, 81), np.exp(np.linspace(np.log(0.25), np.log(4), 25)), indexing="ij")
    value = -0.5 * ((middle + np.log(E_MOST / 10)) / 2) ** 2 - 0.5 * np.log(slope) ** 2
    for e, t in zip(evidence.tolist(), toxic.tolist(), strict=True):
        p = noise + (1 - 2 * noise) / (1 + np.exp(-np.clip(slope * (e - middle), -500, 500)))
        value = value + np.log(p if t else 1 - p)
    k = np.unravel_index(np.argmax(value), value.shape)
    return float(-slope[k] * middle[k]), float(slope[k])


def train(docs: DataFrame, labels: DataFrame, docs_limit: int = TRAIN_DOCS, prior: float = PRIOR, z_least: float = Z_LEAST) -> Model:
    """Word scores and calibration; of single documents only ids, labels and best scores of the sample reach the driver."""
    arrow_rows(docs.sparkSession)
    sample = _sample(docs, labels, docs_limit)
    model = word_scores(docs, sample, prior, z_least)
    if len(model.buckets):
        part = sample.where(_calibrates(F.col("id")))
        seen = passages(part, model).select("toxic", "n_words", "best").orderBy("id", "best").toPandas()  # a row for each labelled text of the sample
        toxic, n, best = seen["toxic"].to_numpy() != 0, seen["n_words"].to_numpy(), seen["best"].to_numpy(float)
        model.lam, model.log_k = extreme_values(best[~toxic], n[~toxic])
        if toxic.any() and not toxic.all():
            proof = passages(part, model).where("best > 0").select("toxic", "evidence").orderBy("id", "evidence").toPandas()  # a text without a passage says nothing about passages
            model.curve = curve(proof["evidence"].to_numpy(float), proof["toxic"].to_numpy() != 0)
        else:
            model.curve = curve(np.zeros(0), np.zeros(0))
    discard(sample)
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages (significant ones) for every document."""
    model = train(docs, labels)
    rows = passages(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    if model.curve is None:
        score = F.lit(0.0)
    else:
        score = 1 / (1 + F.exp(-F.least(F.greatest(F.lit(float(model.curve[0])) + F.lit(float(model.curve[1])) * F.col("evidence"), F.lit(-500.0)), F.lit(500.0))))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
