"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's features are shares of kinds of characters and words, its length, and the
same of the lines before and after it; transitions tie neighbouring labels. The field is trained by gradient
ascent on the conditional likelihood of a bounded sample (`TRAIN_DOCS` labelled documents of at most
`TRAIN_BYTES` bytes and `TRAIN_LINES` lines, the ones with the smallest hashes of their id), each line carrying its
document's label. So the driver holds at most TRAIN_DOCS * TRAIN_LINES lines.
A document's score is the length-weighted mean of its lines' forward-backward marginals of "good".

Labels, language, source and id are never inputs of a score. Cases: null and empty text is one empty line and
gets a score from its features; a document of any length is scored whole (all documents of a slice advance in
lockstep, so the cost is per line); repeated rows are scored each; labels that are null are ignored and of
several labels of one document the least counts, of several texts under one id the least is learned from; with no labels, or of one kind only, the score is 0.5 for
every document. A null doc_id is not held out. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SPACE, arrow_rows, released, slices, utf8, word_hash, words

TRAIN_DOCS, TRAIN_BYTES, TRAIN_LINES = 4000, 20_000, 500
THRESHOLD = 0.7
_FLAGS = {
    "upper": lambda b: (b >= 65) & (b <= 90),
    "lower": lambda b: (b >= 97) & (b <= 122),
    "digit": lambda b: (b >= 48) & (b <= 57),
    "space": lambda b: SPACE[b],
    "high": lambda b: b >= 128,
    "plain": lambda b: (b == 44) | (b == 46) | (b == 39) | (b == 45),
    "bar": lambda b: b == 124,
    "shout": lambda b: (b == 33) | (b == 63),
    "symbol": lambda b: (b >= 33) & (b <= 126) & ~((b >= 48) & (b <= 57)) & ~((b >= 65) & (b <= 90)) & ~((b >= 97) & (b <= 122)) & (b != 44) & (b != 46) & (b != 39) & (b != 45),
}
N_OWN = len(_FLAGS) + 7
N_FEATURES = 3 * N_OWN + 3


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, lengths in bytes, and each text's first line (one more entry than texts)."""
    data, offsets = utf8(column)
    breaks = np.flatnonzero(data == 10)
    # A line starts at a text's start and after every line feed; the feed itself belongs to no line.
    owner = np.searchsorted(offsets, breaks, side="right") - 1
    per_doc = 1 + np.bincount(owner, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    heads = first[:-1]
    is_head = np.zeros(first[-1], bool)
    is_head[heads] = True
    starts[heads], starts[~is_head] = offsets[:-1], breaks + 1
    is_tail = np.zeros(first[-1], bool)
    is_tail[first[1:] - 1] = True
    ends[is_tail], ends[~is_tail] = offsets[1:], breaks
    size = ends - starts
    of = np.maximum(size, 1)
    own = np.zeros((first[-1], N_OWN), np.float32)
    running = np.zeros(len(data) + 1, np.int32)
    for k, flag in enumerate(_FLAGS.values()):
        np.cumsum(flag(data), out=running[1:])
        own[:, k] = (running[ends] - running[starts]) / of
    w_starts, w_ends, _ = words(data, np.append(starts, len(data)), SPACE)
    h = word_hash(data, w_starts, w_ends)
    a, b = np.searchsorted(w_starts, starts), np.searchsorted(w_starts, ends)
    n = b - a
    same = np.zeros(len(h) + 1, np.int32)
    if len(h) > 1:
        np.cumsum(h[1:] == h[:-1], out=same[2:])
    repeats = np.where(n > 1, same[np.maximum(b, 1)] - same[np.minimum(a + 1, len(h))], 0)
    sizes = np.concatenate([[0], np.cumsum(w_ends - w_starts)])
    k = len(_FLAGS)
    own[:, k] = repeats / np.maximum(n - 1, 1)
    own[:, k + 1] = np.log1p(size) / 10
    own[:, k + 2] = np.log1p(n) / 8
    own[:, k + 3] = np.where(n > 0, (sizes[b] - sizes[a]) / np.maximum(n, 1) / 10, 0)
    own[:, k + 4] = size == 0
    own[:, k + 5] = np.minimum(own[:, 8] * 20, 1)  # any symbols at all
    own[:, k + 6] = (n > 0) & (own[:, 0] > 0.5)
    out = np.zeros((first[-1], N_FEATURES), np.float32)
    out[:, :N_OWN] = own
    out[1:, N_OWN : 2 * N_OWN] = own[:-1]
    out[is_head, N_OWN : 2 * N_OWN] = 0
    out[:-1, 2 * N_OWN : 3 * N_OWN] = own[1:]
    out[is_tail, 2 * N_OWN : 3 * N_OWN] = 0
    out[:, -3], out[:, -2], out[:, -1] = is_head, is_tail, 1
    return out, size, first


def marginals(score: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all chains in lockstep: P(good) of every line and summed pair marginals (2 x 2).

    score: the log-odds of good of every line on its own; transition: log potentials [from, to], 0 bad, 1 good."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = first[:-1][order], sizes[order]
    good = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    own = np.stack([1 - good, good], axis=1)
    step = np.exp(transition - transition.max())
    top = int(sizes.max()) if len(sizes) else 0
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(top + 1)]  # chains longer than t
    forward, backward = np.empty_like(own), np.ones_like(own)
    for t in range(top):
        at = starts[: live[t]] + t
        a = own[at] if t == 0 else (forward[at - 1] @ step) * own[at]
        forward[at] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(top - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        right = own[at + 1] * backward[at + 1]
        b = right @ step.T
        joint = forward[at][:, :, None] * step * right[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        backward[at] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), pairs


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.08, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that maximise the conditional likelihood of constant chains (Adam, full batch)."""
    weights, transition = np.zeros(features.shape[1]), np.zeros((2, 2))
    if len(labels) == 0 or labels.min() == labels.max():
        return weights, transition
    sizes = np.diff(first)
    y = np.repeat(labels, sizes).astype(float)
    n = len(y)
    held = np.array([[((labels == a) * (sizes - 1)).sum() * (a == b) for b in (0, 1)] for a in (0, 1)], float)
    at = np.concatenate([weights, transition.ravel()])
    m, v = np.zeros_like(at), np.zeros_like(at)
    x = features.astype(np.float64)
    for t in range(1, rounds + 1):
        p, pairs = marginals(x @ at[:-4], first, at[-4:].reshape(2, 2))
        gradient = np.concatenate([x.T @ (y - p), (held - pairs).ravel()]) / n - decay * at
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        at = at + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return at[:-4], at[-4:].reshape(2, 2)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, docs_limit: int = TRAIN_DOCS, bytes_limit: int = TRAIN_BYTES, lines_limit: int = TRAIN_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Fit the field on the bounded sample; only ids of `docs_limit` labels and those documents' features reach the driver."""
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(docs_limit).collect()
    sample = F.broadcast(spark.createDataFrame(chosen, "id long, quality int"))  # docs_limit rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(sample, "id")
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    source = texts.where((F.octet_length("text") <= bytes_limit) & (lines <= lines_limit)).groupBy("id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))

    def run(batches):
        for batch in slices(batches):
            x, _, first = line_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("quality"), pa.array([x[a:b].astype(np.float16).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["id", "quality", "x"])

    rows = source.mapInArrow(released(run), "id long, quality int, x binary").collect()
    rows.sort(key=lambda r: r.id)
    parts = [np.frombuffer(r.x, np.float16).reshape(-1, N_FEATURES) for r in rows]
    if not parts:
        return np.zeros(N_FEATURES), np.zeros((2, 2))
    return fit(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.array([r.quality for r in rows]))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The columns of docs and `score`; every row kept."""
    arrow_rows(docs.sparkSession)
    weights, transition = model

    def run(batches):
        for batch in slices(batches, batch_text):
            x, size, first = line_features(batch.column(batch_text))
            p, _ = marginals(x @ weights, first, transition)
            mass = np.maximum(size, 1)
            total = np.add.reduceat(mass * p, first[:-1]) / np.add.reduceat(mass, first[:-1])
            columns = [*batch.columns[:-1], pa.array(np.clip(total, 0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score"])

    from pyspark.sql import types as T

    batch_text = len(docs.columns)
    frame = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("text").cast("string").alias("_scored_text"))
    return frame.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels)
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
