"""Decontamination in bounded memory: equal windows, repeated words, small steps, many blocks."""

import random
import resource
import time

import numpy as np
import pyarrow as pa
import pytest

from quarrymill.llm import decontaminate as d

from .test_operators import contamination_truth, table


def segment_of(texts, gap=11):
    hashes, first = d.term_hashes(pa.array(texts))
    counts = np.diff(first)
    position = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)) * gap, counts)
    order = np.argsort(hashes, kind="stable")
    terms, df = np.unique(hashes[order], return_counts=True)
    gaps = np.diff(position[order], prepend=0)
    heads = np.cumsum(df) - df
    gaps[heads] = position[order][heads]
    base = np.concatenate([[0], np.cumsum(counts)])[:-1] + np.arange(len(counts)) * gap
    return d.Segment({"terms": terms.tobytes(), "counts": df.astype(np.uint32).tobytes(), "gaps": gaps.astype(np.uint32).tobytes()}), base, int(base[-1] + counts[-1]) + 10


def test_one_repeated_word_takes_little_time_and_memory():
    """An item of 2,000 equal words against a document of 40,000: nearly eighty million occurrences by item window."""
    w = d.Windows([("a", "word " * 2000), ("b", "word " * 12)], 10)
    assert len(w.start) == 1 and w.item.tolist() == [0, 1]
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    segment, base, length = segment_of(["word " * 40_000, "another text"])
    first, last, pairs = d._hits(segment, w, base, length, None)
    assert (first.tolist(), last.tolist(), pairs.tolist()) == ([0], [40_000], [0, 1])
    assert time.time() - began < 2 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10


def test_two_words_in_many_orders_take_little_memory():
    rng = random.Random(1)
    two = lambda n: " ".join(rng.choice("xy") for _ in range(n))
    item, body = two(1500), two(30_000)
    w = d.Windows([("a", item)], 10)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    segment, base, length = segment_of([body])
    first, last, pairs = d._hits(segment, w, base, length, None)
    held, hit, t = {tuple(item.split()[k : k + 10]) for k in range(1491)}, set(), body.split()
    for k in range(len(t) - 9):
        if tuple(t[k : k + 10]) in held:
            hit |= set(range(k, k + 10))
    assert {p for a, b in zip(first.tolist(), last.tolist()) for p in range(a, b)} == hit and pairs.tolist() == [0]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10


@pytest.mark.parametrize("windows, positions", [(1, 1), (3, 7), (1 << 15, 5)])
def test_small_steps_lose_nothing(monkeypatch, windows, positions):
    monkeypatch.setattr(d, "STEP_WINDOWS", windows)
    monkeypatch.setattr(d, "STEP_POSITIONS", positions)
    rng = random.Random(windows + positions)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(8)]
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))) for k in range(12)]
    w = d.Windows([(str(i), t) for i, t in items], 10)
    segment, base, length = segment_of(texts)
    first, last, pairs = d._hits(segment, w, base, length, None)
    doc = np.searchsorted(base, first, side="right") - 1
    hit, names = [0] * 8, [set() for _ in range(8)]
    for k, a, b in zip(doc.tolist(), first.tolist(), last.tolist()):
        hit[k] += b - a
    for p in pairs.tolist():
        names[p // 12].add(str(p % 12))
    want = {r[0]: r for r in contamination_truth(list(enumerate(texts)), items)}
    assert [(hit[k], len(names[k])) for k in range(8)] == [(want[k][2], want[k][3]) for k in range(8)]


def test_windows_of_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(d, "mix", lambda h: h * np.uint64(0))
    w = d.Windows([("a", "one two three"), ("b", "one two four"), ("c", "one two three"), ("d", "one two")], 10)
    assert len(w.start) == 3 and sorted(np.diff(w.item_edges).tolist()) == [1, 1, 2]


def test_many_blocks_equal_one(spark):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice(("salt", "road", "mill", "lamp")) for _ in range(rng.randint(1, 30)))) for k in range(40)]
    rows = [(k, " ".join(rng.choice(("salt", "road", "mill", "lamp")) for _ in range(rng.randint(0, 80)))) for k in range(30)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), table(spark, rows)
    show = lambda frame: sorted((r.doc_id, r.n, tuple(sorted(r["items"]))) for r in frame.select("doc_id", "items", d.n_hit().alias("n")).collect())
    assert show(d.exact_matches(docs, bench, block_words=25)) == show(d.exact_matches(docs, bench))
