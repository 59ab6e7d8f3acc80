"""Toxicity: segments against brute force, the whole query against plain Python, planted documents, edge cases."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from quarrymill.llm import toxicity as t

DOCS = "doc_id long, text string, label int, score double"
LABELS = "doc_id long, quality int, toxic int"


def tokens(text):
    return [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")]


def best_and_all(scores):
    """All maximal scoring segments by the definition: the best segment (leftmost, shortest), then left and right of it."""

    def solve(a, b):
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (best is None or total > best[2] or (total == best[2] and False)):
                    best = (i, j + 1, total)
        return [] if best is None else solve(a, best[0]) + [best] + solve(best[1], b)

    return solve(0, len(scores))


@pytest.mark.parametrize("seed", range(40))
def test_maximal_segments_against_their_definition(seed):
    rng = random.Random(seed)
    scores = np.array([rng.choice([1, 2, 3, 5, 7, 11]) * 1.0 + rng.random() / 64 if rng.random() < 0.4 else -rng.choice([1, 2, 4, 9]) - rng.random() / 64 for _ in range(rng.randint(0, 40))])
    got, want = sorted(t.maximal_segments(scores)), sorted(best_and_all(scores.tolist()))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and np.allclose([s for *_, s in got], [s for *_, s in want])


def test_long_sequences_take_linear_time():
    import time

    scores = np.where(np.arange(400_000) % 2 == 0, 1.0, -1.5)
    began = time.time()
    assert len(t.maximal_segments(scores)) == 200_000
    assert time.time() - began < 8


def corpus(rng, n=400):
    """Prose of common words; every fourth document has insults of a small list at a rate of one in twelve."""
    words, insults = [f"word{k}" for k in range(300)], ["vile", "scum", "rotten", "fool"]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        bad = i % 4 == 0
        if bad:
            for at in range(rng.randint(0, 5), len(text), 12):
                text[at] = rng.choice(insults).upper()
        rows.append((i, " ".join(text), 1, 0.5))
        labels.append((i, 1, int(bad)))
    return rows, labels


def plain(rows, labels):
    """The query in plain Python, by words instead of buckets."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    part = lambda i: zlib.crc32(str(i).encode()) % 5 == 4
    toxic = {}
    for i, _, y in labels:
        if i is not None and y is not None and not held(i):
            toxic[i] = min(y, toxic.get(i, y))
    count, contexts, corpus_n = {}, {0: set(), 1: set()}, {}

    def of(text):
        w = tokens(text)
        return [(w[k - 1] if k else None, w[k], w[k + 1] if k + 1 < len(w) else None) for k in range(len(w))]

    for i, text, *_ in rows:
        for _, w, _ in of(text):
            corpus_n[w] = corpus_n.get(w, 0) + 1
        if i in toxic and not part(i):
            contexts[toxic[i]] |= set(of(text))
    for y in (0, 1):
        for _, w, _ in contexts[y]:
            count.setdefault(w, [0, 0])[y] += 1
    n = [len(contexts[0]), len(contexts[1])]
    mass = sum(corpus_n[w] for w, c in count.items() if c[1])
    q, p = {}, {}
    for w, (good, bad) in count.items():
        if not bad:
            continue
        share = (good + bad) / sum(n)
        g = sum(y * math.log(y / (share * m)) for y, m in ((bad, n[1]), (good, n[0])) if y)
        if math.copysign(math.sqrt(max(2 * g, 0)), bad / n[1] - good / n[0]) >= t.Z_LEAST:
            weight = t.PRIOR * corpus_n[w] / mass
            q[w], p[w] = (bad + weight) / (n[1] + t.PRIOR), (good + weight) / (n[0] + t.PRIOR)
    score = {w: math.log(q[w] / p[w]) for w in q}
    rest = math.log((1 - sum(q.values())) / (1 - sum(p.values())))

    def segments(text):
        seen, out = set(), []
        for c in of(text):
            s = score.get(c[1], rest)
            out.append(min(rest, 0) if s > 0 and c in seen else s)
            seen.add(c)
        return [s for *_, s in t.maximal_segments(np.array(out))], len(out)

    best = [(toxic[i], *(lambda s: (max(s[0], default=0), s[1]))(segments(text))) for i, text, *_ in rows if i in toxic and part(i)]
    model = t.Model(lam=1.0)
    model.lam, model.log_k = t.extreme_values(np.array([b for y, b, _ in best if not y]), np.array([m for y, _, m in best if not y]))

    def evidence(text):
        s, m = segments(text)
        x = sorted((max(model.lam * v - model.log_k - math.log(max(m, 1)), 0) for v in s), reverse=True) or [0]
        strong = [v for v in x if v >= -math.log(t.E_MOST)]
        return sum(strong) if strong else x[0]

    known = sorted((i, evidence(text), toxic[i]) for i, text, *_ in rows if i in toxic and part(i) and segments(text)[0])
    model.curve = t.curve(np.array([e for _, e, _ in known]), np.array([y for *_, y in known]))
    return {i: (held(i), float(model.probability(np.array([evidence(text)]))[0])) for i, text, *_ in rows}


def test_query_against_plain_python(spark):
    rows, labels = corpus(random.Random(4))
    rows += [(1000, None, 1, 0.1), (1001, "", 1, 0.1), (1002, "Vile SCUM rotten fool vile fool scum rotten", 1, 0.1), (1003, "vile scum " * 400, 1, 0.1)]
    labels += [(0, 1, None), (None, 1, 1), (1, 1, 1), (1, 1, 0), (5000, 1, 1)]
    got = t.classify(spark.createDataFrame(rows, DOCS).repartition(6), spark.createDataFrame(labels, LABELS)).collect()
    want = plain(rows, labels)
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-6) and r.predicted == int(r.score >= 0.5)
    by = {r.doc_id: r for r in got}
    truth = {i: y for i, _, y in labels[:400]}
    own = [r for r in got if r.doc_id < 400 and r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in own) >= 0.98 * len(own)
    assert by[1000].predicted == by[1001].predicted == 0 and by[1002].predicted == 1


def test_passages_are_where_the_words_are(spark):
    rows, labels = corpus(random.Random(4))
    model = t.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    clean, bad = " ".join(f"word{k}" for k in range(100)), "Scum, vile fool! rotten scum: fool"
    text = f"é {clean} {bad} {clean} {bad[:15]} {clean}"
    frame = spark.createDataFrame([(text, "x"), (None, "y"), (clean, "z")], "text string, tag string")
    got = {r.tag: r for r in t.passages(frame, model).collect()}
    assert got["y"].passages == [] and got["y"].n_words == 0 and got["z"].passages == []
    spans = [text.encode()[p.start : p.end].decode() for p in got["x"].passages]
    assert spans[0].startswith("Scum, vile fool! rotten") and all(p.expected <= t.E_MOST for p in got["x"].passages)
    assert all(tokens(s) == tokens(text)[p.first_word : p.last_word + 1] for s, p in zip(spans, got["x"].passages))
    with pytest.raises(ValueError):
        t.passages(frame.withColumn("evidence", frame.tag), model)


def test_toxicity_of_nothing(spark):
    docs, labels = spark.createDataFrame([(1, "some words", 1, 0.1), (None, None, 1, 0.1)], DOCS), spark.createDataFrame([], LABELS)
    for d, y, n in ((docs, labels, 2), (spark.createDataFrame([], DOCS), labels, 0), (docs, spark.createDataFrame([(1, 1, 0)], LABELS), 2)):
        got = t.classify(d, y).collect()
        assert len(got) == n and all(r.score == 0 and r.predicted == 0 and r.held_out in (True, False) for r in got)


def test_extreme_values_find_the_law_that_made_the_scores():
    rng = np.random.default_rng(2)
    n = rng.integers(50, 3000, 20_000)
    score = np.maximum((-np.log(rng.exponential(size=len(n))) + np.log(0.02 * n)) / 1.3, 0)
    lam, log_k = t.extreme_values(score, n)
    assert lam == pytest.approx(1.3, rel=0.03) and log_k == pytest.approx(math.log(0.02), abs=0.15)


def test_held_out_accuracy_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = t.classify(docs, labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.98 * len(rows) and sum(r.predicted > r.toxic for r in rows) <= 0.005 * len(rows)
