"""Whole queries against plain Python, and what all operators share: very long texts, clashing columns, empty tables."""

import functools
import hashlib
import math
import random

import pytest

from quarrymill.llm import chat, decontaminate, jaccard, licences, lm, pieces, quality, suffixes, topk, warc

from .test_operators import best_path, contamination_truth, dedup_truth, jaccard_truth, prose, table

SPACES = b" \t\n\x0b\x0c\r"


def plain_line(line):
    """Features of one line, byte by byte."""
    size, words = len(line), line.split()
    inside = lambda f: sum(map(f, line)) / max(size, 1)
    alnum = lambda c: 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122
    shares = [
        inside(lambda c: 65 <= c <= 90), inside(lambda c: 97 <= c <= 122), inside(lambda c: 48 <= c <= 57), inside(lambda c: c in SPACES), inside(lambda c: c >= 128),
        inside(lambda c: c in b",.'-"), inside(lambda c: c == 124), inside(lambda c: c in b"!?"), inside(lambda c: 33 <= c <= 126 and not alnum(c) and c not in b",.'-"),
    ]
    n = len(words)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / (n - 1) if n > 1 else 0
    mean = sum(map(len, words)) / n / 10 if n else 0
    return [*shares, repeats, math.log1p(size) / 10, math.log1p(n) / 8, mean, float(size == 0), min(shares[8] * 20, 1), float(n > 0 and shares[0] > 0.5)]


def plain_quality(text, weights, transition):
    """Length-weighted mean of the lines' marginals, by forward and backward sums over one document."""
    lines = (text or "").encode().split(b"\n")
    own = [plain_line(x) for x in lines]
    none = [0.0] * len(own[0])
    rows = [[*own[t], *(own[t - 1] if t else none), *(own[t + 1] if t + 1 < len(own) else none), float(t == 0), float(t + 1 == len(own)), 1.0] for t in range(len(own))]
    score = [sum(a * b for a, b in zip(r, weights, strict=True)) for r in rows]
    node = [(1.0, math.exp(s)) for s in score]
    edge = [[math.exp(transition[a][b]) for b in (0, 1)] for a in (0, 1)]
    forward, backward = [node[0]], [(1.0, 1.0)]
    for t in range(1, len(node)):
        f = [sum(forward[-1][a] * edge[a][b] for a in (0, 1)) * node[t][b] for b in (0, 1)]
        forward.append(tuple(x / sum(f) for x in f))
    for t in range(len(node) - 1, 0, -1):
        b = [sum(edge[a][c] * node[t][c] * backward[0][c] for c in (0, 1)) for a in (0, 1)]
        backward.insert(0, tuple(x / sum(b) for x in b))
    good = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward, strict=True)]
    mass = [max(len(x), 1) for x in lines]
    return sum(m * g for m, g in zip(mass, good, strict=True)) / sum(mass)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables with good and bad documents, copies, shared passages, benchmark passages, nulls and repeats."""
    rng = random.Random(12)
    junk = lambda: "\n".join(" ".join(rng.choice(["BUY!!!", "$$$", "###", "CLICK", "||", "@@"]) for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(2, 9)))
    good = lambda n: "\n".join(prose(rng, rng.randint(8, 20)) + "." for _ in range(n))
    passage, item = prose(rng, 40), prose(rng, 14)
    rows = [(i, junk() if i % 3 == 0 else good(rng.randint(2, 6))) for i in range(60)]
    base = prose(rng, 90).split()
    rows += [(100 + i, " ".join([*base[:i], f"edit{i}", *base[i + 1 :]])) for i in range(4)] + [(110, " ".join(base)), (111, " ".join(base))]
    rows += [(120 + i, good(2) + "\n" + passage + "\n" + good(1)) for i in range(3)] + [(130, good(2) + " " + item + " " + prose(rng, 4)), (140, ""), (141, None)]
    labels = [(i, int(i % 3 != 0), 0) for i in range(60)] + [(100, 1, 0)]
    folder = str(tmp_path_factory.mktemp("tables"))
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, item), (2, "never seen anywhere in these rows at all my friend")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_quality_query_against_plain_python(spark, small):
    from quarrymill.llm import queries

    folder, rows, _ = small
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    weights, transition = quality.train(docs, labels)
    got = {r.doc_id: r for r in queries.op7_quality(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = plain_quality(t, weights.tolist(), transition.tolist())
        assert abs(got[i].score - want) < 1e-3 and got[i].predicted == int(got[i].score >= 0.7), i


def test_training_climbs_the_likelihood():
    """The gradient that fit follows is that of the conditional likelihood: moving any weight from the fitted point doesn't help."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(1)
    texts = [prose(rng, 12) + "\n" + prose(rng, 9) if k % 2 else "!!! ###\n$$$ BUY" for k in range(30)]
    labels = np.array([k % 2 if k % 7 else 1 - k % 2 for k in range(30)])
    x, _, first = quality.line_features(pa.array(texts))
    weights, transition = quality.fit(x, first, labels, rounds=2000, rate=0.02, decay=1e-2)

    def objective(w, t):
        total = 0.0
        for k in range(30):
            s = x[first[k] : first[k + 1]].astype(float) @ w
            n = len(s)
            weight = lambda y: sum(s[i] * y[i] for i in range(n)) + sum(t[y[i]][y[i + 1]] for i in range(n - 1))  # noqa: E731, B023
            ways = [[b >> i & 1 for i in range(n)] for b in range(1 << n)]
            total += weight([labels[k]] * n) - math.log(sum(math.exp(weight(y)) for y in ways))
        return total / len(x) - 0.5e-2 * ((w**2).sum() + (np.asarray(t) ** 2).sum())

    best = objective(weights, transition)
    for k in range(0, len(weights), 3):
        for d in (-0.05, 0.05):
            moved = weights.copy()
            moved[k] += d
            assert objective(moved, transition) <= best + 1e-5


def test_pipeline_against_plain_python(spark, small):
    """Every stage by brute force: scores, components, repeated bytes, contaminated documents, pieces."""
    from sentencepiece import SentencePieceProcessor

    import corpus_pipeline as p

    folder, rows, items = small
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = [m.tolist() for m in quality.train(docs, labels)]
    left = [(i, t) for i, t in rows if plain_quality(t, *model) >= quality.THRESHOLD]
    least = {k[0]: k[2] for k in jaccard_truth(left)}
    left = [(i, t) for i, t in left if least[i] == i]
    first = {}
    for i, t in left:
        b = (t or "").encode()
        for k in range(len(b) - 99):
            first.setdefault(b[k : k + 100], (i, k))
    cut = []
    for i, t in sorted(left):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if first[b[k : k + 100]] != (i, k):
                gone[k : k + 100] = b"\1" * 100
        cut.append((i, t if t is None else bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")))
    assert dedup_truth(left) and any(len(a or "") < len(b or "") for (_, a), (_, b) in zip(cut, sorted(left), strict=True))
    hit = {k[0] for k in contamination_truth(cut, items) if k[5]}
    cut = [(i, t) for i, t in cut if i not in hit]
    proto = pieces._proto(None)
    sp, v = SentencePieceProcessor(model_proto=proto), pieces.Vocabulary(proto)
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    want = {}
    for i, t in cut:
        ids = []
        for name in best_path(v, scores, t) if t else []:
            ids += [sp.piece_to_id(name)] if name in scores else [sp.piece_to_id(f"<0x{b:02X}>") for b in name.encode()]
        want[i] = (len((t or "").encode()), ids)
    got = {r.doc_id: r for r in p.run(spark, folder).collect()}
    assert {i: (r.n_bytes, list(r.ids)) for i, r in got.items()} == want and hit == {130}
    assert all(r.round_trip and r.decoded_sha256 == hashlib.sha256((dict(cut)[i] or "").encode()).hexdigest() for i, r in got.items())


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_with_repeated_ids(spark, tmp_path):
    """What rows of one id share: the near-copy stage keeps exact repeats once, the decontamination stage drops all rows of a hit id."""
    import corpus_pipeline as p

    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in ((1, "a b c d e f"), (1, "a b c d e f"), (2, item), (2, "clean words"))], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in p.drop_near_copies(spark, docs, "").collect()) == [(1, "a b c d e f"), (2, "clean words"), (2, item)]
    assert {r.doc_id for r in p.drop_contaminated(spark, docs, str(tmp_path)).collect()} == {1}


def test_texts_of_several_megabytes(spark):
    """One very long text beside short ones, through every operator: whole, and told apart from its copy's edit."""
    rng = random.Random(4)
    long = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(400_000))
    rows = [(1, long), (2, long + " tail"), (3, "short text here"), (4, "x" * 3_000_000)]
    docs = table(spark, rows)
    sizes = {i: len(t) for i, t in rows}
    tokens = {r.doc_id: r for r in pieces.round_trip(docs).collect()}
    assert all(r.round_trip and r.n_bytes == sizes[i] for i, r in tokens.items())
    assert {r.doc_id: r.component_id for r in jaccard.classify(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    removed = {r.doc_id: r.n_removed for r in suffixes.dedup(docs).collect()}
    assert removed[1] == 0 and removed[2] >= len(long) and removed[3] == 0 and removed[4] == 3_000_000 - 1
    bench = spark.createDataFrame([(7, " ".join(long.split()[350_000:350_012]))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.report(docs, bench).collect()} == {1: 12, 2: 12, 3: 0, 4: 0}
    assert {r.doc_id: r.n_tokens for r in lm.score(docs, lm.train(docs)).collect()} == {1: 400_001, 2: 400_002, 3: 4, 4: 2}
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == 4
    assert {r.doc_id: r.n_units for r in licences.scan(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    turns = spark.createDataFrame([(1, 0, "assistant", long), (1, 1, "user", "y")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(turns).first().loss_chars == len(long)


def test_clashing_columns(spark):
    """Columns named like the operators' own are ignored or kept as they are."""
    vectors = spark.createDataFrame([(i, [i / 64.0, 1.0], i, "v", 3, 0.5, 9) for i in range(25)], "vec_id long, embedding array<double>, id int, vec string, rank int, score double, query_id int")
    assert topk.search_every_20th(vectors, 3).count() == 6
    docs = spark.createDataFrame([(1, "Released under the MIT License.", 5, "x", "y", 0.1, "z")], "doc_id long, text string, n_units int, licence string, licences string, dice double, _words string")
    assert licences.scan(docs).first().licences == "MIT"
    docs = spark.createDataFrame([(1, "one two three four five", "a", 1, "b", "c", 2)], "doc_id long, text string, component_id string, n int, _kept string, _times string, part int")
    assert jaccard.keep_one(docs).first().asDict() == docs.first().asDict() and suffixes.keep_rest(docs).first().asDict() == docs.first().asDict()
    assert quality.score(docs.withColumnRenamed("part", "size"), quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))).count() == 1


def test_empty_tables(spark, tmp_path):
    docs = table(spark, [])
    assert pieces.encode(docs).count() == pieces.decode(pieces.encode(docs)).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.proximity_matches(docs, bench, slop=3).count() == 0
    assert chat.render_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert jaccard.keep_one(docs).count() == suffixes.keep_rest(docs).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write(pages, f"file://{tmp_path}/w")["records"] == 0 and warc.read(spark, f"file://{tmp_path}/w").count() == 0


def test_anchors_by_pieces_serve_the_same_windows():
    """Pieces of any size: every window of every document is served once, by the string with the least hash in it."""
    import random

    import numpy as np

    from quarrymill.llm import suffixes

    rng = random.Random(8)
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (0, 700, 99, 100, 1500, 0, 101)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    windows = lambda found: {(int(d), w): int(at) for d, at, a, b in zip(*found[:4]) for w in range(int(a), int(b) + 1)}
    whole = windows(suffixes.anchors(data, offsets))
    assert len(whole) == sum(max(len(t) - 99, 0) for t in texts)
    for piece in (1, 37, 100, 999):
        assert windows(suffixes.anchors(data, offsets, piece)) == whole


def test_short_texts_alone_lose_nothing(spark):
    """Many texts, none of them as long as a window."""
    from quarrymill.llm import suffixes

    docs = spark.createDataFrame([(i, "the same forty bytes of text, over again") for i in range(30)], "doc_id long, text string")
    assert {(r.n_bytes, r.n_removed) for r in suffixes.dedup(docs).collect()} == {(40, 0)}


def test_files_follow_cores_and_data_not_shuffle_partitions(spark, small, monkeypatch):
    """With 40 shuffle partitions on four cores, no stage and none of its tables after the first shuffle has more than eight files."""
    import corpus_pipeline as p
    from quarrymill.llm import jaccard, suffixes
    from quarrymill.operators import components

    files = {}

    def counted(frame, name, *more, stored):
        out = stored(frame, name, *more)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    for module in (components, jaccard, suffixes):
        monkeypatch.setattr(module, "stored", functools.partial(counted, stored=module.stored))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.read.parquet(f"{small[0]}/documents.parquet").repartition(20)
        for name, stage in p.STAGES:
            files[name] = stage(spark, docs, small[0]).rdd.getNumPartitions()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    del files["shingle-sets"]  # as many as the table's splits
    assert {"candidate-pairs", "components", "suffix-blocks", "suffix-contexts", "kept-ids", "links"} < set(files) and max(files.values()) <= 8
