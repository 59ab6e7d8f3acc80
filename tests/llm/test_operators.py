"""The training-data operators on small tables: brute force, edge cases, skew in miniature."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.llm import chat, decontaminate, jaccard, licences, lm, pieces, quality, suffixes, topk, warc

WORDS = "the of and to in ore tin salt quarry mill stone water lamp road field".split()
DOCS = "doc_id long, text string, lang string, part int, kind string"


def table(spark, rows, schema=DOCS):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "en", 7, "x") for r in rows] if schema == DOCS else rows, schema)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", "s", "ing"]) + str(rng.randint(0, 400))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Nulls, empty, short, long, copies, near copies, a shared passage, a repeated id and a null id."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    base = prose(rng, 120).split()
    rows = [(1, None), (2, ""), (3, "One Two"), (4, "one two"), (5, "  \t\n "), (6, prose(rng, 3000)), (None, prose(rng, 50)), (7, prose(rng, 40)), (7, prose(rng, 40))]
    rows += [(10 + i, prose(rng, 80) + " " + passage + "\n" + prose(rng, 30)) for i in range(12)]
    for i in range(90):  # more near copies than one shingle may pair at first
        edited = list(base)
        edited[rng.randrange(len(edited))] = f"edit{i}"
        rows.append((100 + i, " ".join(edited)))
    rows += [(300 + i, " ".join(base)) for i in range(5)]
    rows += [(400, "for " * 300), (401, "x" * 5000), (402, "日本語テキスト " * 60), (403, "ünï " * 80)]
    rows += [(500, rows[5][1]), (10, rows[9][1])]
    return rows


# ---- 1: SentencePiece --------------------------------------------------------------------------------


def best_path(v, scores, text):
    """Plain dynamic programme over one text: pieces by name, longest last piece on ties."""
    chars = "▁" + text.replace(" ", "▁")
    n = len(chars)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for e in range(1, n + 1):
        for s in range(max(0, e - v.longest), e):
            value = scores.get(chars[s:e], v.unknown if e == s + 1 else -math.inf)
            if best[s] + value > best[e]:
                best[e], back[e] = best[s] + value, s
    out = []
    while n:
        out.append(chars[back[n] : n])
        n = back[n]
    return out[::-1]


@pytest.mark.parametrize("chunk", [16, 17, 40, 1024])
def test_pieces_match_plain_viterbi_and_round_trip(chunk):
    from sentencepiece import SentencePieceProcessor

    proto = pieces._proto(None)
    sp, v = SentencePieceProcessor(model_proto=proto), pieces.Vocabulary(proto)
    v.chunk = chunk
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    rng = random.Random(2)
    texts = ["the quick brown fox", "x" * 200, "".join(rng.choice("abcdehilnorst") for _ in range(900)), "  two  spaces ", "tab\tand\nline", "emoji 😀 日本語", "a" * 63, "a" * 64, "a" * 65, " " * 150]
    texts += ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    for _ in range(2):  # the second time from what is remembered
        ids, first = v.encode(pa.array(texts))
        data, offsets = v.decode(ids, first)
        for i, text in enumerate(texts):
            assert data[offsets[i] : offsets[i + 1]].tobytes().decode() == text
            want = []
            for name in best_path(v, scores, text):
                want += [sp.piece_to_id(name)] if name in scores else [sp.piece_to_id(f"<0x{b:02X}>") for b in name.encode()]
            assert ids[first[i] : first[i + 1]].tolist() == want, text[:40]
    assert v.matrices > 10


def test_documents_go_through_transfer_matrices(sf_dir):
    """On the table itself: every chunk of a slice has a matrix in the scan, and the ids are those of the plain path."""
    import pyarrow.parquet as pq

    proto = pieces._proto(None)
    v, whole = pieces.Vocabulary(proto), pieces.Vocabulary(proto)
    whole.chunk = 1 << 40  # no chunk ends: stretches alone
    texts = pq.read_table(f"{sf_dir}/documents.parquet").column("text").combine_chunks()
    ids, first = v.encode(texts)
    plain, plain_first = whole.encode(texts)
    assert v.matrices > 300 and whole.matrices == 0
    assert (ids == plain).all() and (first == plain_first).all()


def test_equal_hashes_of_unlike_stretches_are_told_apart(monkeypatch):
    proto = pieces._proto(None)
    v, plain = pieces.Vocabulary(proto), pieces.Vocabulary(proto)
    texts = pa.array(["one two three four", "three one", "fives six"])
    want = plain.encode(texts)[0].tolist()
    monkeypatch.setattr(pieces, "word_hash", lambda data, starts, ends: (ends - starts).astype(np.uint64) // np.uint64(12))
    assert v.encode(texts)[0].tolist() == want and v.encode(texts)[0].tolist() == want


def test_transfer_matrices_are_associative():
    rng = np.random.default_rng(1)
    m = rng.integers(-9, 0, (7, 4, 4)).astype(float)
    scan = pieces.max_plus_scan(m)
    one = m[:1]
    for k in range(1, 7):
        one = pieces.max_plus(one, m[k : k + 1])
        assert (scan[k] == one[0]).all()


def test_pieces_query_keeps_every_row(spark, corpus):
    rows = corpus + [(600, "▁ literal ▁mark")]
    got = pieces.round_trip(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_pieces for r in got}[1] == 0
    back = pieces.decode(pieces.encode(table(spark, rows))).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in rows)
    assert pieces.round_trip(table(spark, [])).count() == 0


# ---- 2: top-k ----------------------------------------------------------------------------------------


def test_topk_against_brute_force(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(40)]
    odd = [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [0.25]), (None, [1.0] * 8), (420, [])]
    frame = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    q = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in vectors + [(404, [0.25]), (420, [])]}
    want = set()
    for a in (i for i in q if i % 20 == 0):
        scored = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=False)), b) for b in q if b != a)[:20]
        want |= {(a, k + 1, b, -s) for k, (s, b) in enumerate(scored)}
    rows = frame.where("vec_id is not null").unionByName(frame.where("vec_id is null"))
    assert {tuple(r) for r in topk.search_every_20th(rows).collect()} == want
    small = rows.where(F.col("vec_id").isNotNull() & topk.usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("vec"))
    many = topk.topk(small.where("id % 20 = 0"), small, candidate_block=50, query_block=5)
    assert {tuple(r) for r in many.collect()} == want
    assert topk.search_every_20th(frame.limit(0)).count() == 0


def block_truth(q, c, k):
    scores = q @ c.T
    return {(i, int(j), int(scores[i, j])) for i in range(len(q)) for j in sorted(range(len(c)), key=lambda j: (-scores[i, j], j))[:k]}


def test_topk_stops_for_each_query_alone():
    rng = np.random.default_rng(3)
    c, q = np.floor(64 * rng.standard_normal((2000, 64))), np.floor(64 * rng.standard_normal((40, 64)))
    q[:5, 2:] = 0  # two lists decide these
    ids, found, scores, depth = topk.block_topk(np.arange(40) + 10_000, q, np.arange(2000), c, 20)
    assert set(zip((ids - 10_000).tolist(), found.tolist(), scores.tolist(), strict=True)) == block_truth(q, c, 20)
    assert depth[ids < 10_005].max() <= 0.5 < depth[ids >= 10_005].min() and depth.max() < 1


def test_topk_stops_early_with_exact_results():
    rng = np.random.default_rng(4)
    c = np.zeros((3000, 6))
    c[np.arange(3000), rng.integers(0, 6, 3000)] = rng.integers(0, 5, 3000)
    c[:30] = rng.integers(40, 60, (30, 6))
    q = np.abs(rng.integers(0, 9, (20, 6))).astype(float)
    a, b, s, depth = topk.block_topk(np.arange(20) + 10_000, q, np.arange(3000), c, 5)
    assert set(zip((a - 10_000).tolist(), b.tolist(), s.tolist(), strict=True)) == block_truth(q, c, 5) and depth.max() < 0.1


def test_topk_of_ties_huge_numbers_and_own_rows():
    rng = np.random.default_rng(5)
    c = rng.integers(-2, 3, (500, 3)).astype(float)
    a, b, s, _ = topk.block_topk(np.arange(500), c, np.arange(500), c, 4)
    scores = c @ c.T
    want = {(i, j, int(scores[i, j])) for i in range(500) for j in sorted((j for j in range(500) if j != i), key=lambda j: (-scores[i, j], j))[:4]}
    assert set(zip(a.tolist(), b.tolist(), s.tolist(), strict=True)) == want
    big = np.array([[2.0**27 + 1, 3], [2.0**27, 5], [1, 1]])
    _, b, s, _ = topk.block_topk(np.array([9]), big[:1], np.arange(3), big, 2)
    assert b.tolist() == [0, 1] and s.tolist() == [(2**27 + 1) ** 2 + 9, 2**27 * (2**27 + 1) + 15]


def test_topk_on_the_table(spark, sf_dir):
    """Every row comes out of the loop of steps, at a depth that is reported."""
    rows = topk.search_every_20th(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), with_depth=True).collect()
    assert rows and all(0 < r.depth <= 1 for r in rows)


def test_repeated_query_ids_find_their_rows_once(spark):
    rows = spark.createDataFrame([(20, [9]), (20, [1]), (1, [2]), (2, [3])], "id long, vec array<long>")
    got = topk.topk(rows.where("id = 20"), rows, k=5).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(20, 1, 2, 3), (20, 2, 1, 2)]


# ---- 3: n-gram Jaccard -------------------------------------------------------------------------------


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = [x for x in re.split("[ \t-\r]+", lower(t)) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_truth(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            parent[find(a)] = find(b)
    out = []
    for a, (i, s) in enumerate(sets):
        ids = [sets[b][0] for b in range(len(rows)) if find(b) == find(a) and sets[b][0] is not None]
        out.append((i, len(s), (min(ids) if ids else None) if s else i))
    return Counter(out)


def test_jaccard_against_brute_force(spark, corpus):
    got = Counter(tuple(r) for r in jaccard.classify(table(spark, corpus)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == jaccard_truth(corpus)
    assert jaccard.classify(table(spark, [])).count() == 0


def test_jaccard_near_the_threshold(spark):
    """Chains of documents whose similarities lie closely around 0.8, of many sizes."""
    rng = random.Random(8)
    rows = []
    for k in range(40):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 60))]
        for step in range(4):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
            words = words[: len(words) - rng.randint(0, 2)] or ["w"]
    got = Counter(tuple(r) for r in jaccard.classify(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == jaccard_truth(rows)


@pytest.mark.parametrize("large, fair", [(2, 1.0), (8, 1.0), (2, 0.003), (8, 0.05)])
def test_jaccard_groups_without_their_base(spark, monkeypatch, large, fair):
    """A low FAIR salts shingles, deals hubs to many places and cuts shingles into blocks. Near copies with one to six edits each, their base missing, of several lengths, some edits and passages shared between groups."""
    monkeypatch.setattr(jaccard, "LARGE", large)
    monkeypatch.setattr(jaccard, "FAIR", fair)
    rng = random.Random(large)
    rows = []
    common = [f"c{i}" for i in range(25)]
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(rng.choice((40, 60, 90, 140)))] + common
        for _ in range(28):
            words = list(base)
            for _ in range(rng.randint(1, 6)):
                at = rng.randrange(len(words))
                kind = rng.random()
                if kind < 0.5:
                    words[at] = f"e{rng.randint(0, 10)}"
                elif kind < 0.75:
                    del words[at]
                else:
                    words.insert(at, f"e{rng.randint(0, 10)}")
            rows.append((len(rows), " ".join(words)))
    got = Counter(tuple(r) for r in jaccard.classify(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == jaccard_truth(rows)


def test_keep_one_keeps_columns(spark, corpus):
    frame = table(spark, corpus)
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 100 in ids and 101 not in ids and 300 not in ids and 2 in ids and None in ids


def test_repeated_ids_in_keep_one(spark):
    """Exact repeats under one id are one row; rows without an id and unlike texts under one id stay."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b + " more words at the end here"), (None, a), (4, None), (4, None)]
    assert Counter((r.doc_id, r.text) for r in jaccard.keep_one(table(spark, rows)).collect()) == Counter([(1, a), (3, b), (3, b + " more words at the end here"), (None, a), (4, None)])


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 180)] + [(5, 5)]
    from quarrymill.operators.components import connected_components

    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 180)}


# ---- 4: suffix-array dedup ---------------------------------------------------------------------------


def dedup_truth(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 99):
            at = (-(2**63) if i is None else i, k)
            first[b[k : k + 100]] = min(first.get(b[k : k + 100], at), at)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if first[b[k : k + 100]] < (-(2**63) if i is None else i, k):
                gone[k : k + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [1000, 3])
def test_suffix_dedup_against_brute_force(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = Counter(tuple(r) for r in suffixes.dedup(table(spark, corpus)).collect())
    assert got == dedup_truth(corpus)
    assert suffixes.dedup(table(spark, [])).count() == 0


def test_suffix_dedup_random_pastes(spark):
    rng = random.Random(6)
    stock = ["".join(rng.choice("ab é") for _ in range(rng.randint(90, 130))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(stock)[rng.randint(0, 9) :] if rng.random() < 0.6 else "".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    assert Counter(tuple(r) for r in suffixes.dedup(table(spark, rows)).collect()) == dedup_truth(rows)


@pytest.mark.parametrize("hot", [1000, 2])
def test_suffix_dedup_rows_that_share_an_id(spark, monkeypatch, hot):
    """Two texts with one id begin alike; an earlier row holds a part of that beginning only."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(5)
    p = prose(rng, 60)
    for i in (5, None):
        rows = [(1 if i else None, prose(rng, 20) + p[40:300] + prose(rng, 20)), (i, p + "x" + prose(rng, 30)), (i, p + "y" + prose(rng, 30)), (i, p + "z"), (i, p + "z"), (7, prose(rng, 9) + p[10:])]
        assert Counter(tuple(r) for r in suffixes.dedup(table(spark, rows)).collect()) == dedup_truth(rows)


def test_keep_rest_keeps_columns_and_text(spark, corpus):
    frame = table(spark, corpus)
    out = suffixes.keep_rest(frame)
    assert out.schema == frame.schema or out.columns == frame.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] is None and got[500] == "" and got[3] == "One Two"


def test_multikey_quicksort_finds_equal_strings():
    rng = np.random.default_rng(3)
    pool = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = np.concatenate([rng.integers(0, 3900, 500), [5, 5, 900]])
    order, equal = suffixes.multikey_quicksort(pool, starts, np.zeros(len(starts), np.int64))
    found = defaultdict(set)
    for o, e in zip(order.tolist(), equal.tolist(), strict=True):
        found[e].add(o)
    want = defaultdict(set)
    for k, s in enumerate(starts.tolist()):
        want[pool[s : s + 100].tobytes()].add(k)
    assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


# ---- 5: decontamination ------------------------------------------------------------------------------


def words5(t):
    return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if x]


def contamination_truth(rows, items):
    out = []
    for i, t in rows:
        w, hit, names = words5(t), set(), set()
        for item, body in items:
            b = words5(body)
            size = min(10, len(b))
            for k in range(len(b) - size + 1) if b else ():
                for at in range(len(w) - size + 1):
                    if w[at : at + size] == b[k : k + size]:
                        hit |= set(range(at, at + size))
                        if item is not None:
                            names.add(str(item))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontaminate_against_brute_force(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, rng.randint(1, 30))) for k in range(12)] + [(50, "One two"), (51, ""), (52, None), (None, "salt road"), (2, "again the same id twice"), (53, "one two")]
    rows = [(1, None), (2, ""), (3, "ONE, two; one two"), (4, "salt-road salt")]
    for k in range(40):
        body = rng.choice(items[:12])[1].split()
        rows.append((10 + k, prose(rng, rng.randint(0, 40)) + " " + " ".join(body[rng.randint(0, 5) :]) + " " + prose(rng, 5)))
    rows += [rows[-1], (None, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination_truth(rows, items)
    got = decontaminate.report(table(spark, rows), bench)
    assert Counter(tuple(r) for r in got.collect()) == want
    blocks = decontaminate.exact_matches(table(spark, rows), bench, block_words=30)
    assert Counter((r.doc_id, r.n) for r in blocks.select("doc_id", decontaminate.n_hit().alias("n")).collect()) == Counter((k[0], k[2]) for k in want.elements())
    assert decontaminate.report(table(spark, []), bench).count() == 0
    assert decontaminate.report(table(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def test_blocks_of_a_benchmark_share_one_index(spark):
    """Many blocks over a source that is dealt anew between jobs: rows of different documents are never merged."""
    rng = random.Random(10)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(20)]
    rows = [(i, (prose(rng, 30) + " " + items[i % 20][1] if i % 3 else prose(rng, 30))) for i in range(200)]
    docs = table(spark, rows).orderBy(F.rand()).repartition(7)  # another order each time it is read
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.exact_matches(docs, bench, block_words=40).select("doc_id", "items", decontaminate.n_hit().alias("n")).collect()
    assert {(r.doc_id, tuple(r["items"]), r.n) for r in got} == {(i, (str(i % 20),) if i % 3 else (), 12 if i % 3 else 0) for i in range(200)} and len(got) == 200


def test_windows_are_looked_up_by_the_segments_terms():
    """Cost follows the segment: of a large benchmark only windows under a term of the segment are touched."""
    rng = random.Random(3)
    words = [f"b{rng.randint(0, 10**9)}" for _ in range(50_000)]
    w = decontaminate.Windows([(str(k), " ".join(words[k * 50 : k * 50 + 50])) for k in range(1000)], 10)
    own, _ = decontaminate.term_hashes(pa.array([" ".join(words[100:115]) + " and some other words"]))
    assert 0 < len(w.under(np.unique(own))) <= 30 < len(w.item) == 41_000


def test_span_hash_structure_is_not_in_word_hashes(spark):
    """Thue-Morse strings over two letters: equal sums of powers modulo 2 ** 64, but different words."""
    a = "a"
    for _ in range(12):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    for n in (1024, 2048, 4096):
        pair = pa.array([a[:n], b[:n]])
        assert decontaminate.term_hashes(pair)[0][0] != decontaminate.term_hashes(pair)[0][1]
        assert lm.tokens(pair)[0][-1][0] != lm.tokens(pair)[0][-1][2]
        x, y = jaccard.shingle_sets(pair)
        assert x[0] != y[0]
    rows = [(1, a), (2, b), (3, a)]
    assert {(r.doc_id, r.component_id) for r in jaccard.classify(table(spark, rows)).collect()} == {(1, 1), (2, 2), (3, 1)}
    bench = spark.createDataFrame([(1, b)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.report(table(spark, rows), bench).where("contaminated").collect()} == {2}


def test_proximity_matches(spark):
    twice = spark.createDataFrame([(1, "the lamp the mill")], "item_id long, text string")
    found = decontaminate.proximity_matches(table(spark, [(1, "lamp the mill"), (2, "mill the the lamp")]), twice, slop=5).collect()
    assert {r.doc_id: bool(r.spans) for r in found} == {1: False, 2: True}
    bench = spark.createDataFrame([(1, "copper lamp mill")], "item_id long, text string")
    docs = table(spark, [(1, "a mill near the copper lamp"), (2, "copper lamp " + "x " * 20 + "mill"), (3, "lamp mill")])
    got = {r.doc_id: len(r.spans) for r in decontaminate.proximity_matches(docs, bench, slop=5).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


# ---- 6: language model -------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_against_brute_force(spark, corpus, order):
    frame = table(spark, corpus)
    got = lm.train_and_score(frame, order).collect()
    token = lambda t: [w for w in re.split("[ \t-\r]+", lower(t)) if w] + [1]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = {order: Counter()}
    uni = Counter()
    for i, t in corpus:
        if not held(i):
            w = [0] * (order - 1) + token(t)
            counts[order].update(tuple(w[k : k + order]) for k in range(len(w) - order + 1))
            uni.update(token(t))
    for k in range(order - 1, 0, -1):  # distinct words before each shorter gram
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    total, v = sum(uni.values()), len(uni)
    d = {k: lm._discounts([sum(c == j for c in counts[k].values()) for j in (1, 2, 3, 4)]) for k in counts}
    context, kinds = defaultdict(Counter), defaultdict(Counter)
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            context[k][g[:-1]] += c
            kinds[k, g[:-1]][min(c, 3)] += 1
    low_gamma = sum(d[1][min(c, 3) - 1] for c in counts[1].values()) / len(counts[2])

    def p(g):
        k = len(g)
        if k == 1:
            n = counts[1][g]
            return (n - d[1][min(n, 3) - 1] if n else 0) / len(counts[2]) + low_gamma / (v + 1)
        all_ = context[k][g[:-1]]
        if not all_:
            return p(g[1:])
        c = counts[k][g]
        return (c - d[k][min(c, 3) - 1] if c else 0) / all_ + sum(d[k][j - 1] * n for j, n in kinds[k, g[:-1]].items()) / all_ * p(g[1:])

    for start in ([0] * (order - 1), ["the"] + [0] * (order - 2), ["of"] * (order - 1)):
        assert abs(sum(p((*start, w)) for w in uni) + p((*start, "unseen")) - 1) < 1e-9
    want = Counter()
    for i, t in corpus:
        w = [0] * (order - 1) + token(t)
        s = sum(math.log10(p(tuple(w[k : k + order]))) for k in range(len(w) - order + 1))
        base = sum(math.log10((uni[x] + 0.1) / (total + 0.1 * (v + 1))) for x in token(t))
        want[i, held(i), len(token(t)), sum(uni[x] > 0 for x in token(t)), total, round(base, 6), round(s, 6)] += 1
    assert Counter((*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_lm_of_nothing(spark):
    assert lm.train_and_score(table(spark, [])).count() == 0
    one = lm.score(table(spark, [(1, "a b")]), lm.train(table(spark, []))).first()
    assert one.score == pytest.approx(0) and one.train_tokens == 0


# ---- 7: quality --------------------------------------------------------------------------------------


def test_marginals_against_enumeration():
    rng = np.random.default_rng(7)
    sizes = [1, 3, 5]
    score, transition = rng.normal(size=9), rng.normal(size=(2, 2))
    first = np.concatenate([[0], np.cumsum(sizes)])
    got, _ = quality.marginals(score, first, transition)
    for k, n in enumerate(sizes):
        weight, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(score[first[k] + t] * y[t] for t in range(n)) + sum(transition[y[t], y[t + 1]] for t in range(n - 1)))
            weight += w
            good += w * np.array(y)
        assert np.allclose(got[first[k] : first[k + 1]], good / weight)


def test_quality_on_held_out_rows(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 5 and sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)


def test_quality_edge_cases(spark, corpus):
    labels = spark.createDataFrame([(3, 1), (400, 0), (6, None), (None, 1), (3, 1), (10, 1), (401, 0)], "doc_id long, quality int")
    got = quality.classify(table(spark, corpus), labels).collect()
    assert len(got) == len(corpus) and all(0 <= r.score <= 1 for r in got)
    none = quality.classify(table(spark, corpus), labels.limit(0)).collect()
    assert all(r.score == pytest.approx(0.5) and r.predicted == 0 for r in none)
    assert quality.classify(table(spark, []), labels).count() == 0


# ---- 8: WARC -----------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "page " * 50
    rows = [(5, "http://a/", long), (3, "http://b/\r\nX", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "n", long), (6, "u", ""), (7, "ü", "é" * 60), (8, "v", "é" * 60), (7, "ü", "é" * 60), (10, "w", "z" * 3_000_000)]
    rows += [(1, "u", "short")] * 2
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, shard int, digest string")
    url = f"file://{tmp_path}/a"
    back = warc.round_trip(pages, url, shards=5, roll_bytes=700).collect()
    assert Counter((r.page_id, r.payload_digest) for r in back) == Counter((i, hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in back}
    assert {(3, "response", None), (5, "revisit", 3), (9, "revisit", 3), (None, "revisit", 3), (1, "response", None), (2, "response", None), (8, "revisit", 7)} <= kinds
    assert sum(r.record_type == "response" for r in back if r.page_id == 7) == 1
    assert all(r.payload == h for r in back for i, _, h in rows if r.page_id == i and r.record_type == "response" and h)
    # every record has an id of its own, and revisits name the record of the response
    ids = {r.record_id: r for r in back}
    assert len(ids) == len(back)
    assert all(ids[r.refers_to_record].page_id == r.refers_to and ids[r.refers_to_record].record_type == "response" for r in back if r.record_type == "revisit")
    # a reader needs the URL alone
    assert warc.read(spark, url).count() == len(rows)
    files = lambda p: {f.name: f.read_bytes() for f in p.iterdir() if not f.name.startswith(("_", "."))}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "_temporary.dead.shard-000000-00000.warc.gz").write_bytes(b"left by a dead attempt")
    warc.write(pages.repartition(3), f"file://{tmp_path}/b", shards=5, roll_bytes=700)
    assert files(tmp_path / "a") == files(tmp_path / "b") and len(files(tmp_path / "a")) > 6
    assert not [f for f in (tmp_path / "b").iterdir() if "_temporary" in f.name]
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/c").count() == 0


def test_warc_refuses_damaged_and_unfinished_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 30) for i in range(20)], "page_id long, url string, html string")
    url = f"file://{tmp_path}/a"
    warc.write(pages, url, shards=3)
    one = next(f for f in (tmp_path / "a").iterdir() if f.name.endswith(".gz"))
    one.write_bytes(one.read_bytes()[:-1] + b"!")
    with pytest.raises(Exception, match="not what its manifest says"):
        warc.read(spark, url).collect()
    (tmp_path / "a" / warc.ARCHIVE).unlink()
    with pytest.raises(FileNotFoundError):
        warc.read(spark, url)


def test_warc_shards_have_a_task_each(spark, tmp_path):
    """Rows of one id, or without an id, are cut by digest; no task reads or writes two shards."""
    rows = [(None if i % 3 else 7, f"u{i}", f"page {i} " * 40) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    done = warc.write(pages, f"file://{tmp_path}/a", shards=9)
    assert len(done["shards"]) >= 7 and done["records"] == 600
    back = warc.read(spark, f"file://{tmp_path}/a")
    assert back.rdd.getNumPartitions() == len(done["shards"])
    sizes = [r["count"] for r in back.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == len(done["shards"]) and max(sizes) < 200


# ---- 9: chat -----------------------------------------------------------------------------------------


def rendered(source, **variables):
    return "".join(t for t, _ in chat.compile_template(source)(variables))


def test_template_language():
    assert rendered("a{# no #}{{ 1 + 2 }}{{ 'x' + y|upper }}", y="b") == "a3xB"
    assert rendered("{% for m in ms %}{% if loop.first %}<{% elif m.k == 'z' %}Z{% else %}-{% endif %}{{ m['k'] }}{% endfor %}", ms=[{"k": "a"}, {"k": "z"}, {"k": "q"}]) == "<aZz-q"
    assert rendered("{{ 'y' if n and not f else 'n' }}", n=1, f=False) == "y"
    assert chat.fold(chat.parse("{% if 'a' == 'a' %}{{ 'b' + 'c' }}d{% endif %}"), {}) == ("block", (("text", "bcd"),))
    assert list(chat.compile_template("a{% generation %}b{% endgeneration %}")({})) == [("a", False), ("b", True)]
    assert rendered("{{ x.__class__ }}{{ s.upper }}", x=chat, s="t") == ""  # no attributes
    assert rendered("a  {%- if 1 -%}  b  {%- endif -%}  c") == "abc" and rendered("{{- 'x' -}}  y") == "xy"
    assert rendered("{% set n = 2 * 3 - 1 %}{{ n }}{{ n // 2 }}{{ n % 2 }}{{ -n }}{{ 7 / 2 }}{{ 'a' ~ 1 }}") == "521-53.5a1"
    assert rendered("{% for m in ms %}{{ m }}{% if not loop.last %}, {% endif %}{% set q = m %}{% endfor %}{{ q }}", ms=iter("abc")) == "a, b, c"
    assert rendered("{{ 1 < 2 }}{{ 'b' >= 'a' }}{{ 1 < 'a' }}{{ 'a' in none }}{{ 'a' not in 'bc' }}{{ 1 in 'a1' }}") == "truetruefalsefalsetruefalse"
    assert rendered("{{ a is defined }}{{ m.k is defined }}{{ m.z is not defined }}{{ m.k is none }}{{ m.s is string }}{{ 3 is number }}", m={"k": None, "s": ""}) == "falsetruetruetruetruetrue"
    assert rendered("{{ m|tojson }}{{ l[1] }}{{ l|length }}{{ x|default('d') }}{{ l[9] }}", m={"a": ["é"]}, l=["p", "q"]) == '{"a": ["é"]}q2d'


@pytest.mark.parametrize(
    "bad",
    ["{% for x %}{% endfor %}", "{% if a %}", "{{ a. }}", "{{ f() }}", "{% import os %}", "{{ a|nope }}", "{{ 1 1 }}", "{{ messages[0]['role'] }}", "{{ messages[0].role == 'system' }}", "{{ messages|length }}", "{% if messages %}{% endif %}"]
    + ["{{ a[1:] }}", "{% for m in messages[1:] %}{% endfor %}", "{{ loop.length }}", "{{ a is odd }}", "{{ 1 is defined }}", "{% set messages = 1 %}", "{% set a %}", "{% macro m() %}{% endmacro %}", "{{ raise_exception('x') }}", "{{ a|default }}", "{{ a|upper('x') }}", "{% set x = messages %}"],
)
def test_what_the_language_lacks_is_an_error_when_compiled(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["\\", "#", "###", "</turn>", "h", "t", "\n", " ", ":"]) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and "###" not in chat.escape(text) and "</turn>" not in chat.escape(text)


def test_chat_edge_cases(spark):
    rows = [(1, 1, "assistant", "b ### x"), (1, 0, "user", None), (1, 1, "assistant", "b ### x"), (2, None, None, "\\"), (None, 0, "a:b", "</turn>\n### user: y"), (3, 0, "system", "")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.format_conversations(frame).collect()}
    sha = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha([("user", ""), ("assistant", "b ### x"), ("assistant", "b ### x")])
    assert got[1].loss_sha256 == hashlib.sha256(b"b ### xb ### x").hexdigest() and got[1].loss_chars == 14
    assert got[2].turns_sha256 == sha([("", "\\")]) and got[None].turns_sha256 == sha([("a:b", "</turn>\n### user: y")])
    full = {r.conv_id: r for r in chat.render_conversations(frame).collect()}
    assert len(full[1].formatted) == got[1].formatted_chars
    assert "".join(chat.unescape(full[1].formatted[s.start : s.end]) for s in full[1].loss_spans) == "b ### xb ### x"
    assert chat.format_conversations(frame.limit(0)).count() == 0


# ---- 10: licences ------------------------------------------------------------------------------------


def test_licences(spark):
    rows = [(1, None), (2, ""), (3, "text\nReleased under the MIT License.\nmore"), (4, "RELEASED  under, the mit license!"), (5, "Released under the BSD license"), (6, "one"), (7, "nothing to see here at all"), (8, "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License."), (3, "Released under the MIT License.")]
    got = licences.scan(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.licences) for r in got}
    assert {(1, ""), (2, ""), (3, "MIT"), (4, "MIT"), (6, ""), (7, ""), (8, "GPL-3.0,MIT")} <= by
    assert licences.scan(table(spark, [])).count() == 0
    assert not [c for c in ("Python", "Pandas", "Arrow") if c in licences.scan(table(spark, rows))._jdf.queryExecution().toString()]


def licence_text(name):
    return max((b for n, b in licences.TEMPLATES if n == name), key=len)


def test_licence_texts_inside_documents(spark):
    """Real bodies: wrapped, in several paragraphs, behind a title and a copyright line, with code after them."""
    import textwrap

    wrap = lambda t: "\n".join(textwrap.wrap(t, 72))
    mit = licence_text("MIT").replace("The above copyright", "\n\nThe above copyright").replace("THE SOFTWARE IS PROVIDED", "\n\nTHE SOFTWARE IS PROVIDED")
    mit = "\n\n".join(wrap(p) for p in mit.split("\n\n"))
    bsd = licence_text("BSD-3-Clause").replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n\n3. ").replace("THIS SOFTWARE IS", "\n\nTHIS SOFTWARE IS")
    code = "\n\n".join(f"def f{i}(x):\n    return x + {i}" for i in range(9))
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + mit + "\n\n" + code),
        (2, "Copyright 2001 The Authors. All rights reserved.\n\n" + bsd),
        (3, wrap(licence_text("Apache-2.0")) + "\n\nimport os"),
        (4, "# " + wrap(licence_text("GPL-3.0")).replace("\n", "\n# ")),
        (5, code),
        (6, "title\n\n" + wrap(licence_text("Zlib")) + "\n\n" + wrap(licence_text("ISC"))),
    ]
    got = {r.doc_id: r.licences for r in licences.scan(table(spark, rows)).collect()}
    assert got[1] == "MIT" and got[2] == "BSD-3-Clause" and got[3] == "Apache-2.0" and "GPL" in got[4] and got[5] == "" and got[6] == "ISC,Zlib"


def test_markers_lose_no_match():
    """Any unit at the threshold holds a marker, whichever bigrams it lacks."""
    sets = [licences._template_bigrams(b) for _, b in licences.TEMPLATES]
    low = licences.THRESHOLD / (2 - licences.THRESHOLD)
    chosen = set(licences.markers(sets, low))
    for s in sets:
        covered = [b for b in s if chosen & set(b.split())]
        assert len(covered) > len(s) * (1 - low)
    assert not chosen & {"the", "and", "of", "to", "in", "a", "is", "or"}
    pattern = re.compile(licences.any_of(sorted(chosen)))
    assert all(pattern.fullmatch(w) for w in chosen) and not any(pattern.fullmatch(w[:-1]) for w in chosen if w[:-1] not in chosen)


def test_dice_against_brute_force(spark):
    rng = random.Random(4)
    shelf = [(n, b) for n, b in licences.TEMPLATES]
    rows = []
    for i in range(80):
        w = rng.choice(shelf)[1].split()
        for _ in range(rng.randint(0, 3 if len(w) < 30 else len(w) // 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    grams = lambda t: set(itertools.pairwise(re.sub("[^a-z0-9]+", " ", t.lower()).split()))
    got = {r.doc_id: r for r in licences.scan(table(spark, rows)).collect()}
    for i, t in rows:
        best = min(((-2 * len(grams(t) & grams(b)) / (len(grams(t)) + len(grams(b)) or 1), n) for n, b in shelf), default=(0, ""))
        assert (got[i].licence, got[i].dice) == ((best[1], round(-best[0], 6)) if -best[0] >= 0.8 else (None, None))
