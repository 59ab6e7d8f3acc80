"""SentencePiece encoding and decoding by a max-plus parallel scan.

The best segmentation of a text maximises the sum of piece scores: a path in a lattice of character positions.
The texts of a slice are cut into chunks of `CHUNK` characters wherever that falls. A chunk's transfer matrix T[a, b] is
the best score from "a characters already taken by a piece of the chunk before" to "a piece reaches b characters into
the next chunk"; matrices are combined associatively by a max-plus prefix scan, which gives every chunk the
scores of its entry states, and then each chunk is backtraced on its own from all its exit states. Scores are whole
multiples of 2 ** -16, so sums are the same in any order and the path doesn't depend on where chunks end.

Positions no piece can cross (a space marker after another character, a character in no piece, a text's end) make a
matrix one of few numbers: what lies before the first such cut of a chunk depends on the entry state only, what lies
behind the last on the exit state only, and the stretches between cuts inside a chunk on neither. So the matrix is
the outer sum of both ends and the score of the middle, and equal stretches of the middle are solved once (a stretch
is looked up by hash and compared character by character). A chunk without a cut has its matrix computed in full. All
chunks or stretches advance in lockstep, as array operations.

At each end position the longest of equally good last pieces wins; a character in no piece costs the least score
less 10 and becomes its UTF-8 bytes; a space is put before a text, as the unigram model of the format has it. A
vocabulary file of type BPE has merge ranks as scores; its best path is by those scores and isn't the merge order of a
BPE encoder. Decoding an encoded text always gives the text back; a literal U+2581 is encoded as bytes, so that it
isn't read as a space.

Cases: null and empty texts have no pieces and decode to the empty text; repeated rows are encoded each; texts
of any length work, in memory that follows the longest single text. Other columns are ignored or kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import _BASE_INV, arrow_rows, mix, powers, slices, spread, utf8, word_hash

CHUNK = 1024
MARK, LITERAL_MARK = 0x2581, 0x110000
UNKNOWN_PENALTY = 10.0
MODEL = "piece_bpe_32k.model"
_GROUP_CHARS = 1 << 17
_CACHE_ENTRIES = 1 << 19


def default_model() -> str:
    """Path of the production vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Running sums for hashes of spans of code points."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(0x51ED27)) * powers(len(codes)), out=out[1:])
    return out


class Vocabulary:
    """Pieces, scores and bytes of a SentencePiece model, with a hash table for each piece length."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and names[i]]
        self.byte_id = np.full(256, sp.unk_id())
        raw = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                raw[i] = bytes([int(names[i][3:-1], 16)])
                self.byte_id[raw[i][0]] = i
        for i in normal:
            raw[i] = names[i].replace("▁", " ").encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_first = np.cumsum(self.raw_size) - self.raw_size
        scores = np.round(np.array([sp.get_score(i) for i in range(n)]) * 65536) / 65536
        self.longest = max(len(names[i]) for i in normal)
        self.unknown = float(scores[normal].min()) - UNKNOWN_PENALTY
        self.alphabet = np.array(sorted({ord(c) for i in normal for c in names[i]}), np.uint32)
        self.marks_cut = not any(a != "▁" and b == "▁" for i in normal for a, b in zip(names[i], names[i][1:], strict=False))
        self.tables = [None] + [self._table([i for i in normal if len(names[i]) == size], names, scores) for size in range(1, self.longest + 1)]
        self.chunk = max(CHUNK, self.longest)
        self.matrices = 0  # transfer matrices combined so far
        self._forget()

    def _forget(self) -> None:
        """Hashes of solved stretches, sorted; where their ids stand in `pool` and their characters in `text`; their scores."""
        self.seen, self.seen_at, self.seen_score = np.zeros(0, np.uint64), np.zeros((0, 4), np.int64), np.zeros(0)
        self.pool, self.text = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    @staticmethod
    def _table(ids, names, scores):
        """(shift, keys, ids, scores, probes): open addressing on the top bits of the hash."""
        if not ids:
            return None
        codes = np.frombuffer("".join(names[i] for i in ids).encode("utf-32-le"), np.uint32)
        size = len(names[ids[0]])
        prefix = _hashes(codes)
        starts = np.arange(len(ids)) * size
        keys = (prefix[starts + size] - prefix[starts]) * powers(len(codes), _BASE_INV)[starts]
        bits = max(4, int(len(ids) * 8 - 1).bit_length())
        table, slot_ids, probes = np.zeros((1 << bits) + 64, np.uint64), np.full((1 << bits) + 64, -1), 1
        for key, i in zip(keys.tolist(), ids, strict=True):
            at = (key * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - bits)
            step = 1
            while slot_ids[at] >= 0:
                at, step = at + 1, step + 1
            table[at], slot_ids[at], probes = key, i, max(probes, step)
        return np.uint64(64 - bits), table, slot_ids, np.where(slot_ids >= 0, scores[slot_ids], -np.inf), probes

    def matches(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece of every length at every position (columns 1..longest; -inf for none).

        ends: for each position, where its stretch ends. An unknown character has id -1."""
        n = len(codes)
        prefix, back = _hashes(codes), powers(max(n, 1), _BASE_INV)
        score, ids = np.full((self.longest + 1, n), -np.inf), np.full((self.longest + 1, n), -1, np.int32)
        for size in range(1, self.longest + 1):
            if self.tables[size] is None or n < size:
                continue
            shift, keys, slot_ids, slot_scores, probes = self.tables[size]
            at = np.flatnonzero(np.arange(n - size + 1) + size <= ends[: n - size + 1])
            h = (prefix[at + size] - prefix[at]) * back[at]
            slot = ((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
            for step in range(probes):
                hit = keys[slot + step] == h
                where = at[hit]
                score[size, where] = slot_scores[slot[hit] + step]
                ids[size, where] = slot_ids[slot[hit] + step]
        ids[1, ~np.isfinite(score[1])] = -1
        score[1, ~np.isfinite(score[1])] = self.unknown
        return score, ids

    # ---- paths ----------------------------------------------------------------------------------

    def short_paths(self, score: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece lengths at piece starts (0 elsewhere) for stretches that stand alone, in lockstep, and the paths' scores."""
        taken = np.zeros(score.shape[1], np.int8)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        m, top = len(starts), int(sizes.max())
        best = np.full((top + 1, m), -np.inf)
        best[0] = 0
        back = np.zeros((top + 1, m), np.int8)
        for e in range(1, top + 1):
            live = int(np.searchsorted(-sizes, -e, side="right"))
            at, most, via = starts[:live] + e, np.full(live, -np.inf), np.zeros(live, np.int8)
            for size in range(min(self.longest, e), 0, -1):
                value = best[e - size, :live] + score[size, at - size]
                better = value > most
                most[better] = value[better]
                via[better] = size
            best[e, :live], back[e, :live] = most, via
        total = np.empty(m)
        total[order] = best[sizes, np.arange(m)]
        left = sizes.copy()
        rows = np.arange(m)
        while len(rows):
            size = back[left[rows], rows]
            left[rows] -= size
            taken[starts[rows] + left[rows]] = size
            rows = rows[left[rows] > 0]
        return taken, total

    def _advance(self, score: np.ndarray, first: np.ndarray, sizes: np.ndarray, entry: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
        """Best scores of the nodes of parts, from the scores of their entry nodes: entry and the result are (part, way in, node).

        Parts are sorted by size, longest first. back takes the length of the last piece of each node (0: it came from the part before)."""
        L, top = self.longest, int(sizes.max())
        best = np.full((*entry.shape[:2], top + L), -np.inf)
        best[:, :, :L] = entry
        for s in range(top):
            live = int(np.searchsorted(-sizes, -s, side="left"))
            for size in range(1, L + 1):
                piece = score[size, first[:live] + s]
                if not np.isfinite(piece).any():
                    continue
                value, node = best[:live, :, s] + piece[:, None], best[:live, :, s + size]
                better = value > node
                np.copyto(node, value, where=better)
                if back is not None:
                    np.copyto(back[:live, s + size], size, where=better[:, 0])
        return best

    def _groups(self, sizes: np.ndarray):
        """Parts by size, longest first, some at a time."""
        order, a = np.argsort(-sizes, kind="stable"), 0
        while a < len(order):
            b = a + max(1, (1 << 20) // (int(sizes[order[a]]) + self.longest))
            yield order[a:b]
            a = b

    def _part_scores(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores and ids of the pieces that start in parts (and may reach beyond them, but not beyond `stops`), and each part's first column."""
        reach = np.minimum(sizes + self.longest - 1, stops - starts)
        ends = np.cumsum(reach)
        score, ids = self.matches(codes[spread(starts, reach)], np.repeat(ends, reach))
        return score, ids, ends - reach

    def across(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces (place, length, id) of the stretches that cross the ends of chunks, by the scan over all chunks' matrices.

        middle: each chunk's score of the stretches that lie inside it."""
        L, K = self.longest, self.chunk
        C = len(middle)
        # A stretch's parts: one for each chunk it stands in.
        n = (starts + sizes - 1) // K - starts // K + 1
        of = np.repeat(np.arange(len(starts)), n)
        nth = spread(np.zeros(len(starts), np.int64), n)
        chunk = starts[of] // K + nth
        head = np.maximum(starts[of], chunk * K)
        size = np.minimum(starts[of] + sizes[of], (chunk + 1) * K) - head
        stop = starts[of] + sizes[of]
        enters, leaves = nth > 0, nth < n[of] - 1
        none = np.full(L, -np.inf)
        none[0] = 0
        ins, outs = np.tile(none, (C, 1)), np.tile(none, (C, 1))
        full: dict[int, np.ndarray] = {}
        for g in self._groups(size):
            score, _, first = self._part_scores(codes, head[g], size[g], stop[g])
            entry = np.full((len(g), L, L), -np.inf)
            entry[:, np.arange(L), np.arange(L)] = 0
            best = self._advance(score, first, size[g], entry)
            exits = np.where(leaves[g], L, 1)
            for k, p in enumerate(g.tolist()):
                t = best[k, :, size[p] : size[p] + exits[k]]
                if enters[p] and leaves[p]:
                    full[int(chunk[p])] = t
                elif leaves[p]:
                    outs[chunk[p]] = t[0]
                else:
                    ins[chunk[p]] = t[:, 0]
        matrices = ins[:, :, None] + middle[:, None, None] + outs[:, None, :]
        for c, t in full.items():
            matrices[c] = t
        self.matrices += C
        prefix = max_plus_scan(matrices)
        entries = np.tile(none, (C, 1))
        entries[1:] = prefix[:-1, 0, :]
        # Every chunk from every exit, independently; then exits are chosen from the last part of a stretch to its first.
        came = np.zeros((len(of), L), np.int64)
        held = []
        for g in self._groups(size):
            score, ids, first = self._part_scores(codes, head[g], size[g], stop[g])
            back = np.zeros((len(g), int(size[g].max()) + L), np.int8)
            self._advance(score, first, size[g], np.where(enters[g, None], entries[chunk[g]], none)[:, None, :], back)
            at = size[g, None] + np.where(leaves[g, None], np.arange(L), 0)
            row = np.arange(len(g))[:, None]
            while (step := back[row, at]).any():
                at -= step
            came[g] = at
            held.append((g, back, ids, first))
        chosen = np.zeros(len(of), np.int64)
        for p in range(len(of) - 2, -1, -1):
            if leaves[p]:
                chosen[p] = came[p + 1, chosen[p + 1]]
        found = []
        for g, back, ids, first in held:
            node, live = size[g] + chosen[g], np.arange(len(g))
            while len(live):
                step = back[live, node[live]].astype(np.int64)
                live, step = live[step > 0], step[step > 0]
                node[live] -= step
                found.append((head[g[live]] + node[live], step, ids[step, first[live] + node[live]]))
        place, length, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(place)
        return place[by], length[by], ids[by]

    # ---- stretches and texts --------------------------------------------------------------------

    def _spell(self, codes: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has: one, or the bytes of the character (codes) of an unknown one."""
        code = np.where(codes == LITERAL_MARK, MARK, codes).astype(np.int64)
        width = np.where(found >= 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        piece = np.repeat(np.arange(len(codes)), width)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(width) - width, width)
        c, w = code[piece], width[piece]
        later = 0x80 | ((c >> (6 * np.maximum(w - 1 - nth, 0))) & 0x3F)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[w] | (c >> (6 * (w - 1)))
        out = np.where(found[piece] >= 0, found[piece], self.byte_id[np.where(nth == 0, lead, later) & 0xFF])
        return out.astype(np.int32), width

    def _solve(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of stretches inside chunks, one after another, their numbers and the stretches' scores."""
        all_ids, counts, scores = [], np.zeros(len(starts), np.int64), np.zeros(len(starts))
        ends = np.cumsum(sizes)
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _GROUP_CHARS, side="right")))
            size = sizes[a:b]
            own = codes[spread(starts[a:b], size)]
            stop = np.cumsum(size)
            first = stop - size
            score, ids = self.matches(own, np.repeat(stop, size))
            taken, scores[a:b] = self.short_paths(score, first, size)
            at = np.flatnonzero(taken)
            out, width = self._spell(own[at], ids[taken[at], at])
            all_ids.append(out)
            run = np.concatenate([[0], np.cumsum(width)])
            edges = run[np.searchsorted(at, np.concatenate([first, stop[-1:]]))]
            counts[a:b] = np.diff(edges)
            a = b
        return np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32), counts, scores

    def _remembered(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, number) of the ids of stretches in `pool`, and scores; those not yet seen are solved."""
        raw = codes.view(np.uint8)
        h = word_hash(raw, 4 * starts, 4 * (starts + sizes))
        unique, sample, which = np.unique(h, return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.seen, unique), max(len(self.seen) - 1, 0))
        fresh = np.flatnonzero(self.seen[spot] != unique) if len(self.seen) else np.arange(len(unique))
        if len(self.seen) + len(fresh) > _CACHE_ENTRIES:
            self._forget()
            fresh = np.arange(len(unique))
        if len(fresh):
            at, size = starts[sample[fresh]], sizes[sample[fresh]]
            ids, counts, scores = self._solve(codes, at, size)
            place = np.stack([np.cumsum(counts) - counts + len(self.pool), counts, np.cumsum(size) - size + len(self.text), size], axis=1)
            into = np.searchsorted(self.seen, unique[fresh])
            self.seen, self.seen_at, self.seen_score = np.insert(self.seen, into, unique[fresh]), np.insert(self.seen_at, into, place, axis=0), np.insert(self.seen_score, into, scores)
            self.pool, self.text = np.concatenate([self.pool, ids]), np.concatenate([self.text, codes[spread(at, size)]])
        entry = np.searchsorted(self.seen, unique)[which]
        place, score = self.seen_at[entry], self.seen_score[entry]
        # A hash only finds a stretch; its characters decide.
        wrong = place[:, 3] != sizes
        like = np.flatnonzero(~wrong)
        differ = codes[spread(starts[like], sizes[like])] != self.text[spread(place[like, 2], sizes[like])]
        if differ.any():
            wrong[like] = np.add.reduceat(differ.astype(np.int64), np.cumsum(sizes[like]) - sizes[like]) > 0
        if wrong.any():
            ids, counts, score[wrong] = self._solve(codes, starts[wrong], sizes[wrong])
            place = place.copy()
            place[wrong, 0], place[wrong, 1] = np.cumsum(counts) - counts + len(self.pool), counts
            self.pool = np.concatenate([self.pool, ids])
        return place[:, 0], place[:, 1], score

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's first (one more entry than texts)."""
        data, offsets = utf8(column)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        head = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        codes = np.where(codes == MARK, LITERAL_MARK, np.where(codes == 0x20, MARK, codes)).astype(np.uint32)
        full = np.flatnonzero(np.diff(head))
        codes = np.insert(codes, head[full], MARK)
        head = head + np.concatenate([[0], np.cumsum(np.diff(head) > 0)])
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(codes) + 1, bool)
        cut[head] = True
        lone = self.alphabet[np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)] != codes
        cut[:-1] |= lone
        cut[1:] |= lone
        if self.marks_cut:
            cut[1:-1] |= (codes[1:] == MARK) & (codes[:-1] != MARK)
        cut[-1] = False
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(codes)))
        chunks = -(-len(codes) // self.chunk)
        inside = starts // self.chunk == (starts + sizes - 1) // self.chunk
        place, count, score = self._remembered(codes, starts[inside], sizes[inside]) if inside.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        where, number = np.zeros((2, len(starts)), np.int64)
        where[inside], number[inside] = place, count
        pool = self.pool
        if not inside.all():
            middle = np.bincount(starts[inside] // self.chunk, weights=score, minlength=chunks)
            crossing = np.flatnonzero(~inside)
            at, _, found = self.across(codes, starts[crossing], sizes[crossing], middle)
            ids, width = self._spell(codes[at], found)
            run = np.concatenate([[0], np.cumsum(width)])
            where[crossing] = run[np.searchsorted(at, starts[crossing])] + len(pool)
            number[crossing] = run[np.searchsorted(at, starts[crossing] + sizes[crossing])] + len(pool) - where[crossing]
            pool = np.concatenate([pool, ids])
        out = pool[spread(where, number)]
        run = np.concatenate([[0], np.cumsum(number)])
        return out, run[np.searchsorted(starts, head)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts of id lists; the leading space that encoding added goes."""
        size = self.raw_size[ids]
        data = self.raw[spread(self.raw_first[ids], size)]
        offsets = np.concatenate([[0], np.cumsum(size)])[first]
        heads = offsets[:-1][np.diff(offsets) > 0]
        heads = heads[data[heads] == 0x20]
        return np.delete(data, heads), offsets - np.searchsorted(heads, offsets)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of stacks of matrices."""
    out = np.full((len(a), a.shape[1], b.shape[2]), -np.inf)
    for k in range(a.shape[2]):
        np.maximum(out, a[:, :, k, None] + b[:, k, None, :], out=out)
    return out


def max_plus_scan(matrices: np.ndarray) -> np.ndarray:
    """All prefix products, by doubling: associativity lets every round combine independent pairs."""
    out = matrices.copy()
    step = 1
    while step < len(out):
        out[step:] = max_plus(out[:-step], out[step:])
        step *= 2
    return out


_vocabularies: dict[bytes, Vocabulary] = {}


def vocabulary(proto: bytes) -> Vocabulary:
    """The vocabulary of a model, kept in the worker."""
    key = hashlib.sha256(proto).digest()
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(proto)
    return _vocabularies[key]


def _proto(model: str | None) -> bytes:
    """The model file, read by the driver and sent with the function (its size is the vocabulary's, not the data's)."""
    with open(model or default_model(), "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids array<int> of every row."""
    arrow_rows(docs.sparkSession)
    proto = _proto(model)

    def run(batches):
        v = vocabulary(proto)
        for batch in slices(batches, 1):
            ids, first = v.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))], names=[key, "ids"])

    source = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return source.mapInArrow(run, T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, model: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of every row; ids out of range count as empty, bytes that aren't UTF-8 become U+FFFD."""
    arrow_rows(encoded.sparkSession)
    proto = _proto(model)

    def run(batches):
        v = vocabulary(proto)
        for batch in batches:
            column = batch.column(1).fill_null([])
            values = column.flatten().to_numpy(zero_copy_only=False)
            values = np.where((values >= 0) & (values < len(v.raw_size)), values, 0)
            sizes = np.diff(column.offsets.to_numpy())
            data, offsets = v.decode(values.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
            raw = data.tobytes()
            texts = [raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key), F.col(ids).cast("array<int>").alias("_ids")).mapInArrow(run, T.StructType([encoded.schema[key], T.StructField("text", T.StringType())]))


_DIGEST = "doc_id long, n_bytes long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def round_trip(docs: DataFrame, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode every document: doc_id, n_bytes, n_pieces, ids_sha256 (int32, little endian),
    decoded_sha256, round_trip (the decoded text is the text), and the ids themselves where asked for."""
    arrow_rows(docs.sparkSession)
    proto = _proto(model)

    def run(batches):
        v = vocabulary(proto)
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            ids, first = v.encode(batch.column("text"))
            back, back_offsets = v.decode(ids, first)
            raw, ids_raw, source = back.tobytes(), ids.tobytes(), data.tobytes()
            rows = []
            for i in range(batch.num_rows):
                text = raw[back_offsets[i] : back_offsets[i + 1]]
                rows.append((hashlib.sha256(ids_raw[4 * first[i] : 4 * first[i + 1]]).hexdigest(), hashlib.sha256(text).hexdigest(), text == source[offsets[i] : offsets[i + 1]]))
            columns = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(first)), *(pa.array(x) for x in zip(*rows, strict=True))]
            names = ["doc_id", "n_bytes", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, _DIGEST + (", ids array<int>" if with_ids else ""))
