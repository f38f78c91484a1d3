"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary (pieces and scores) of a BPE model with byte fallback is read from
a file; encoding and decoding are done here. A text gets a leading space, spaces
become the space mark, and the text is cut into units, each a run of spaces with
what follows up to the next one: no piece crosses such a border, so units are
encoded one by one. The symbols of a unit start as single characters; an agenda
holds every adjacent pair that is a piece, best score first, leftmost first among
equals. A merge taken from the agenda is skipped when a hash keyed by the seed,
the document, the unit and its place in the text, and the merge's place in the
unit is below ``dropout``: every occurrence of a word is drawn for itself. What is
left is looked up, or spelt in byte pieces where it is no piece.

Units of ordinary length are encoded together: in each round every unit makes the
merge that its agenda would give it, as array operations over all of them.

A segmentation depends on nothing but the unit and the merges that were skipped.
A worker therefore keeps, by unit and skipped merges, the ids and the merges made;
an occurrence whose hashes skip none of these has these ids, and else goes on from
the first merge that it skips. What is kept never limits what can be drawn: an
occurrence of more than DEPTH skips, and one of a unit of more than SHORT
characters that skips any, is encoded for itself. ``variants`` bounds the number of
draws of a unit, and is unbounded by default. With ``dropout=0`` the result is that of the
plain encoder. Without a seed change the result never changes.

Decoding gives back every text exactly: literal space marks in a text are spelt
in bytes, and decoding turns only the mark of a piece into a space.

Null texts have null ids; empty ones no ids. The seed is an integer.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm import words as W
from alertloom.llm.batches import bounded, fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED, VARIANTS = 0.1, 1, None
MARK = "▁"
#: characters of a unit up to which units are encoded together, round by round
LONGEST = 48
#: skipped merges, and bytes of a unit, up to which segmentations are kept
DEPTH, SHORT = 3, 20
#: segmentations a worker remembers before it starts anew
REMEMBERED = 600_000
_M64 = (1 << 64) - 1


class Vocabulary:
    """Pieces and scores; contents by id for decoding."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes = [0] * 256
        content = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                content.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                content.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} has a space inside; units would not be independent")
                self.pieces[piece] = (i, model.get_score(i))
                content.append(piece.replace(MARK, " ").encode())
        self.data = np.frombuffer(b"".join(content), dtype=np.uint8)
        self.size = np.array([len(c) for c in content], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self._pairs(len(content))

    def _pairs(self, n: int) -> None:
        """Every way to make a piece of two others, as sorted keys left * span + right.

        Characters of pieces that are no piece themselves get numbers after the pieces.
        """
        number = {p: i for p, (i, _) in self.pieces.items()}
        for c in sorted({c for p in self.pieces for c in p} - number.keys()):
            number[c] = n + len(number) - len(self.pieces)
        self.span = n + len(number) - len(self.pieces) + 1
        found = sorted((number[p[:k]] * self.span + number[p[k:]], i, score) for p, (i, score) in self.pieces.items()
                       for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.pair_key = np.array([f[0] for f in found], dtype=np.int64)
        self.pair_id = np.array([f[1] for f in found], dtype=np.int64)
        self.pair_score = np.array([f[2] for f in found], dtype=np.float64)
        single = sorted((ord(p), i) for p, i in number.items() if len(p) == 1 and p != MARK) + [(ord(" "), number.get(MARK, -1))]
        self.char_code = np.array([c for c, _ in sorted(single)], dtype=np.int64)
        self.char_id = np.array([i for _, i in sorted(single)], dtype=np.int64)
        self.n_pieces = n

    def encode_units(self, data: np.ndarray, bounds: np.ndarray, skips: "Skips") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids by unit, codes of the merges made, number of them by unit) of many units given as bytes.

        In each round every unit makes its best merge.

        Units of more than LONGEST characters, and those with characters that
        take several byte pieces, are encoded one by one.
        """
        n = len(bounds) - 1
        heads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][bounds]  # characters before each unit
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        size = np.diff(heads)
        known = np.minimum(np.searchsorted(self.char_code, code), len(self.char_code) - 1)
        ident = np.where(self.char_code[known] == code, self.char_id[known], -1)
        unit = np.repeat(np.arange(n), size)
        alone = size > LONGEST
        alone[unit[((ident < 0) | (ident >= self.n_pieces)) & (code >= 0x80)]] = True
        final, alive = ident.copy(), np.ones(len(code), dtype=bool)
        made_unit, made_code = self._merge(ident, unit, np.arange(len(code)) - heads[:-1][unit], skips, alone, final, alive)
        order = np.argsort(made_unit, kind="stable")
        codes, n_codes = made_code[order], np.bincount(made_unit, minlength=n)
        single = (final < 0) & (code < 0x80)
        final[single] = np.array(self.bytes)[code[single]]
        counts = np.bincount(unit[alive], minlength=n)
        if not alone.any():
            return final[alive].astype(np.int32), counts, codes, n_codes
        parts = np.split(final[alive].astype(np.int32), np.cumsum(counts)[:-1])
        taken = np.split(codes, np.cumsum(n_codes)[:-1])
        for u in np.flatnonzero(alone):
            ids, steps = self.encode_unit(data[bounds[u]: bounds[u + 1]].tobytes().decode("utf-8"), skips.of(int(u)))
            parts[u], taken[u] = np.array(ids, dtype=np.int32), np.array(steps, dtype=np.uint64)
        return (np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64),
                np.concatenate(taken), np.array([len(x) for x in taken], dtype=np.int64))

    def _merge(self, ident, unit, place, skips, alone, final, alive) -> tuple[np.ndarray, np.ndarray]:
        """Merges the symbols of all units that are not ``alone``; fills the last id and liveness of each symbol.

        Gives the unit and code of every merge made, in order within a unit.
        """
        made_unit, made_code = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        keep = ~alone[unit]
        origin = np.flatnonzero(keep)
        ident, unit, place = ident[keep], unit[keep], place[keep]
        length = np.ones(len(ident), dtype=np.int64)
        live = np.ones(len(ident), dtype=bool)
        score, made = np.full(len(ident), -np.inf), np.full(len(ident), -1)
        after = before = start = None

        def frame() -> None:
            nonlocal after, before, start
            edge = np.r_[True, unit[1:] != unit[:-1]]
            start = np.flatnonzero(edge)
            after, before = np.arange(1, len(unit) + 1), np.arange(-1, len(unit) - 1)
            before[start] = -1
            after[np.r_[start[1:], len(unit)] - 1] = -1

        def offer(i: np.ndarray) -> None:
            """Scores of the merges of i with what follows."""
            j = after[i]
            score[i] = -np.inf
            good = (j >= 0) & (ident[i] >= 0) & (ident[j] >= 0)
            i, j = i[good], j[good]
            pair = ident[i] * self.span + ident[j]
            at = np.minimum(np.searchsorted(self.pair_key, pair), len(self.pair_key) - 1)
            good = self.pair_key[at] == pair
            i, j, at = i[good], j[good], at[good]
            good = ~skips.among(unit[i], _codes(place[i], place[j], length[j]))
            i, at = i[good], at[good]
            score[i], made[i] = self.pair_score[at], self.pair_id[at]

        if not len(ident):
            return made_unit[0], made_code[0]
        frame()
        offer(np.arange(len(ident)))
        while True:
            best = np.maximum.reduceat(score, start)
            active = np.isfinite(best)
            if not active.any():
                break
            if active.mean() < 0.7:  # go on with the units that still merge, without dead symbols
                final[origin], alive[origin] = ident, live
                keep = live & np.repeat(active, np.diff(np.r_[start, len(unit)]))
                origin, ident, unit, place, length, score, made = (x[keep] for x in (origin, ident, unit, place, length, score, made))
                live = np.ones(len(ident), dtype=bool)
                frame()
                best = np.maximum.reduceat(score, start)
            top = np.flatnonzero((score == np.repeat(best, np.diff(np.r_[start, len(unit)]))) & np.isfinite(score))
            i = top[np.r_[True, unit[top][1:] != unit[top][:-1]]]  # the leftmost of a unit
            j = after[i]
            made_unit.append(unit[i])
            made_code.append(_codes(place[i], place[j], length[j]))
            ident[i] = made[i]
            length[i] += length[j]
            live[j] = False
            score[j] = -np.inf
            after[i] = after[j]
            follows = after[i] >= 0
            before[after[i][follows]] = i[follows]
            offer(i)
            offer(before[i][before[i] >= 0])
        final[origin], alive[origin] = ident, live
        return np.concatenate(made_unit), np.concatenate(made_code)

    def encode_unit(self, unit: str, skipped) -> tuple[list[int], list[int]]:
        """(ids, codes of the merges made) of one unit; merges whose code is ``skipped`` are not made."""
        steps: list[int] = []
        text = [MARK if c == " " else c for c in unit]
        literal = [c == MARK for c in unit]
        n = len(text)
        piece, right, left = text, list(range(1, n + 1)), list(range(-1, n - 1))
        alive, agenda, pieces = [True] * n, [], self.pieces

        def offer(i: int, j: int) -> None:
            if i < 0 or j >= n or literal[i] or literal[j]:
                return
            whole = pieces.get(piece[i] + piece[j])
            if whole is not None:
                heapq.heappush(agenda, (-whole[1], i, j, len(piece[i]), len(piece[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, size_i, size_j = heapq.heappop(agenda)
            if not (alive[i] and alive[j]) or right[i] != j or len(piece[i]) != size_i or len(piece[j]) != size_j:
                continue
            code = _code(i, j, size_j)
            if skipped(code):
                continue
            steps.append(code)
            piece[i] += piece[j]
            alive[j] = False
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        out = []
        for i in range(n):
            if alive[i]:
                known = None if literal[i] else pieces.get(piece[i])
                out += [known[0]] if known else [self.bytes[b] for b in piece[i].encode()]
        return out, steps

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, one after the other."""
        size = self.size[ids]
        begin = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.data[begin + np.arange(len(begin))]


def _code(i: int, j: int, size: int) -> int:
    """The place of a merge: where its two symbols begin and the size of the second."""
    return ((i * 0x9E3779B97F4A7C15) ^ (j * 0xC2B2AE3D27D4EB4F) ^ (size * 0x165667B19E3779F9)) & _M64


def _codes(i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``_code`` of arrays."""
    i, j, size = (x.astype(np.uint64) for x in (i, j, size))
    return (i * np.uint64(0x9E3779B97F4A7C15)) ^ (j * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (size * np.uint64(0x165667B19E3779F9))


def _below(key: np.ndarray, code: np.ndarray, bar: int) -> np.ndarray:
    """Whether the hashes of merges fall below ``bar`` (of 2^32)."""
    return (W.mix(key ^ code) & np.uint64(0xFFFFFFFF)).astype(np.int64) < bar if len(key) else np.zeros(0, dtype=bool)


class Drawn:
    """Skips by the hash of each unit's key and the merge."""

    def __init__(self, keys: np.ndarray, bar: int):
        self.keys, self.bar = keys, bar

    def among(self, unit: np.ndarray, code: np.ndarray) -> np.ndarray:
        return _below(self.keys[unit], code, self.bar)

    def of(self, unit: int):
        key, bar = int(self.keys[unit]), self.bar

        def skipped(code: int) -> bool:
            x = key ^ code
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M64
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M64
            return ((x ^ (x >> 31)) & 0xFFFFFFFF) < bar
        return skipped


class Listed:
    """Skips given as up to DEPTH codes by unit; the first ``count`` of a row are used."""

    def __init__(self, codes: np.ndarray, count: np.ndarray):
        self.codes, self.count = codes, count

    def among(self, unit: np.ndarray, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(unit), dtype=bool)
        for d in range(self.codes.shape[1]):
            out |= (self.codes[unit, d] == code) & (self.count[unit] > d)
        return out

    def of(self, unit: int):
        return set(self.codes[unit, : self.count[unit]].tolist()).__contains__


Skips = Drawn | Listed


@lru_cache(maxsize=1)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


def _units(data: np.ndarray, bounds: np.ndarray) -> W.Words:
    """The rows with a leading space each, cut before every run of spaces."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    lead = np.cumsum(size > 0)  # one more byte for every row that has text
    spaced = np.full(len(data) + int(lead[-1]) if n else 0, 0x20, dtype=np.uint8)
    at = np.arange(len(data)) + np.repeat(lead, size)
    spaced[at] = data
    moved = bounds + np.r_[0, lead]
    space = spaced == 0x20
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[moved[:-1][size > 0]] = True
    start = np.flatnonzero(cut)
    return W.Words(spaced, moved, start, np.r_[start[1:], len(spaced)].astype(np.int64)[: len(start)], np.searchsorted(moved, start, side="right") - 1)


class Encoder:
    """Encodes slices of texts; keeps the ids of the units it has seen."""

    def __init__(self, model_file: str, dropout: float, seed: int, variants: int | None = VARIANTS):
        self.vocabulary = vocabulary(model_file)
        self.bar = int(dropout * (1 << 32))
        self.seed, self.variants = seed & _M64, None if variants is None else max(1, variants)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.places = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)  # sorted by key
        self.pools = [np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.uint64)]  # ids, merges
        self.first = [np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)]
        self.used = [0, 0]

    def _add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, n_codes: np.ndarray) -> None:
        low = len(self.keys)
        at = np.searchsorted(self.keys, keys)  # the new keys are sorted and none is known
        self.keys = np.insert(self.keys, at, keys)
        self.places = np.insert(self.places, at, np.arange(low, low + len(keys), dtype=np.int32))
        for x, (values, sizes) in enumerate(((ids, counts), (codes, n_codes))):
            end = self.used[x] + len(values)
            while end > len(self.pools[x]):
                self.pools[x] = np.concatenate([self.pools[x], np.zeros_like(self.pools[x])])
            while low + len(keys) + 1 > len(self.first[x]):
                self.first[x] = np.concatenate([self.first[x], np.zeros_like(self.first[x])])
            self.pools[x][self.used[x]: end] = values
            self.first[x][low + 1: low + 1 + len(keys)] = self.used[x] + np.cumsum(sizes)
            self.used[x] = end

    def _kept(self, x: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, number of them by place) of kept segmentations: their ids (0) or merges (1)."""
        low = self.first[x][place]
        size = self.first[x][place + 1] - low
        ends = np.cumsum(size)
        return self.pools[x][np.repeat(low - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size

    @staticmethod
    def _bytes(units: W.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last = units.start[which], units.end[which]
        ends = np.cumsum(last - first)
        return units.data[np.repeat(first - (ends - (last - first)), last - first) + np.arange(ends[-1])], np.r_[0, ends]

    def _find(self, units: W.Words, which: np.ndarray, key: np.ndarray, skips: np.ndarray, depth: int) -> np.ndarray:
        """Places of the segmentations of the units ``which``, by the key of unit and skips; new ones are encoded."""
        known, example, at = np.unique(key, return_index=True, return_inverse=True)
        place = np.full(len(known), -1, dtype=np.int64)
        if len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, known), len(self.keys) - 1)
            same = self.keys[spot] == known
            place[same] = self.places[spot[same]]
        new = np.flatnonzero(place < 0)
        if len(new):
            example = example[new]
            low = len(self.keys)
            listed = Listed(skips[example], np.full(len(example), depth))
            self._add(known[new], *self.vocabulary.encode_units(*self._bytes(units, which[example]), listed))
            place[new] = np.arange(low, low + len(new))
        return place[at]

    def encode(self, data: np.ndarray, bounds: np.ndarray, doc_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds of the rows in them)."""
        units = _units(data, bounds)
        n = units.n_rows
        total = len(units.start)
        if not total:
            return np.zeros(0, dtype=np.int32), np.zeros(n + 1, dtype=np.int64)
        if len(self.keys) > REMEMBERED:
            self._clear()
        key = units.hashes()
        size = units.end - units.start
        draw = np.zeros(total, dtype=np.uint64)
        if self.bar:
            index = np.arange(total, dtype=np.uint64) - units.first()[units.row].astype(np.uint64)
            draw = W.mix(doc_hash[units.row] + index * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed))
            if self.variants is not None:
                draw %= np.uint64(self.variants)
            draw = W.mix(key + (draw + np.uint64(1)) * np.uint64(0xA0761D6478BD642F) + np.uint64(self.seed))
        final = np.full(total, -1, dtype=np.int64)  # places of kept segmentations; -1: encoded for itself
        now = np.flatnonzero(size <= LONGEST) if self.bar else np.arange(total)
        skips = np.zeros((len(now), DEPTH), dtype=np.uint64)
        node = key[now]
        for depth in range(DEPTH + 1):
            if not len(now):
                break
            place = self._find(units, now, node, skips, depth)
            if not self.bar:
                final[now] = place
                break
            codes, count = self._kept(1, place)
            owner = np.repeat(np.arange(len(now)), count)
            # the merges before the last skip were drawn before, those that were skipped are not among them
            hit = np.flatnonzero(_below(draw[now][owner], codes, self.bar))
            first = hit[np.r_[True, owner[hit][1:] != owner[hit][:-1]]] if len(hit) else hit
            skip = np.zeros(len(now), dtype=bool)
            skip[owner[first]] = True
            final[now[~skip]] = place[~skip]
            more = owner[first]
            keep = size[now[more]] <= SHORT
            if depth == DEPTH:
                break
            more, code = more[keep], codes[first[keep]]
            now, node, skips = now[more], node[more], skips[more]
            skips[:, depth] = code
            node = W.mix(node ^ W.mix(code + np.uint64(depth + 1)))
        own = np.flatnonzero(final < 0)
        ids, count = self._kept(0, final[final >= 0])
        if len(own):
            more, n_more, _, _ = self.vocabulary.encode_units(*self._bytes(units, own), Drawn(draw[own], self.bar))
            counts = np.zeros(total, dtype=np.int64)
            counts[final >= 0], counts[own] = count, n_more
            by_own = np.repeat(final < 0, counts)
            out = np.zeros(len(by_own), dtype=np.int32)
            out[by_own], out[~by_own] = more, ids
            ids, count = out, counts
        return ids, np.r_[0, np.cumsum(count)][np.searchsorted(units.row, np.arange(n + 1))]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds of the rows), the leading space of each row taken off."""
        total = np.r_[0, np.cumsum(self.vocabulary.size[ids])][bounds]
        raw = self.vocabulary.decode(ids)
        keep = np.ones(len(raw), dtype=bool)
        some = np.diff(total) > 0
        keep[total[:-1][some]] = False
        return raw[keep], total - np.r_[0, np.cumsum(some)]


_ENCODERS: dict = {}


def _encoder(*key) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def _encode_rows(keep: list[str], text: str, own: str, key: tuple):
    def run(batches):
        coder = _encoder(*key)
        for rows, data, bounds in W.slices(batches, text):
            seeds = W.column(rows, own).to_numpy(zero_copy_only=False).view(np.uint64)
            ids, ends = coder.encode(data, bounds, seeds)
            back, back_ends = coder.decode(ids, ends)
            equal = np.array_equal(back_ends, bounds) and np.array_equal(back, data)
            lossless = np.ones(rows.num_rows, dtype=bool) if equal else np.array(
                [np.array_equal(back[back_ends[r]: back_ends[r + 1]], data[bounds[r]: bounds[r + 1]]) for r in range(rows.num_rows)])
            gone = W.column(rows, text).is_null().to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            if gone.any():
                lists = pa.array([None if g else x for g, x in zip(gone, lists.to_pylist(), strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(W.column(rows, c) for c in keep), lists, pa.array(np.diff(ends)), pa.array(lossless)],
                                             names=[*keep, "ids", "n_ids", "lossless"])
    return run


def encode(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, variants: int | None = VARIANTS, doc_id: str = "doc_id", text: str = "text",
           model_file: str = MODEL) -> DataFrame:
    """``doc_id, ids, n_ids, lossless``: lossless says that decoding the ids gave the text back."""
    rows = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id)).alias("seed"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encode_rows(["doc_id"], "text", "seed", (model_file, dropout, seed, variants)),
                           f"doc_id {kind}, ids array<int>, n_ids bigint, lossless boolean")


def with_ids(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, variants: int | None = VARIANTS, doc_id: str = "doc_id", text: str = "text",
             model_file: str = MODEL) -> DataFrame:
    """``docs`` with ``ids, n_ids, lossless``; columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("ids", "n_ids", "lossless")]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    own, = fresh(keep, "seed")
    return (bounded(docs).select(*(F.col(f"`{c}`") for c in keep), F.xxhash64(F.col(doc_id)).alias(own))
            .mapInArrow(_encode_rows(keep, text, own, (model_file, dropout, seed, variants)), f"{kinds}, ids array<int>, n_ids bigint, lossless boolean"))


def _decode_rows(model_file: str):
    def run(batches):
        coder = _encoder(model_file, 0.0, 0, 1)
        for rows in batches:
            column = W.column(rows, "ids")
            flat, size = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            raw, ends = coder.decode(flat, np.r_[0, np.cumsum(size)].astype(np.int64))
            whole = raw.tobytes()
            texts = [None if null else whole[a:b].decode("utf-8", "replace") for a, b, null in zip(ends[:-1], ends[1:], column.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([W.column(rows, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return run


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", model_file: str = MODEL) -> DataFrame:
    """``doc_id, text`` of encoded documents."""
    rows = bounded(encoded).select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(_decode_rows(model_file), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
