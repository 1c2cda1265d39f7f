"""SentencePiece encoding by sampling, and lossless decoding.

A text's segmentations into pieces form a lattice.  Each piece has a weight
exp(alpha * log p); forward filtering sums the weights of all ways to each place, and
backward sampling draws pieces from the end, each in proportion to (ways to its
start) * (its weight).  A segmentation so comes out with probability proportional to the
product of its pieces' weights.  The draw at a place is number ``place`` of the
counter-based generator SplitMix64 seeded by the row's key, so a row's segmentation is the
same on any worker, at any time, in any batch.

No piece crosses from a character to a following word mark, so the lattice of a text is
the chain of the lattices of its words (with the marks before them).  The lattices of all new
distinct words of a batch are filtered together, place by place, in arrays, and kept for
later batches; all words of a batch are sampled together, piece by piece from their ends.
Sums are mantissas and binary exponents, so they stay in range, and come out alike, for
words of any length.

A word of over LONG characters keeps the sum at each place only (12 bytes a character) and
finds the pieces that end at a place anew while sampling; the draws and sums are the same.

The vocabulary is of the BPE kind, whose scores are ranks; log p is taken as
-log(1 + rank), Zipf's law.

Lossless: blanks become word marks and one mark is put in front; characters without a piece,
and word marks that the text itself holds, are spelt in byte pieces.  decode(encode(t)) = t.

Defined cases: null text gives null from ``encode`` and ``sample``, and counts as an empty text in ``digest``;
an empty text gives no pieces; a null key is seeded as its own value; repeated rows (same
key and text) give the same segmentation; texts of any length are whole.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import memo

MODEL = "piece_bpe_32k.model"
ALPHA = 2.0
SEED = 17
MARK = "▁"
#: A word mark that the text itself holds.  Words never have a mark after another character, so no word is like it.
_OWN = "\0" + MARK
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words of more characters are filtered one at a time.
LONG = 128
#: Places of word lattices that one worker keeps.
KEPT = 3_000_000
#: Characters that are sampled together.
TOGETHER = 1_000_000
#: Weight of a character spelt in bytes.
_SPELT = 1e-17
_GAMMA = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def uniforms(seeds: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Number ``n`` (from 0) of the SplitMix64 generator with each seed, as a double in [0, 1)."""
    z = seeds + (n.astype(np.uint64) + np.uint64(1)) * np.uint64(_GAMMA)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class _Growing:
    """An array that is appended to."""

    def __init__(self, kind):
        self.data, self.size = np.empty(1 << 12, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.empty(max(need, 2 * len(self.data)) - self.size, self.data.dtype)])
        self.data[self.size : need] = values
        self.size = need


class _Lattices:
    """Filtered lattices of words.  A word of n characters has n + 1 places in a row from ``first_place[word]`` on.

    ``begin[place]``: the first of the pieces that end there (they lie in a row, by their start; one more entry closes
    the last place).  Per piece: its length, its code, and the sum up to and with it of the ways into its end.
    """

    def __init__(self):
        self.first_place: dict[str, int] = {}
        self.begin, self.length, self.code, self.sums = (_Growing(k) for k in (np.int32, np.uint8, np.int32, np.float64))
        self.begin.extend(np.zeros(1, np.int32))


class Pieces:
    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [model.id_to_piece(i) for i in range(len(model))]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(len(model))]
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(self.text) if model.is_byte(i)}
        of_byte = {i: b for b, i in self.byte.items()}
        self.id = {t: i for i, t in enumerate(self.text) if not special[i]}
        self.longest = max(map(len, self.id))
        best = max(model.get_score(i) for i in self.id.values())
        self.log = {i: -alpha * math.log(2 + best - model.get_score(i)) for i in self.id.values()}
        self.raw = [bytes([of_byte[i]]) if i in of_byte else b"" if special[i] else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        self.is_byte = np.array([i in of_byte for i in range(len(self.text))])
        self.weight = np.array([math.exp(self.log[i]) if i in self.log else _SPELT for i in range(len(self.text))])
        self.of_byte = np.array([self.byte[b] for b in range(256)], np.int32)
        self.owner = f"lattice {path} {alpha}"
        self._plant()

    # -- the pieces as a trie in arrays ----------------------------------------------------------------------

    def _plant(self) -> None:
        """Trie of the pieces: a hash table of (node, character) -> node with open addressing, and the piece of each node."""
        children: dict[int, int] = {}
        piece = [-1]
        for text, i in self.id.items():
            node = 0
            for ch in text:
                key = node << 21 | ord(ch)
                if key not in children:
                    children[key] = len(piece)
                    piece.append(-1)
                node = children[key]
            piece[node] = i
        self.piece = np.array(piece, np.int32)
        bits = max(4, (8 * len(children)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.nodes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        for key, node in children.items():
            slot = (key * _GAMMA & _ALL) >> 64 - bits
            while self.keys[slot] >= 0:
                slot = slot + 1 & self.mask
            self.keys[slot], self.nodes[slot] = key, node
        self.children = children

    def _child(self, node: np.ndarray, ch: np.ndarray) -> np.ndarray:
        """The node below each, or -1."""
        key = node.astype(np.int64) << 21 | ch
        slot = (key.view(np.uint64) * np.uint64(_GAMMA) >> self.shift).astype(np.int64)
        out = self.nodes[slot]
        met = self.keys[slot]
        other = np.flatnonzero((met != key) & (met >= 0))
        out[met != key] = -1
        while len(other):
            slot[other] = slot[other] + 1 & self.mask
            met = self.keys[slot[other]]
            same = met == key[other]
            out[other[same]] = self.nodes[slot[other[same]]]
            other = other[~same & (met >= 0)]
        return out

    # -- forward filtering ---------------------------------------------------------------------------------------

    def _filter(self, words: list[str], into: _Lattices) -> None:
        """Adds the lattices of ``words``, all places at one distance from their words' begins at a time."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        word_of = np.repeat(np.arange(len(words)), size)
        word_end = np.cumsum(size)[word_of]
        place = np.arange(len(points)) + word_of  # of the character's begin, among all places of these words
        live, node = np.arange(len(points)), np.zeros(len(points), np.int32)
        starts, lengths, codes = [], [], []
        whole = np.zeros(len(points), bool)  # has a piece of its own
        for n in range(1, self.longest + 1):
            node = self._child(node, points[live + n - 1])
            there = node >= 0
            live, node = live[there], node[there]
            found = self.piece[node]
            ends = np.flatnonzero(found >= 0)
            starts.append(live[ends])
            lengths.append(np.full(len(ends), n, np.uint8))
            codes.append(found[ends])
            if n == 1:
                whole[live[ends]] = True
            more = live + n < word_end[live]
            live, node = live[more], node[more]
            if not len(live):
                break
        bare = np.flatnonzero(~whole)
        starts.append(bare)
        lengths.append(np.ones(len(bare), np.uint8))
        codes.append((points[bare] + len(self.text)).astype(np.int32))
        start, length, code = np.concatenate(starts), np.concatenate(lengths), np.concatenate(codes)
        start_place = place[start]
        end_place = start_place + length
        step = end_place - (np.cumsum(size + 1) - size - 1)[word_of[start]]  # characters before the end, in the word
        order = np.lexsort((start_place, end_place, step))
        start_place, end_place, length, code, step = start_place[order], end_place[order], length[order], code[order], step[order]
        weight = np.where(code < len(self.text), self.weight[np.minimum(code, len(self.text) - 1)], _SPELT)
        n_places = len(points) + len(words)
        mantissa, exponent = np.ones(n_places), np.zeros(n_places, np.int32)
        sums = np.empty(len(code))
        bounds = np.searchsorted(step, np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            ends = end_place[a:b]
            head = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
            count = np.diff(np.concatenate([head, [b - a]]))
            ways, power = mantissa[start_place[a:b]] * weight[a:b], exponent[start_place[a:b]]
            top = np.maximum.reduceat(power, head)
            ways = np.ldexp(ways, power - np.repeat(top, count))
            run = ways[head]
            sums[a + head] = run
            for k in range(1, int(count.max())):
                has = np.flatnonzero(count > k)
                run[has] += ways[head[has] + k]
                sums[a + head[has] + k] = run[has]
            at = ends[head]
            mantissa[at], up = np.frexp(run)
            exponent[at] = top + up
        by_place = np.lexsort((start_place, end_place))
        first = into.begin.size - 1
        counts = np.bincount(end_place, minlength=n_places)
        into.begin.extend((into.code.size + np.cumsum(counts)).astype(np.int32))
        into.length.extend(length[by_place])
        into.code.extend(code[by_place])
        into.sums.extend(sums[by_place])
        into.first_place.update(zip(words, (first + np.cumsum(size + 1) - size - 1).tolist(), strict=True))

    def _lattices(self, words: Iterable[str]) -> _Lattices:
        """The memory of this worker, with the lattices of ``words``."""
        known = memo(self.owner, 1)
        kept = known.get("kept")
        if kept is None or kept.begin.size > KEPT:
            kept = known["kept"] = _Lattices()
            first = kept.begin.size - 1
            kept.begin.extend(np.array([0, 0, 1], np.int32))  # the text's own mark: one way, two characters long
            for column, value in ((kept.length, 2), (kept.code, len(self.text) + ord(MARK)), (kept.sums, 1.0)):
                column.extend(np.array([value]))
            kept.first_place[_OWN] = first
        new = [w for w in words if w not in kept.first_place]
        if new:
            self._filter(new, kept)
        return kept

    # -- backward sampling -----------------------------------------------------------------------------------------

    def _parts(self, text: str) -> list[str]:
        """The words of a text with their marks."""
        if MARK not in text:
            return _WORD.findall(MARK + text.replace(" ", MARK))
        out: list[str] = []
        for n, piece in enumerate(text.split(MARK)):
            if n:
                out.append(_OWN)
            out += _WORD.findall(("" if n else MARK) + piece.replace(" ", MARK))
        return out

    def _long(self, word: str, seed: int, offset: int) -> Iterator[tuple[int, int]]:
        """(start, code) of the sampled pieces of a long word, from its end."""
        root, children, piece, weight, n = 0, self.children, self.piece.tolist(), self.weight, len(word)
        weight = weight.tolist()
        mantissa, exponent = array("d", bytes(8 * (n + 1))), array("i", bytes(4 * (n + 1)))
        mantissa[0] = 1.0
        spell = len(self.text)
        into: list[list] = [[] for _ in range(self.longest + 1)]  # the pieces that end at the next places, in a ring
        ring = len(into)
        for start in range(n + 1):
            if start:
                here = into[start % ring]
                top = max(exponent[s] for s, _ in here)
                total = 0.0
                for s, w in here:
                    total += math.ldexp(mantissa[s] * w, exponent[s] - top)
                mantissa[start], up = math.frexp(total)
                exponent[start] = top + up
                into[start % ring] = []
            node, end, single = root, start, False
            while end < n:
                node = children.get(node << 21 | ord(word[end]), -1)
                if node < 0:
                    break
                end += 1
                if piece[node] >= 0:
                    single = single or end == start + 1
                    into[end % ring].append((start, weight[piece[node]]))
            if start < n and not single:
                into[(start + 1) % ring].append((start, _SPELT))
        place, low, draws = n, n + 1, []
        seeds = np.array([seed & _ALL], np.uint64)
        while place:
            if place < low:
                low = max(0, place - (1 << 16))
                draws = uniforms(seeds, np.arange(offset + low, offset + place + 1)).tolist()
            found = []
            for size in range(min(self.longest, place), 0, -1):
                i = self.id.get(word[place - size : place])
                if i is not None:
                    found.append((place - size, i, weight[i]))
            if not found or found[-1][0] != place - 1:
                found.append((place - 1, spell + ord(word[place - 1]), _SPELT))
            top = max(exponent[s] for s, _, _ in found)
            sums, total = [], 0.0
            for s, _, w in found:
                total += math.ldexp(mantissa[s] * w, exponent[s] - top)
                sums.append(total)
            at = draws[place - low] * total
            k = 0
            while k < len(sums) - 1 and at >= sums[k]:
                k += 1
            place = found[k][0]
            yield place, found[k][1]

    def _sampled(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and where each text's begin (one more entry at the end)."""
        parts, per_text = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = self._parts(text)
                parts += found
                per_text[i] = len(found)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        text_of = np.repeat(np.arange(len(texts)), per_text)
        begin = np.cumsum(size) - size
        part_at = np.concatenate([[0], np.cumsum(per_text)])
        text_begin = np.concatenate([begin, [int(size.sum())]])[part_at]
        out = np.full(int(size.sum()), -1, np.int32)
        short = np.flatnonzero(size <= LONG)
        for i in np.flatnonzero(size > LONG).tolist():
            for start, code in self._long(parts[i], int(seeds[text_of[i]]), int(begin[i] - text_begin[text_of[i]])):
                out[begin[i] + start] = code
        if len(short) < len(parts):
            parts = [parts[i] for i in short.tolist()]
        kept = self._lattices(dict.fromkeys(parts))
        first, length, code, sums = kept.begin.data, kept.length.data, kept.code.data, kept.sums.data
        base = np.fromiter(map(kept.first_place.__getitem__, parts), np.int64, len(parts))
        place, at = size[short], begin[short]
        in_text, seed = at - text_begin[text_of[short]], seeds[text_of[short]]
        while len(place):
            node = base + place
            a, last = first[node], first[node + 1] - 1
            several = np.flatnonzero(last > a)
            if len(several):
                target = uniforms(seed[several], in_text[several] + place[several]) * sums[last[several]]
                while len(several):
                    on = (target >= sums[a[several]]) & (a[several] < last[several])
                    several, target = several[on], target[on]
                    a[several] += 1
            place = place - length[a]
            out[at + place] = code[a]
            more = np.flatnonzero(place)
            if len(more) < len(place):
                base, place, at, in_text, seed = base[more], place[more], at[more], in_text[more], seed[more]
        drawn = out >= 0
        bounds = np.concatenate([[0], np.cumsum(drawn)])[text_begin]
        return self._spelt(out[drawn], bounds)

    def _spelt(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are to be spelt, in byte pieces."""
        spell = codes >= len(self.text)
        if not spell.any():
            return codes, bounds
        point = np.where(spell, codes - len(self.text), 0)
        size = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        at = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(codes)), size)
        nth = np.arange(len(owner)) - at[owner]
        bits = point[owner] >> 6 * (size[owner] - 1 - nth)
        value = np.where(nth > 0, 0x80 | bits & 0x3F, np.array([0, 0, 0xC0, 0xE0, 0xF0])[size[owner]] | bits)
        ids = np.where(spell[owner], self.of_byte[value & 0xFF], codes[owner]).astype(np.int32)
        return ids, np.concatenate([at, [len(owner)]])[bounds]

    def encode_all(self, texts: list[str | None], seeds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and bounds, as of ``_sampled``, of consecutive runs of texts of about TOGETHER characters (a longer text is a run)."""
        begin = size = 0
        for i, text in enumerate(texts):
            n = len(text or "")
            if size and size + n > TOGETHER:
                yield self._sampled(texts[begin:i], seeds[begin:i])
                begin, size = i, 0
            size += n
        if begin < len(texts):
            yield self._sampled(texts[begin:], seeds[begin:])

    def encode(self, text: str, seed: int) -> list[int]:
        return self._sampled([text], np.array([seed & _ALL], np.uint64))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=4)
def pieces(path: str, alpha: float = ALPHA) -> Pieces:
    return Pieces(path, alpha)


def row_seed(key: Column, seed: int = SEED) -> Column:
    """Seed of a row, from its key alone."""
    return F.xxhash64(F.lit(seed), key.cast("string"), key.isNull())


def encode(text: Column, key: Column, alpha: float = ALPHA, seed: int = SEED, path: str | None = None) -> Column:
    """array<int> of sampled pieces."""
    path = path or public_tokenizers.path(MODEL)

    @F.arrow_udf("array<int>")
    def udf(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        p, rows, size, missing = pieces(path, alpha), [], [], texts.is_null()
        for ids, bounds in p.encode_all(texts.to_pylist(), seeds.to_numpy().view(np.uint64)):
            rows.append(ids)
            size.append(np.diff(bounds))
        offsets = np.concatenate([[0], *size]).cumsum().astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])), mask=missing)

    return udf(text, row_seed(key, seed))


def decode(ids: Column, path: str | None = None) -> Column:
    path = path or public_tokenizers.path(MODEL)

    @F.arrow_udf("string")
    def udf(rows: pa.Array) -> pa.Array:
        p = pieces(path)
        return pa.array([None if r is None else p.decode(r) for r in rows.to_pylist()], pa.string())

    return udf(ids)


def digest(text: Column, key: Column, alpha: float = ALPHA, seed: int = SEED, path: str | None = None) -> Column:
    """Per text, without moving its ids: number of pieces and of byte pieces, CRC-32 of the ids (little-endian, 32 bits), and whether decoding gives the text back."""
    path = path or public_tokenizers.path(MODEL)

    @F.arrow_udf("n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")
    def udf(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        p, given = pieces(path, alpha), texts.to_pylist()
        number, spelt, crc, same = [], [], [], []
        for ids, bounds in p.encode_all(given, seeds.to_numpy().view(np.uint64)):
            number.append(np.diff(bounds))
            spelt.append(np.diff(np.concatenate([[0], np.cumsum(p.is_byte[ids])])[bounds]))
            view, at = memoryview(ids.astype("<u4")).cast("B"), bounds.tolist()
            listed = ids.tolist()
            for a, b in zip(at[:-1], at[1:], strict=True):
                crc.append(zlib.crc32(view[4 * a : 4 * b]))
                same.append(p.decode(listed[a:b]) == (given[len(same)] or ""))
        whole = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64())
        return pa.StructArray.from_arrays([whole(number), whole(spelt), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"])

    return udf(text, row_seed(key, seed))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, seed: int = SEED, path: str | None = None) -> DataFrame:
    """One row per document: id and the sampled pieces."""
    return docs.select(F.col(id_col), encode(F.col(text_col), F.col(id_col), alpha, seed, path).alias("pieces"))
