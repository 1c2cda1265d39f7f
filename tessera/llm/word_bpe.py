"""Ids of a byte-level BPE with word ends, equal to those of the ``tokenizers`` library, with each distinct piece tokenised once.

White space is dropped by this vocabulary's pre-tokeniser, so no token crosses it and a
text's ids are those of its pieces, one after another.  The texts of a batch are lower-cased and cut into
the pieces of the vocabulary's own pattern as one array of bytes; equal pieces are found by Arrow,
and each new one is given to the library's BPE model.  Words with anything but
plain letters, digits and signs (other scripts, combining marks, special tokens' strings) are pieces as they are, which
go through the library's whole pipeline, in one call.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa

from .common import former, memo, model, trim

#: Distinct pieces that one worker remembers; as many more from before the last emptying are within reach.
MEMO = 100_000
#: Bytes of text that are cut together.
TOGETHER = 4_000_000

#: A piece of plain letters, digits or signs.
_PLAIN = re.compile(rb"(?:(?!<\|)[\x21-\x7e]|\xc3[\x80-\xbf])+")

_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


def _kinds() -> np.ndarray:
    """The kind of each byte that stands for itself; 0xC3, the first byte of U+00C0 to U+00FF, is a letter's."""
    kinds = np.full(256, _ODD, np.uint8)
    kinds[0x21:0x7F] = _SIGN
    kinds[[0x20, *range(0x09, 0x0E)]] = _SPACE
    kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = _LETTER
    kinds[0x30:0x3A] = _DIGIT
    return kinds


_KIND = _kinds()
_LOWER = np.array([b + 32 * (0x41 <= b <= 0x5A) for b in range(256)], np.uint8)


def cut_up(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The bytes of all words, lower-cased, where in ``data`` each piece starts, where in those bytes, and
    whether there are pieces for the whole pipeline.  Pieces are those of the
    vocabulary's pattern, ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``; a word that only the
    whole pipeline can tokenise is one piece, as it is.  ``data`` ends in a space.
    """
    raw = np.frombuffer(data, np.uint8)
    kind, low = _KIND[raw], _LOWER[raw]
    first = np.flatnonzero(raw == 0xC3)
    second = raw[first + 1]
    right = (second >= 0x80) & (second <= 0xBF)
    kind[first[~right]] = _ODD
    first, second = first[right], second[right]
    of_pair = np.where((second == 0x97) | (second == 0xB7), _SIGN, _LETTER)  # the signs of multiplication and division
    kind[first] = kind[first + 1] = of_pair
    low[first + 1] += np.where((second <= 0x9E) & (second != 0x97), 32, 0).astype(np.uint8)

    begins = np.empty(len(raw), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == _DIGIT
    quote = np.flatnonzero((raw == 0x27) & begins)
    # a sign's run that begins with a quote; what follows it in data ends in a space
    after = low[np.minimum(quote[:, None] + [1, 2], len(raw) - 1)]
    one = np.isin(after[:, 0], np.frombuffer(b"stmd", np.uint8))
    two = np.isin(after[:, 0].astype(np.uint16) << 8 | after[:, 1], [0x7265, 0x7665, 0x6C6C])
    begins[quote[one] + 1] = begins[quote[two] + 1] = False
    begins[quote[one] + 2] = begins[quote[two] + 3] = True
    # pair bytes are of one kind, so no piece begins at a second byte

    word = kind != _SPACE
    odd = kind == _ODD
    special = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))
    odd[special] = True
    any_odd = bool(odd.any())
    if any_odd:
        edge = np.flatnonzero(np.diff(word, prepend=False))  # begins and ends of words, in turn
        strange = np.unique(np.searchsorted(edge[::2], np.flatnonzero(odd), "right") - 1)
        for a, b in zip(edge[::2][strange].tolist(), edge[1::2][strange].tolist(), strict=True):
            begins[a:b] = False
            begins[a] = True
            low[a:b] = raw[a:b]
    begins &= word
    return low[word], np.flatnonzero(begins), np.flatnonzero(begins[word]), any_odd


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.owner = f"word bpe {path}"
        memo(self.owner, MEMO, keep_former=True)  # what other operators remember and have freed goes first
        trim()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()

    def _learn(self, pieces: list[bytes], known: dict, any_odd: bool) -> None:
        """Adds the ids of pieces, as bytes."""
        strange = [p for p in pieces if _PLAIN.fullmatch(p) is None] if any_odd else []
        if strange:
            texts = [p.decode("utf-8", "replace") for p in strange]
            for piece, got in zip(strange, self.whole.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                known[piece] = np.array(got.ids, "<u4").tobytes()
        tokenize, letters = self.model.tokenize, self.letters
        for piece in pieces:
            if piece not in known:
                ids = [t.id for t in tokenize(piece.decode() if piece.isascii() else piece.decode("latin-1").translate(letters))]
                known[piece] = struct.pack(f"<{len(ids)}I", *ids)

    def encode_all(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers.  About TOGETHER bytes of text are cut at a time."""
        begin = size = 0
        for i, text in enumerate(texts):
            size += len(text or b"")
            if size >= TOGETHER or i + 1 == len(texts):
                yield from self._encoded(texts[begin : i + 1])
                begin, size = i + 1, 0

    def _encoded(self, texts: list[bytes | None]) -> Iterator[bytes]:
        texts = [text or b"" for text in texts]
        bytes_of, places, starts, any_odd = cut_up(b" ".join([*texts, b""]))
        offsets = np.append(starts, len(bytes_of)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_of)]).dictionary_encode()
        known = memo(self.owner, MEMO, keep_former=True)
        before = former(self.owner)
        distinct = pieces.dictionary.to_pylist()
        missing = [p for p in distinct if p not in known]
        if before:
            known.update((p, before[p]) for p in missing if p in before)
            missing = [p for p in missing if p not in before]
        if missing:
            self._learn(missing, known, any_odd)
        ids = pa.array([known[p] for p in distinct], pa.large_binary()).take(pieces.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        first = [0, *accumulate(len(text) + 1 for text in texts)]
        cuts = ends[np.searchsorted(places, first)].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield bytes(data[a:b])

    def ids(self, text: bytes) -> np.ndarray:
        return np.frombuffer(next(self.encode_all([text])), "<u4")


@model
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
