"""Quality rules by tokeniser fertility.

A text is cut into words; each word is tokenised by two public vocabularies: one with byte
fallback, and a byte-level one made for many languages.  Measured per text: characters per token of both, and,
of the first, the share of byte-fallback tokens and the token entropy (as a share of the most that so
many tokens, up to 512, can have).  Each language has a band for each measure; a text outside one band is rejected.  The
band of the text's main script holds where the language is unknown.

Everything is a function of one row: no shuffle, and a lost executor costs only
its own splits.

Defined cases: a null or wordless text has zero counts, null measures and fails the
base rules; ``lang`` null or unlisted takes the band of the script; a text whose
letters are of no known script takes the widest band; repeated rows give repeated
results; other columns are not touched.
"""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import memo, model

MODEL = "piece_bpe_32k.model"
MULTI = "byte_bpe_multi_50k.tiktoken"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: A language's tokens have a bounded entropy, so the most that n tokens can have counts up to this n.
ENTROPY_TOKENS = 512
#: Words whose tokenisation one worker remembers.
MEMO = 180_000
#: Greater than any id.
_BEYOND = 1 << 20


@dataclass(frozen=True)
class Band:
    """Accepted ranges, ends included."""

    min_chars_per_token: float
    min_multi_chars_per_token: float
    max_chars_per_token: float  # of either vocabulary
    max_byte_share: float
    min_entropy: float


#: Per language, and per script where the language is unknown.  Symbols glued to words, all capitals and
#: random strings come at few characters a token; repeated text and lists of few words have low entropy.  The lower
#: ends for the four languages lie under 99 % of the clean labelled documents of a sample (every second document of
#: the 10 000 of the sf0.1 tables); the other bands are wider, as no sample of them was at hand.
BANDS: dict[str, Band] = {
    "en": Band(1.88, 2.12, 6.5, 0.02, 0.705),
    "de": Band(1.95, 2.155, 6.5, 0.02, 0.695),
    "fr": Band(1.70, 1.93, 6.5, 0.02, 0.694),
    "es": Band(1.74, 2.07, 6.5, 0.02, 0.699),
    "LATIN": Band(1.50, 1.85, 6.5, 0.05, 0.68),
    "CYRILLIC": Band(1.10, 1.10, 6.0, 0.05, 0.50),
    "GREEK": Band(0.80, 0.80, 5.0, 0.20, 0.45),
    "CJK": Band(0.30, 0.20, 4.0, 0.70, 0.40),
    "": Band(0.25, 0.20, 12.0, 0.90, 0.30),
}

SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens", "n_multi_tokens")]
    + [T.StructField(n, T.DoubleType()) for n in ("chars_per_token", "multi_chars_per_token", "byte_share", "token_entropy")]
    + [T.StructField("script", T.StringType())]
)


@model
def _tokenizer(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.array([model.is_byte(i) for i in range(len(model))])
    return model, is_byte


@model
def _multi(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of ``window`` words that the text holds twice or more."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    width = 1
    while width < window:  # rank of the sequence of `width` words from each place, doubled as far as it goes
        step = min(width, window - width)
        rank = np.unique(rank[: n - width - step + 1] * n + rank[step : n - width + 1], return_inverse=True)[1]
        width += step
    twice = np.bincount(rank)[rank] > 1
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    mark[at] += 1
    mark[at + window] -= 1
    return int((np.cumsum(mark)[:n] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    found = 0
    for line in text.split(b"\n"):
        if line in seen:
            found += 1
        elif line.strip(b" \t\r\x0b\x0c"):
            seen.add(line)
    return found


#: First code point of each range of letters, and whose it is.
_STARTS = np.array([0, 0x41, 0x5B, 0x61, 0x7B, 0xC0, 0x250, 0x370, 0x400, 0x530, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0])
_SCRIPTS = ("", "LATIN", "CYRILLIC", "GREEK", "CJK")
_WHOSE = np.array([0, 1, 0, 1, 0, 1, 0, 3, 2, 0, 4, 0, 4, 0, 4, 0])


def _script(text: str) -> str:
    """The script that most letters of the whole text belong to; ties go to the first of _SCRIPTS."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    counts = np.bincount(_WHOSE[np.searchsorted(_STARTS, points, side="right") - 1], minlength=len(_SCRIPTS))
    counts[0] = 0
    return _SCRIPTS[int(counts.argmax())] if counts.any() else ""


def measure(text: bytes | None, path: str, multi: str) -> tuple:
    """The fields of SCHEMA for one text."""
    text = text or b""
    words = text.split()
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    if not words:
        return (0, 0, n_symbols, 0, 0, 0, 0, 0, None, None, None, None, "")
    known = memo(f"fertility {path} {multi}", MEMO)  # ids of each word and, beyond them, its number of tokens by the second vocabulary
    pieces, is_byte = _tokenizer(path)
    missing = [w for w in set(words) if w not in known]
    if missing:
        texts, cut = [w.decode("utf-8", "replace") for w in missing], _multi(multi)
        for word, said, ids in zip(missing, texts, pieces.encode(texts, num_threads=1), strict=True):
            known[word] = np.array([*ids, _BEYOND + len(cut(said))], np.int32).tobytes()
    ids = np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32)
    n_multi = int((ids[ids >= _BEYOND].astype(np.int64) - _BEYOND).sum())
    ids = ids[ids < _BEYOND]
    joined = b"".join(words).decode("utf-8", "replace")
    n_tokens, n_bytes = len(ids), int(is_byte[ids].sum())
    p = np.unique(ids, return_counts=True)[1] / max(1, n_tokens)
    entropy = float(-(p * np.log2(p)).sum()) / math.log2(min(n_tokens, ENTROPY_TOKENS)) if n_tokens > 1 else 1.0
    return (
        len(words), len(joined), n_symbols, duplicate_lines(text), repeated_words(words),
        n_tokens, n_bytes, n_multi, len(joined) / max(1, n_tokens), len(joined) / max(1, n_multi), n_bytes / max(1, n_tokens), entropy, _script(joined),
    )


def measures(text: Column, path: str | None = None, multi: str | None = None) -> Column:
    """Struct of SCHEMA for each text."""
    path, multi = path or public_tokenizers.path(MODEL), multi or public_tokenizers.path(MULTI)
    kind = pa.struct([pa.field(f.name, {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string()}[type(f.dataType)]) for f in SCHEMA])

    @F.arrow_udf(SCHEMA)
    def udf(texts: pa.Array) -> pa.Array:
        rows = (measure(t.as_py(), path, multi) for t in texts)
        return pa.array([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], type=kind)

    return udf(text.cast("binary"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def in_band(m: Column, lang: Column, bands: dict[str, Band] = BANDS) -> Column:
    """Whether the measures lie in the band of the language, or else of the script."""

    def ok(b: Band) -> Column:
        fertile = m["chars_per_token"].between(b.min_chars_per_token, b.max_chars_per_token) & m["multi_chars_per_token"].between(b.min_multi_chars_per_token, b.max_chars_per_token)
        return fertile & (m["byte_share"] <= b.max_byte_share) & (m["token_entropy"] >= b.min_entropy)

    keys = F.lit("," + ",".join(bands) + ",")
    known = lambda k: F.contains(keys, F.concat(F.lit(","), k, F.lit(",")))
    key = F.when(lang.isNotNull() & known(lang), lang).when(known(m["script"]), m["script"]).otherwise(F.lit(""))
    verdict = ok(bands[""])
    for name, band in bands.items():
        verdict = F.when(key == name, ok(band)).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bands: dict[str, Band] = BANDS, path: str | None = None) -> DataFrame:
    """One row per document: id, the measures, ``base_failed`` and ``kept``."""
    got = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), measures(F.col(text_col), path).alias("_m"))
    m = F.col("_m")
    failed = base_failed(m)
    return got.select(F.col("_id").alias(id_col), "_m.*", failed.alias("base_failed"), (~failed & in_band(m, F.col("_lang"), bands)).alias("kept"))


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bands: dict[str, Band] = BANDS, path: str | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns whatever those are called."""
    got = docs.select(F.struct("*").alias("_row"), measures(F.col(text_col), path).alias("_m"))
    m = F.col("_m")
    return got.filter(~base_failed(m) & in_band(m, F.col(f"_row.{lang_col}"), bands)).select("_row.*")
