"""Quality rules by tokeniser fertility.

A public vocabulary tells how natural a text is: characters per token fall and the
share of byte-fallback tokens rises in symbol soup, broken encodings and shuffled
letters; the entropy of the tokens falls in repetitive text. A text is rejected when a
figure leaves the band of its script and language, or of its script alone when the
language is not told or has no band of its own.

Words are encoded one by one, so a text's figures are sums over its words, and every
distinct word is encoded once per worker. One pass over the scan, no shuffle; memory
is the word table (bounded) and one text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm import vocabularies
from corpusloom.llm.texts import MAX_WORDS, Grown, WordIds, column, held, per_text, ragged


class Band(NamedTuple):
    """What the texts of a script or language must keep to; the entropy counts from ``ENTROPY_WORDS`` words on."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float


SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "han", "kana", "hangul", "other", "none")
#: Rejection bands per script and language ("latin-en") and per script; a script that is not named has that of "other".
#: "none": no letters at all. Floors of a language are the 0.5 % quantiles of the texts of sf0.1 labelled good that pass
#: the base rules, rounded down. No labelled text comes near the ceilings or has a byte token, so those stay wide.
BANDS: Mapping[str, Band] = {
    "latin-en": Band(2.05, 12.0, 0.15, 5.78),
    "latin-de": Band(2.07, 12.0, 0.15, 5.8),
    "latin-fr": Band(1.77, 12.0, 0.15, 5.72),
    "latin-es": Band(1.8, 12.0, 0.15, 5.8),
    "latin": Band(1.6, 12.0, 0.15, 5.2),
    "greek": Band(0.6, 12.0, 0.6, 3.0),
    "cyrillic": Band(1.0, 12.0, 0.3, 3.0),
    "hebrew": Band(0.4, 12.0, 0.9, 2.5),
    "arabic": Band(0.4, 12.0, 0.9, 2.5),
    "han": Band(0.25, 12.0, 0.95, 3.0),
    "kana": Band(0.25, 12.0, 0.95, 3.0),
    "hangul": Band(0.25, 12.0, 0.95, 3.0),
    "other": Band(0.2, 12.0, 1.0, 2.0),
    "none": Band(0.8, 12.0, 0.5, 2.0),
}
ENTROPY_WORDS = 50
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SPACE = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
#: Numbers below this fit three to a 63-bit window code.
PACKED = 1 << 21

RESULT = T.StructType(
    [
        *[
            T.StructField(name, T.LongType(), False)
            for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
        ],
        T.StructField("base_failed", T.BooleanType(), False),
        T.StructField("script", T.StringType(), False),
        *[T.StructField(name, T.DoubleType()) for name in ("chars_per_token", "byte_share", "token_entropy")],
        T.StructField("kept", T.BooleanType(), False),
    ]
)
ARROW = {
    "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(),
}


def script_of(word: str) -> int:
    """Place in ``SCRIPTS`` of the word's first letter."""
    for letter in word:
        if letter.isascii():
            if letter.isalpha():
                return 0
        elif letter.isalpha():
            name = unicodedata.name(letter, "").split(" ", 1)[0].lower()
            if name == "cjk":
                return SCRIPTS.index("han")
            if name in ("hiragana", "katakana"):
                return SCRIPTS.index("kana")
            return SCRIPTS.index(name) if name in SCRIPTS[:-2] else SCRIPTS.index("other")
    return SCRIPTS.index("none")


class WordTokens:
    """Per distinct word: script, code points, tokens, and how many of them are bytes."""

    def __init__(self, path: str) -> None:
        self.encode, self.path = vocabularies.encoder(path), path
        self.bytes = np.array(sorted(vocabularies.byte_tokens(path)), np.int64)
        self.clear()

    def clear(self) -> None:
        self.words = WordIds()
        self.script, self.n_tokens, self.n_bytes = Grown(np.int8), Grown(np.int32), Grown(np.int32)
        self.start, self.tokens = Grown(np.int64), Grown(np.int32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        ids = self.words.ids(words)
        if self.words.fresh:
            texts = [w.decode("utf-8", "replace") for w in self.words.take_fresh()]
            encoded = self.encode(texts)
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
            flat = np.fromiter((t for e in encoded for t in e), np.int64, int(lengths.sum()))
            ends = np.cumsum(lengths)
            is_byte = np.concatenate([[0], np.cumsum(np.isin(flat, self.bytes))])
            self.start.add(len(self.tokens.values) + ends - lengths)
            self.n_bytes.add(is_byte[ends] - is_byte[ends - lengths])
            self.n_tokens.add(lengths)
            self.tokens.add(flat)
            self.script.add([script_of(t) for t in texts])
        return ids


def _table(path: str) -> WordTokens:
    """The worker's table, kept from task to task and begun anew when it is full."""
    table = held("quality_rules", path, lambda: WordTokens(path))
    if len(table.words) > MAX_WORDS:
        table.clear()
    return table


def repeated_words(ids: np.ndarray) -> int:
    """Words that stand in a 3-word window found twice or more, the first place included."""
    n = len(ids)
    if n < 4:
        return 0
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    if int(ids.max()) < PACKED:
        codes = (a << 42) | (b << 21) | c
    else:
        pairs = np.unique((a << 32) | b, return_inverse=True)[1]
        codes = (pairs << 32) | c
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    places = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[places + shift] = True
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def band_of(script: str, language: str | None, bands: Mapping[str, Band]) -> Band:
    """The band of script and language, else of the script; "en-GB" and "EN" are "en"."""
    base = re.split("[-_]", (language or "").strip().lower())[0]
    return bands.get(f"{script}-{base}") or bands.get(script) or bands["other"]


def figures(
    text: bytes | None, table: WordTokens, bands: Mapping[str, Band], language: str | None = None
) -> tuple:
    """The values of ``RESULT`` for one text."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        return 0, 0, symbols, 0, 0, 0, True, "none", None, None, None, False
    chars = len(text.translate(None, CONTINUATION + SPACE))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    ids = table.ids(words)
    repeats = repeated_words(ids)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n

    seen, counts = np.unique(ids, return_counts=True)
    script_words = np.bincount(table.script.values[seen], counts, len(SCRIPTS))[:-1]
    script = SCRIPTS[int(script_words.argmax())] if script_words.any() else "none"
    lengths = table.n_tokens.values[seen].astype(np.int64)
    n_tokens = int((lengths * counts).sum())
    if n_tokens:
        tokens = table.tokens.values[ragged(table.start.values[seen], lengths)]
        weights = np.bincount(tokens, np.repeat(counts, lengths))
        weights = weights[weights > 0]
        entropy = float(np.log2(n_tokens) - (weights * np.log2(weights)).sum() / n_tokens)
        per_token = chars / n_tokens
        byte_share = float((table.n_bytes.values[seen] * counts).sum()) / n_tokens
        band = band_of(script, language, bands)
        inside = (
            band.min_chars_per_token <= per_token <= band.max_chars_per_token
            and byte_share <= band.max_byte_share
            and (n < ENTROPY_WORDS or entropy >= band.min_entropy)
        )
    else:
        entropy = per_token = byte_share = None
        inside = False
    return (
        n, chars, symbols, duplicate_lines(text), repeats, n_tokens, failed, script,
        per_token, byte_share, entropy, inside and not failed,
    )


def judge(
    docs: DataFrame,
    text: str = "text",
    vocabulary: str | None = None,
    bands: Mapping[str, Band] = BANDS,
    keep: list[str] | None = None,
    language: str | None = "lang",
) -> DataFrame:
    """(row, out): the columns ``keep`` of each row (all by default) and its figures and verdict.

    ``language`` names the column of language codes; without such a column, and where a
    code is null or has no band, the band of the script holds.
    A null or empty text, or one without words, has no figures and is not kept.
    Every row is judged for itself: repeated rows, ties and null keys change nothing,
    an empty table gives an empty one, and columns named like a result stay in ``row``.
    """
    path, table_of_bands = vocabulary or vocabularies.public_path("piece_bpe_32k.model"), dict(bands)

    def kernel():
        def work(texts: list[bytes | None], languages: list[str | None] | None = None) -> dict[str, pa.Array]:
            table = _table(path)
            pairs = zip(texts, languages or [None] * len(texts), strict=True)
            made = list(zip(*(figures(t, table, table_of_bands, own) for t, own in pairs), strict=True))
            return {
                f.name: pa.array(values, ARROW[f.dataType.simpleString()])
                for f, values in zip(RESULT.fields, made, strict=True)
            }

        return work

    told = column(language).cast("string") if language in docs.columns else None
    return per_text(docs, text, kernel, RESULT, keep, told)
