"""Token counts by overlap resynchronisation.

A text of up to ``chunk`` characters is one chunk.  A longer one is cut into chunks
that overlap, and each goes through the library with offsets.  Two neighbours are
spliced at a border that both encodings have in their overlap and that is proven
stable; the left one's tokens before it and the right one's after it are those of
the whole text.  Where the left chunk has no stable border in the overlap, the overlap
widens back to its last one; where it has none at all, the chunk grows.

Why a border is proven.  The library takes special strings out, composes (NFC), puts a
blank for white space, lower-cases each character and scans from left to right
without looking back.  Say that the left chunk starts at a border.  Then a place is a
border of the whole text if (1) a match of the left chunk's scanner starts there, (2) ``GUARD``
more characters follow in that chunk, so that the scanner and special strings, which look
no further, saw all they look at, and (3) its character never composes with one
before it (a normalisation boundary).  If a match of the right chunk's scanner
starts there, too, then that chunk goes on as the whole text does.

Memory: the encoding of one chunk.  A chunk grows only within a run that the scanner
does not split: letters (of any script) without blank, digit or mark, or marks alone.
Such a run is one word of the tokenizer, which the library has to merge whole, too.

Words of one-chunk texts are looked up in a worker-wide cache bounded in bytes; blanks are
borders by the reasons above, and so is an ASCII letter's end before ASCII marks.

Results for edge cases: a null or empty text has 0 bytes and 0 tokens; repeated
rows give repeated rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import as_binary, map_arrow
from keyspan.llm.segments import LOOKUP_BYTES, SegmentCache, tokenizer

#: Characters in a chunk and in a first overlap.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
GUARD = 64

_LETTERS_THEN_MARKS = re.compile(rb"([A-Za-z]+)([!-/:-@\[-`{-~]+)")


class Encoder:
    """The library's tokenizer, and counts of words that a worker remembers."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.parts = SegmentCache(self._counts)
        self.words = SegmentCache(self._compose)
        self.words.known = self.parts.known  # a word of one part is that part
        #: Characters of the longest chunk so far.
        self.peak = 0

    def _counts(self, words: list[bytes]) -> list[int]:
        """Joined by blanks, in one call with offsets."""
        if not words:
            return []
        texts = [w.decode() for w in words]
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts = np.array([a for a, _ in self.library.encode(" ".join(texts), add_special_tokens=False).offsets], np.int64)
        return np.diff(np.searchsorted(starts, ends), prepend=0).tolist()

    def _compose(self, words: list[bytes]) -> list[int]:
        cut = [_LETTERS_THEN_MARKS.fullmatch(w) for w in words]
        lists = [[w] if m is None else list(m.groups()) for w, m in zip(words, cut)]
        values = self.parts.values([p for x in lists for p in x])
        bounds = np.cumsum([0, *map(len, lists)]).tolist()
        return [sum(values[a:b]) for a, b in zip(bounds, bounds[1:])]

    def short(self, texts: list[bytes]) -> list[int]:
        """Counts of whole texts of one chunk each."""
        lists = [t.split() for t in texts]  # of bytes: ASCII white space only
        values = self.words.values([w for words in lists for w in words])
        bounds = np.cumsum([0, *map(len, lists)]).tolist()
        return [sum(values[a:b]) for a, b in zip(bounds, bounds[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One for each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_COMPOSING: set[str] = set()


def composing() -> set[str]:
    """Characters that may compose or reorder with one before them, or that become several, among which a match may start."""
    if not _COMPOSING:
        found = {chr(o) for o in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # vowels and finals of Hangul
        for o in range(0x110000):
            ch = chr(o)
            if unicodedata.combining(ch) or len(ch.lower()) > 1:
                found.add(ch)
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and not parts[0].startswith("<"):
                found.add(chr(int(parts[1], 16)))
            if parts and not parts[0].startswith("<") and len(unicodedata.normalize("NFC", ch)) > 1:
                found.add(ch)
        _COMPOSING.update(found)
    return _COMPOSING


class Chunk:
    """The library's encoding of ``text[begin:end]`` with places in the whole text."""

    def __init__(self, encoder: Encoder, text: str, begin: int, end: int):
        self.text, self.begin, self.end = text, begin, end
        encoder.peak = max(encoder.peak, end - begin)
        found = encoder.library.encode(text[begin:end], add_special_tokens=False)
        self.size = len(found)
        groups = [-1 - i if g is None else g for i, g in enumerate(found.word_ids)]  # a special string is a word of its own
        #: Token number of each word's first token, by the word's place.
        self.borders = {begin + o[0]: i for i, (o, g, before) in enumerate(zip(found.offsets, groups, [None, *groups])) if g != before}

    def stable(self, low: int) -> list[int]:
        """Proven borders from ``low`` on, ascending; the chunk's first place, where it starts, is none of them."""
        never = composing()
        return [b for b in self.borders if max(low, self.begin + 1) <= b <= self.end - GUARD and self.text[b] not in never]


def spliced_count(encoder: Encoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text``, from chunks that are spliced at stable borders."""
    length = len(text)
    left, first, total = Chunk(encoder, text, 0, min(length, chunk)), 0, 0
    start = 0  # the left chunk counts from this border on, its token number ``first``
    while left.end < length:
        wide, cut = overlap, None
        borders = left.stable(start + 1)
        while borders and cut is None:
            # As far back as the overlap, and so far that it has the left chunk's last border.
            begin = max(start + 1, min(left.end - wide, borders[-1] - overlap))
            right = Chunk(encoder, text, begin, min(length, begin + max(chunk, 2 * (left.end - begin))))
            cut = next((b for b in borders if b > begin and b in right.borders), None)
            if cut is None:
                if begin == start + 1:
                    break
                wide = 4 * max(wide, left.end - begin)
        if cut is None:
            left = Chunk(encoder, text, start, min(length, start + 4 * (left.end - start)))
            first = 0
        else:
            total += left.borders[cut] - first
            left, first, start = right, right.borders[cut], cut
    return total + left.size - first


def token_counts(
    df: DataFrame, vocabulary: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text, without special tokens added."""

    def make():
        encoder = encoder_of(vocabulary)

        def work(batch: pa.RecordBatch) -> dict:
            raw = [t or b"" for t in as_binary(batch.column(1)).to_pylist()]
            long = {i: text for i, t in enumerate(raw) if len(t) > chunk and len(text := t.decode()) > chunk}
            counts = encoder.short([b"" if i in long else t for i, t in enumerate(raw)])
            for i, text in long.items():
                counts[i] = spliced_count(encoder, text, chunk, overlap)
            return {"id": batch.column(0), "n_bytes": [len(t) for t in raw], "n_tokens": counts}

        return work

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    counted = map_arrow(rows, make, "id long, n_bytes long, n_tokens long", "text", LOOKUP_BYTES)
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
