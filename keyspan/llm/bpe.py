"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokenisation without a regular expression: every code point becomes a class
(a table lookup; contractions and the end of a white-space run are seen by
comparing shifted arrays), every class is a function from scanner state to scanner
state, and functions compose associatively.  So a text of any length is scanned
in blocks side by side: compose each block, combine the blocks, then run all
blocks again from their now known first states.  A state before a class tells
whether a new token starts there.

Merging: new pieces are merged many at a time in one matrix (long pieces with a
heap), and each worker keeps a bounded cache of the results.

Results for edge cases: a null or empty text has no ids, its digests are those of
no bytes; repeated rows give repeated rows; columns other than id and text are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import as_binary, map_arrow
from keyspan.llm.segments import SegmentCache

#: Bytes that a worker's cache holds, and bytes of text encoded at once (some 40 bytes a character are held meanwhile).
#: Spark keeps idle workers beside an executor's heap while other stages run, so both are small.
ROOM, AT_ONCE = 64 << 20, 1 << 20

# Classes of code points as they stand in a text.
LETTER, DIGIT, OTHER, SHORT, LONG, BLANKS, LAST_SPACE, LAST_BLANK = range(8)
#: Added to the class of a text's first character: whatever stood before, a token starts.
FIRST = 8
# States of the scanner: within a run of letters, digits, others or blanks; after a
# space that joins what follows; with two or one characters of a contraction left;
# after a finished token.
IN_LETTERS, IN_DIGITS, IN_OTHERS, IN_BLANKS, AFTER_SPACE, TWO_LEFT, ONE_LEFT, DONE = range(8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """next state and 'a token starts here', both by [class, state]."""
    run = {LETTER: IN_LETTERS, DIGIT: IN_DIGITS, OTHER: IN_OTHERS, SHORT: IN_OTHERS, LONG: IN_OTHERS, BLANKS: IN_BLANKS}
    opens = {SHORT: ONE_LEFT, LONG: TWO_LEFT, LAST_SPACE: AFTER_SPACE, LAST_BLANK: DONE}
    follow = np.zeros((16, 8), np.uint8)
    starts = np.ones((16, 8), bool)
    for kind in range(8):
        for state in range(8):
            if state in (TWO_LEFT, ONE_LEFT):
                follow[kind, state], starts[kind, state] = (ONE_LEFT if state == TWO_LEFT else DONE), False
            elif kind in run and (state == run[kind] or state == AFTER_SPACE and kind != BLANKS):
                follow[kind, state], starts[kind, state] = run[kind], False
            else:
                follow[kind, state] = opens.get(kind, run.get(kind))
        follow[FIRST + kind] = follow[kind, DONE]
    return follow, starts


FOLLOW, STARTS = _tables()

_CLASSES: list[np.ndarray] = []


def code_point_classes() -> np.ndarray:
    """Class of each code point by itself: letter, digit, other, or blank (BLANKS)."""
    if not _CLASSES:
        category = unicodedata.category
        table = np.full(0x110000, OTHER, np.uint8)
        for o in range(0x110000):
            major = category(chr(o))[0]
            if major == "L":
                table[o] = LETTER
            elif major == "N":
                table[o] = DIGIT
        # The code points of Unicode's White_Space property.
        table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANKS
        _CLASSES.append(table)
    return _CLASSES[0]


def classes_in_place(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of a batch of joined texts; ``ends``: where each text ends."""
    kinds = code_point_classes()[points]
    n = len(points)
    if not n:
        return kinds
    last = np.zeros(n, bool)  # of its text
    last[ends[ends > 0] - 1] = True
    blank = kinds == BLANKS
    before_word = np.zeros(n, bool)
    before_word[:-1] = blank[:-1] & ~blank[1:] & ~last[:-1]
    kinds[before_word] = np.where(points[before_word] == 0x20, LAST_SPACE, LAST_BLANK)
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        ended = np.concatenate([last, np.ones(2, bool)])
        one, two = padded[marks + 1], padded[marks + 2]
        has_one = ~ended[marks]
        has_two = has_one & ~ended[marks + 1]
        short = has_one & np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(marks), bool)
        for a, b in ("re", "ve", "ll"):
            long |= has_two & (one == ord(a)) & (two == ord(b))
        kinds[marks[short]] = SHORT
        kinds[marks[long]] = LONG
    return kinds


def token_starts(kinds: np.ndarray, text_starts: np.ndarray, block: int = 256, window: int = 16) -> np.ndarray:
    """Mask of the places where a token starts; every text starts one."""
    n = len(kinds)
    if not n:
        return np.zeros(0, bool)
    flat = FOLLOW.reshape(-1)
    rows = -(-n // block)
    # Class k as the offset of its row in the table; what is added at the end starts a text.
    offsets = np.full(rows * block, (FIRST + OTHER) * 8, np.uint8)
    offsets[:n] = kinds * 8
    offsets[text_starts] += FIRST * 8
    columns = np.ascontiguousarray(offsets.reshape(rows, block).T)

    # Function of each block. A composition whose later part is constant is constant,
    # so the last ``window`` classes settle nearly every block; the others are composed whole.
    def composed(which: np.ndarray, since: int) -> np.ndarray:
        states = np.broadcast_to(np.arange(8, dtype=np.uint8)[:, None], (8, len(which)))
        for k in range(since, block):
            states = flat[columns[k, which] + states]
        return states

    everyone = np.arange(rows)
    whole = composed(everyone, max(0, block - window)).copy()
    open_ = np.flatnonzero((whole != whole[0]).any(0))
    if len(open_) and window < block:
        whole[:, open_] = composed(open_, 0)
    shift = 1
    while shift < rows:  # inclusive scan of the blocks' compositions
        later = whole.copy()
        later[:, shift:] = np.take_along_axis(whole[:, shift:], whole[:, :-shift].astype(np.intp), 0)
        whole, shift = later, shift * 2
    state = np.empty(rows, np.uint8)  # before each block
    state[0] = DONE
    state[1:] = whole[DONE, :-1]
    opens = STARTS.reshape(-1)
    found = np.empty((block, rows), bool)
    for k in range(block):
        at = columns[k] + state
        found[k] = opens[at]
        state = flat[at]
    return found.T.reshape(-1)[:n]


class Vocabulary:
    """Ranks of byte strings, the pairs that merge, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.single = np.zeros(256, np.int64)
        for b in range(256):
            self.single[b] = self.ranks[bytes([b])]
        pairs = {}
        for word, rank in self.ranks.items():
            for cut in range(1, len(word)):
                a, b = self.ranks.get(word[:cut]), self.ranks.get(word[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.pairs = pairs
        by_id = sorted((rank, word) for word, rank in self.ranks.items())
        self.id_lengths = np.zeros(by_id[-1][0] + 1, np.int64)
        for rank, word in by_id:
            self.id_lengths[rank] = len(word)
        self.id_starts = np.cumsum(self.id_lengths) - self.id_lengths
        self.id_bytes = np.frombuffer(b"".join(word for _, word in by_id), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, gathered from one table by offsets."""
        lengths = self.id_lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(self.id_starts[ids] - (ends - lengths), lengths) + np.arange(total)
        return self.id_bytes[places].tobytes()

    def decode_pieces(self, ids: np.ndarray, counts: np.ndarray, offsets: np.ndarray, total: int) -> bytes:
        """Bytes of ids, each piece put at its own offset.

        ``counts``: ids of each piece; ``offsets``: where each begins among ``total`` bytes. A piece
        whose ids do not fill its slice is a fault, so no wrong id shifts what follows.
        """
        lengths = self.id_lengths[ids]
        whole = np.concatenate([[0], np.cumsum(lengths)])
        firsts = np.concatenate([[0], np.cumsum(counts)])
        if not np.array_equal(np.diff(whole[firsts]), np.diff(np.append(offsets, total))):
            raise ValueError("ids do not fill the slices that they were made of")
        starts = np.repeat(offsets - whole[firsts[:-1]], counts) + whole[:-1]
        out = np.empty(total, np.uint8)
        within = np.arange(int(whole[-1])) - np.repeat(whole[:-1], lengths)
        out[np.repeat(starts, lengths) + within] = self.id_bytes[np.repeat(self.id_starts[ids], lengths) + within]
        return out.tobytes()


_NONE = np.int64(1 << 40)


class Merger:
    """Ids of pieces, remembered within a bound of bytes."""

    def __init__(self, vocabulary: Vocabulary, room: int = ROOM):
        self.vocabulary = vocabulary
        self.cache = SegmentCache(self._merged, room, 1 << 16)  # merged many at a time

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """For each piece its ids as little-endian unsigned 32-bit integers."""
        return self.cache.values(pieces)

    def _merged(self, fresh: list[bytes]) -> list[bytes]:
        known: dict[bytes, bytes] = {}
        self._learn(fresh, known)
        return [known[p] for p in fresh]

    def _learn(self, fresh: list[bytes], known: dict[bytes, bytes]) -> None:
        ranks = self.vocabulary.ranks
        by_length: dict[int, list[bytes]] = {}
        for piece in fresh:
            rank = ranks.get(piece)
            if rank is not None:
                known[piece] = rank.to_bytes(4, "little")
            elif len(piece) > 64:
                known[piece] = np.array(self._long(piece), "<u4").tobytes()
            else:
                by_length.setdefault(len(piece), []).append(piece)
        for length, group in by_length.items():
            for k in range(0, len(group), 8192):
                part = group[k : k + 8192]
                known.update(zip(part, self._matrix(part, length), strict=True))

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = np.searchsorted(self.vocabulary.pair_keys, keys)
        at[at == len(self.vocabulary.pair_keys)] = 0
        return np.where(self.vocabulary.pair_keys[at] == keys, self.vocabulary.pair_ranks[at], _NONE)

    def _matrix(self, group: list[bytes], width: int) -> list[bytes]:
        """Merges pieces of one length side by side, one merge in each row a round."""
        parts = self.vocabulary.single[np.frombuffer(b"".join(group), np.uint8)].reshape(-1, width)
        lengths = np.full(len(group), width)
        scores = np.full((len(group), width), _NONE)  # of a part with the next
        scores[:, :-1] = self._pair_ranks(parts[:, :-1], parts[:, 1:])
        active = np.arange(len(group))
        done_parts = parts
        while len(active):
            rows_scores = scores[active]
            at = rows_scores.argmin(1)
            best = rows_scores[np.arange(len(active)), at]
            live = best < _NONE
            active, at, best = active[live], at[live], best[live]
            if not len(active):
                break
            columns = np.arange(width)
            source = columns[None, :] + (columns[None, :] > at[:, None])
            source[source >= width] = width - 1
            row = active[:, None]
            moved_parts, moved_scores = done_parts[row, source], scores[row, source]
            k = np.arange(len(active))
            moved_parts[k, at] = best
            lengths[active] -= 1
            size = lengths[active]
            moved_scores[columns[None, :] >= size[:, None] - 1] = _NONE
            right = np.where(at + 1 < size, self._pair_ranks(best, moved_parts[k, np.minimum(at + 1, width - 1)]), _NONE)
            moved_scores[k, at] = right
            left_at = np.maximum(at - 1, 0)
            left = self._pair_ranks(moved_parts[k, left_at], best)
            moved_scores[k, left_at] = np.where(at > 0, left, moved_scores[k, left_at])
            done_parts[active], scores[active] = moved_parts, moved_scores
        flat = done_parts.astype("<u4")
        return [flat[i, :n].tobytes() for i, n in enumerate(lengths.tolist())]

    def _long(self, piece: bytes) -> list[int]:
        """One long piece: a heap of mergeable neighbours over a linked list."""
        pairs = self.vocabulary.pairs
        parts = self.vocabulary.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, parts[i], parts[i + 1]) for i in range(n - 1) if (rank := pairs.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := pairs.get(rank << 32 | parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, parts[after[i]]))
            if before[i] >= 0 and (r := pairs.get(parts[before[i]] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, before[i], parts[before[i]], rank))
        return [p for p in parts if p >= 0]


_LOADED: dict[str, tuple[Vocabulary, Merger]] = {}


def loaded(path: str) -> tuple[Vocabulary, Merger]:
    if path not in _LOADED:
        _LOADED[path] = (vocabulary := Vocabulary(path), Merger(vocabulary))
    return _LOADED[path]


class Encoded(NamedTuple):
    """A batch of texts, encoded: ids of each, and its pieces with their offsets among the batch's bytes."""

    ids: list[bytes]
    pieces: list[bytes]
    offsets: np.ndarray
    of_text: tuple[np.ndarray, np.ndarray]  # first and last piece (exclusive) of each text
    ends: np.ndarray  # where each text ends

    def piece_offsets(self, k: int) -> np.ndarray:
        """Offsets of a text's pieces within it."""
        a, b = self.of_text[0][k], self.of_text[1][k]
        return self.offsets[a:b] - (self.ends[k - 1] if k else 0)


def encode_batch(texts: list[bytes], merger: Merger) -> Encoded:
    joined = b"".join(texts)
    points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
    widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64)
    byte_at = np.concatenate([[0], np.cumsum(widths)])
    text_ends = np.cumsum([len(t) for t in texts])
    ends = np.searchsorted(byte_at, text_ends)
    starts = np.concatenate([[0], ends[:-1]])
    filled = starts[starts < ends]
    mask = token_starts(classes_in_place(points, ends[ends > 0]), filled)
    at = np.flatnonzero(mask)
    offsets = byte_at[at]
    bounds = np.append(offsets, len(joined)).tolist()
    ids = merger.ids([joined[a:b] for a, b in zip(bounds, bounds[1:])])
    of_text = np.searchsorted(at, starts), np.searchsorted(at, ends)
    return Encoded([b"".join(ids[a:b]) for a, b in zip(*(x.tolist() for x in of_text))], ids, offsets, of_text, text_ends)


def decode_batch(made: Encoded, vocabulary: Vocabulary) -> list[bytes]:
    """The texts of a batch, from their ids and the offsets of their pieces."""
    ids = np.frombuffer(b"".join(made.ids), "<u4")
    counts = np.array([len(p) // 4 for p in made.pieces], np.int64)
    total = int(made.ends[-1]) if len(made.ends) else 0
    raw = vocabulary.decode_pieces(ids, counts, made.offsets, total)
    bounds = [0, *made.ends.tolist()]
    return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


def encode(df: DataFrame, ranks: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id column, ``ids`` (the text's token ids) and ``offsets`` (where its pieces begin, in bytes), as little-endian unsigned 32-bit integers."""

    def make():
        _, merger = loaded(ranks)

        def work(batch: pa.RecordBatch) -> dict:
            made = encode_batch([t or b"" for t in as_binary(batch.column(1)).to_pylist()], merger)
            return {"id": batch.column(0), "ids": made.ids, "offsets": [made.piece_offsets(k).astype("<u4").tobytes() for k in range(len(made.ids))]}

        return work

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(rows, make, "id long, ids binary, offsets binary", "text", AT_ONCE).withColumnRenamed("id", id_column)


def round_trip_digests(df: DataFrame, ranks: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """n_tokens, the digest of the ids and the digest of the bytes decoded from them (with ``with_ids``: and the ids)."""

    def make():
        vocabulary, merger = loaded(ranks)

        def work(batch: pa.RecordBatch) -> dict:
            made = encode_batch([t or b"" for t in as_binary(batch.column(1)).to_pylist()], merger)
            return {
                "id": batch.column(0),
                "n_tokens": [len(x) // 4 for x in made.ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in made.ids],
                "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decode_batch(made, vocabulary)],
                "ids": made.ids,
            }

        return work

    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return map_arrow(rows, make, schema, "text", AT_ONCE).withColumnRenamed("id", id_column)
