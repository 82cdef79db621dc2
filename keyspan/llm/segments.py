"""Tokenizer-library calls with a bounded cache of context-free segments.

A pre-tokenizing BPE never lets a token cross certain places, so what the library
returns for a whole text is the concatenation of what it returns for the segments
between them.  Texts repeat their segments, so what the library returned for one is
remembered by the worker, within a bound of bytes.
"""

from __future__ import annotations

import os
import re

#: Bytes of text whose segments are looked up at once: as much as a processor's cache holds.
LOOKUP_BYTES = 256 << 10
#: Bytes that a cache holds, what an entry takes beside its contents, and the longest segment kept.
ROOM, ENTRY_BYTES, LONGEST = 256 << 20, 180, 64

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer of a file, once per worker and on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
    return _LOADED[path]


class SegmentCache:
    """segment -> value, where ``encode`` gives the values (bytes, or whole numbers) of many new segments.

    What is held is bounded in bytes: segments of more than ``LONGEST`` characters are
    encoded each time, and where the bound is passed the shorter half stays, since short
    segments come up again.
    """

    def __init__(self, encode, room: int = ROOM, at_once: int = 4096):
        self.encode, self.room, self.at_once, self.known, self.held = encode, room, at_once, {}, 0

    def _remember(self, made: dict) -> None:
        new = {s: v for s, v in made.items() if len(s) <= LONGEST}
        self.known.update(new)
        self.held += _weight(new)
        if self.held > self.room:
            kept = sorted(self.known, key=len)[: len(self.known) // 2]
            self.known = {s: self.known[s] for s in kept}
            self.held = _weight(self.known)

    def values(self, segments: list) -> list:
        """The value of each segment, in order."""
        found = list(map(self.known.get, segments))
        if None in found:
            fresh = list({s for s, v in zip(segments, found) if v is None})
            made: dict = {}
            for k in range(0, len(fresh), self.at_once):
                part = fresh[k : k + self.at_once]
                made.update(zip(part, self.encode(part), strict=True))
            found = [made[s] if v is None else v for s, v in zip(segments, found)]
            self._remember(made)
        return found


def _weight(entries: dict) -> int:
    """Bytes that entries take, about: both objects' heads, their contents and their place in the table."""
    return ENTRY_BYTES * len(entries) + sum(map(len, entries)) + sum(len(v) for v in entries.values() if type(v) is bytes)


#: Places that are token borders of the byte-level pattern whatever stands around
#: them: before a blank that a non-blank follows, on both sides of other white space, and
#: between a letter (of ASCII or Latin-1) and an ASCII punctuation mark.
BYTE_LEVEL_SEGMENT = re.compile(
    r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]++(?=[\s!-/:-@\[-`{-~]|\Z)"
    r"|[!-/:-@\[-`{-~]++(?=\s|\Z)"
    r"| ?\S++|\s+(?=\s\S)|\s+"
)

#: Python counts these as white space, the tokenizers' patterns do not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def added_strings(library) -> list[str]:
    """The strings that the library takes out of a text before all else, the longest first."""
    return sorted((t.content for t in library.get_added_tokens_decoder().values() if t.content), key=len, reverse=True)


def parts_of(text: str, added: list[str]) -> list[str]:
    """A text cut on both sides of each added string."""
    if not any(a in text for a in added):
        return [text]
    return [p for p in re.split("(" + "|".join(map(re.escape, added)) + ")", text) if p]


def byte_level_segments(text: str) -> list[str]:
    """Segments whose encodings, concatenated, are the encoding of a text without added strings."""
    if text[:1] == " " and text.isascii() and text[1:].isalpha():
        return [text]  # a blank and a word
    return [text] if _SEPARATORS.search(text) else BYTE_LEVEL_SEGMENT.findall(text)


#: A blank before another white space, where it may be no border.
_ODD_BLANKS = [" " + chr(o) for o in range(0x3001) if chr(o).isspace()]
_BLANK_BORDER = re.compile(r"(?= \S)")


def blank_segments(text: str) -> list[str]:
    """Longer segments, cut before each blank that a non-blank follows: quick to find."""
    if "\0" in text or text.endswith(" ") or any(odd in text for odd in _ODD_BLANKS):
        return _BLANK_BORDER.split(text)
    return text.replace(" ", "\0 ").split("\0")
