"""Ranges over stated tool versions: any number of parts, explicit comparisons only.

A version is numbers between dots, missing ones read 0, with an optional tag behind a
hyphen that sorts below its release; tags compare as text.  A range is bounds between
commas that all hold.  A tagged version is in a range only if a bound names a tag of
the same numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_PARTS = re.compile(r"([0-9]+(?:\.[0-9]+)*)(?:-(.+))?\Z", re.DOTALL)
_BOUND = re.compile(r"(>=|<=|>|<|=)(.*)\Z", re.DOTALL)


class RangeError(ValueError):
    """What is wrong with a range: ``kind`` is Empty, MissingComparison or UnorderableBound."""

    def __init__(self, kind: str, bound: str = ""):
        super().__init__(f"{kind}: {bound}" if bound else kind)
        self.kind, self.bound = kind, bound


@dataclass(frozen=True)
class ToolVersion:
    numbers: tuple[int, ...]
    tag: str | None = None

    @staticmethod
    def parse(text: str) -> ToolVersion | None:
        """Null for what has no order; build data behind a plus is left out."""
        found = _PARTS.match(text.split("+", 1)[0])
        if not found or any(int(n) >= 1 << 64 for n in found[1].split(".")):
            return None
        numbers = [int(n) for n in found[1].split(".")]
        while numbers and not numbers[-1]:
            numbers.pop()
        return ToolVersion(tuple(numbers), found[2])

    def order(self) -> tuple:
        return self.numbers, self.tag is None, self.tag or ""


@dataclass(frozen=True)
class ToolRange:
    bounds: tuple[tuple[str, ToolVersion], ...]

    @staticmethod
    def parse(text: str) -> ToolRange:
        bounds = []
        for piece in filter(None, map(str.strip, text.split(","))):
            found = _BOUND.match(piece)
            if not found:
                raise RangeError("MissingComparison", piece)
            version = ToolVersion.parse(found[2].strip())
            if version is None:
                raise RangeError("UnorderableBound", piece)
            bounds.append((found[1], version))
        if not bounds:
            raise RangeError("Empty")
        return ToolRange(tuple(bounds))

    def matches(self, version: ToolVersion) -> bool:
        if version.tag is not None and not any(b.tag is not None and b.numbers == version.numbers for _, b in self.bounds):
            return False
        at = version.order()
        holds = {">": lambda b: at > b, ">=": lambda b: at >= b, "<": lambda b: at < b, "<=": lambda b: at <= b, "=": lambda b: at == b}
        return all(holds[comparison](b.order()) for comparison, b in self.bounds)
