"""Chat formatting: a visitor over typed content parts.

A turn's content is a list of parts: text, image, audio or document.  The visitor
walks them in order and appends escaped text or a placeholder; for each placeholder
it records the attachment's reference, its place and how many tokens the placeholder
stands for.  Neighbouring text parts are one text and are escaped as one, so no control
string can be put together from pieces; a text that spells a placeholder is escaped, so
what reads as a placeholder is one.  Turns are rendered one by one, so a conversation of any length streams
through; its formatted text is the turns' renderings in order.

Control strings inside roles and texts are escaped with a backslash and come back
unchanged: every backslash is doubled, and one is put after the first character of
each control string.  The loss mask is a list of [start, end) character spans, one for
each text; placeholders are not under it.

Results for edge cases: a null text or part list is empty; a null role is ''; null
turns come first, equal turns are ordered by role and text; rows of a null conv_id
form one conversation (in one task, as any other: a conversation is one running hash); an unknown part type raises ``ValueError``; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import pieces

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Control strings of this template and of other public chat templates.
CONTROL = (OPEN, CLOSE, *PLACEHOLDERS.values(), "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPED = re.compile("|".join(re.escape(c) for c in ("\\", *CONTROL)))
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_PLACEHOLDER = re.compile("(" + "|".join(map(re.escape, PLACEHOLDERS.values())) + ")")
_KINDS = {v: k for k, v in PLACEHOLDERS.items()}

PART_SCHEMA = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Roles whose text the loss covers.
LOSS_ROLES = frozenset({"assistant"})


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if text else text


def unescape(text: str) -> str:
    # A doubled backslash matches as an escape of the second one.
    return _ESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


@dataclass
class Expansion:
    """Tokens that a placeholder stands for."""

    patch: int = 14
    audio_per_second: float = 25.0
    per_page: int = 256

    def image(self, part: dict) -> int:
        return -(-(part.get("width") or 0) // self.patch) * -(-(part.get("height") or 0) // self.patch)

    def audio(self, part: dict) -> int:
        return int(-(-(part.get("seconds") or 0.0) * self.audio_per_second // 1))

    def document(self, part: dict) -> int:
        return (part.get("pages") or 0) * self.per_page


@dataclass
class Rendering:
    """What the visitor has written of one turn."""

    text: list[str] = field(default_factory=list)
    length: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def put(self, piece: str) -> None:
        self.text.append(piece)
        self.length += len(piece)


class Visitor:
    """Flattens the parts of one turn."""

    def __init__(self, expansion: Expansion | None = None, learn: bool = False):
        self.expansion = expansion or Expansion()
        self.learn = learn
        self.out = Rendering()
        self.texts: list[str] = []  # neighbouring text parts that are not written yet

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        method: Callable[[dict], None] | None = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown part type {kind!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def finish_text(self) -> None:
        start = self.out.length
        self.out.put(escape("".join(self.texts)))
        self.texts = []
        if self.learn and self.out.length > start:
            self.out.loss.append((start, self.out.length))

    def _attach(self, kind: str, part: dict) -> None:
        self.finish_text()
        count = getattr(self.expansion, kind)(part)
        self.out.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.out.length, "tokens": count})
        self.out.put(PLACEHOLDERS[kind])

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)


def render_turn(role: str | None, parts: list[dict] | None, expansion: Expansion | None = None) -> Rendering:
    visitor = Visitor(expansion, role in LOSS_ROLES)
    visitor.out.put(f"{OPEN}{escape_role(role or '')}\n")
    for part in parts or []:
        visitor.visit(part)
    visitor.finish_text()
    visitor.out.put(CLOSE + "\n")
    return visitor.out


def parse_turn(text: str) -> tuple[str, list[dict]]:
    """Role and typed parts of one rendered turn: each text unescaped, each placeholder by its type."""
    if not (text.startswith(OPEN) and text.endswith(CLOSE + "\n")):
        raise ValueError("not a rendered turn")
    inner, at = text[len(OPEN) : -len(CLOSE) - 1], 0
    while inner[at] != "\n":
        at += 2 if inner[at] == "\\" else 1
    found = [p for p in _PLACEHOLDER.split(inner[at + 1 :]) if p]
    return unescape(inner[:at]), [{"type": _KINDS[p]} if p in _KINDS else {"type": "text", "text": unescape(p)} for p in found]


def plain_text(parts: list[dict]) -> str:
    """Texts in order, with placeholders where the other parts stand."""
    return "".join(p["text"] if p["type"] == "text" else PLACEHOLDERS[p["type"]] for p in parts)


RENDERED = "conv_id long, turn long, position long, formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<kind:string,ref:string,at:long,tokens:long>>"


def format_turns(df: DataFrame, expansion: Expansion | None = None) -> DataFrame:
    """One rendered row for each turn, in order within each partition.

    ``df`` has conv_id, turn, role and either ``text`` or ``parts`` (PART_SCHEMA).
    All rows of a conversation are in one partition and follow each other there.
    """
    if "parts" in df.columns:
        parts = F.col("parts").cast(PART_SCHEMA)
        order = F.to_json("parts")
    else:
        parts = F.lit(None).cast(PART_SCHEMA)
        order = F.col("text").cast("string")
    text = F.lit(None).cast("string") if "parts" in df.columns else F.col("text").cast("string")
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), text.alias("text"), parts.alias("parts"), order.alias("order"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "order").drop("order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = run  # no conv_id is this
        position = 0
        for batch in pieces(batches, "text"):
            out: dict[str, list] = {k: [] for k in ("conv_id", "turn", "position", "formatted", "loss", "attachments")}
            for conv, turn, role, plain, typed in zip(*(c.to_pylist() for c in batch.columns)):
                position = position + 1 if conv == current else 0
                current = conv
                made = render_turn(role, typed if typed is not None else [{"type": "text", "text": plain}], expansion)
                for key, value in (
                    ("conv_id", conv), ("turn", turn), ("position", position), ("formatted", "".join(made.text)),
                    ("loss", [{"start": a, "end": b} for a, b in made.loss]), ("attachments", made.attachments)
                ):
                    out[key].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_ARROW)

    return rows.mapInArrow(run, RENDERED)


_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("turn", pa.int64()),
        ("position", pa.int64()),
        ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))),
    ]
)


def conversation_digests(rendered: DataFrame) -> DataFrame:
    """Reads formatted turns back: digests of turns and of the text under the loss mask.

    ``rendered`` is what ``format_turns`` returns, in its order; one running hash for
    each conversation, so no conversation is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state: list | None = None

        def closed(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*[[c, n, t.hexdigest(), k, h.hexdigest(), f] for c, n, t, k, h, f in rows]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=names)

        for batch in pieces(batches, "formatted"):
            done: list[list] = []
            for conv, position, text, loss in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "position", "formatted", "loss"))):
                if position == 0:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, parts = parse_turn(text)
                state[1] += 1
                state[2].update(f"{role}\n{plain_text(parts)}\n".encode())
                for span in loss:
                    learnt = unescape(text[span["start"] : span["end"]])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(text)
            if done:
                yield closed(done)
        if state is not None:
            yield closed([state])

    return rendered.select("conv_id", "position", "formatted", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
