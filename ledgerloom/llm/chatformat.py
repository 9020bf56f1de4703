"""Chat formatting of messages with typed content parts.

A message holds parts: text, image, audio or document. A visitor turns each part into text: text is
escaped, an attachment becomes a numbered placeholder, and its reference, place and number of tokens it
expands to are recorded in order. A turn is written as

    <|turn|>role<|text|>content<|end|>

Control strings in roles and texts get a backslash after their first character, and a backslash is
doubled; reading takes both back. The loss mask covers the content of the assistant's turns.

The output has a row per turn, in the order of ``conv_id``, ``turn`` and the text of the turn; a conversation is
the concatenation of its turns. No step holds a conversation in memory, so one conversation may have any
number of turns; digests run over the sorted turns of a task.

Defined results: a null role or text is empty. A null part, or a part of an unknown kind, is left out.
Null turns come first; turns with the same number follow in text order, and repeated rows are turns of
their own. Rows with a null conv_id form one conversation. An empty table gives no conversation. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import slices, stored

# Strings that chat templates treat as control marks; fixed values.
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"

# Tokens an attachment expands to.
IMAGE_BASE, IMAGE_TILE, TILE_PIXELS = 85, 170, 512
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 600

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_SPECIAL = re.compile(r"\\|" + _CONTROL.pattern)
_ESCAPE = re.compile(r"\\(\\?)")
_PIECE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<kind:string,ref:string,at:bigint,tokens:bigint>"


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


@dataclass
class Flattened:
    text: str = ""
    attachments: list[dict] = field(default_factory=list)


class PartVisitor:
    """Flattens the parts of one message; a method per kind."""

    def __init__(self) -> None:
        self.out = Flattened()

    def visit(self, part: dict | None) -> None:
        method = getattr(self, f"visit_{(part or {}).get('kind')}", None)
        if method is not None:
            method(part)

    def visit_text(self, part: dict) -> None:
        self.out.text += escape(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        width, height = (max(1, part.get(side) or 1) for side in ("width", "height"))
        tiles = math.ceil(width / TILE_PIXELS) * math.ceil(height / TILE_PIXELS)
        self._attach(part, IMAGE_BASE + IMAGE_TILE * tiles)

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil(max(0.0, part.get("seconds") or 0.0) * AUDIO_TOKENS_PER_SECOND))

    def visit_document(self, part: dict) -> None:
        self._attach(part, max(0, part.get("pages") or 0) * DOCUMENT_TOKENS_PER_PAGE)

    def _attach(self, part: dict, tokens: int) -> None:
        self.out.attachments.append(
            {"kind": part["kind"], "ref": part.get("ref"), "at": len(self.out.text), "tokens": tokens}
        )
        self.out.text += f"<|{part['kind']}:{len(self.out.attachments)}|>"


def flatten(parts: list[dict]) -> Flattened:
    visitor = PartVisitor()
    for part in parts:
        visitor.visit(part)
    return visitor.out


_OUT = {
    "piece": pa.string(), "loss_start": pa.int64(), "loss_length": pa.int64(),
    "attachments": pa.list_(pa.struct(
        [("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]
    )),
}


def _format(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows: dict[str, list] = {name: [] for name in _OUT}
    for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist()):
        content = flatten(parts or [])
        head = TURN + escape(role or "") + TEXT
        rows["piece"].append(head + content.text + END)
        loss = role == ASSISTANT
        rows["loss_start"].append(len(head) if loss else None)
        rows["loss_length"].append(len(content.text) if loss else None)
        rows["attachments"].append(content.attachments)
    return pa.RecordBatch.from_arrays(
        [batch.column("conv_id"), batch.column("turn"), *(pa.array(rows[n], k) for n, k in _OUT.items())],
        names=["conv_id", "turn", *_OUT],
    )


def text_parts(text: Column) -> Column:
    """A message of plain text as its only part."""
    empty = {name: F.lit(None).cast(kind).alias(name) for name, kind in (
        ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *empty.values()))


def format_turns(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``parts`` as formatted turns with loss span and attachments."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in slices(part, 1024):
                yield _format(batch)

    rows = messages.select("conv_id", "turn", "role", F.col("parts").cast(f"array<{PART}>").alias("parts"))
    schema = rows.select("conv_id", "turn").schema.add("piece", "string")
    schema = schema.add("loss_start", "long").add("loss_length", "long")
    attachments = F.lit(None).cast(f"array<{ATTACHMENT}>").alias("attachments")
    schema = schema.add(messages.sparkSession.range(0).select(attachments).schema[0])
    return rows.mapInArrow(run, schema)


def read_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn, unescaped; placeholders stay."""
    found = _PIECE.fullmatch(piece)
    if found is None:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


class _Digest:
    """What is told of one conversation, turn by turn."""

    def __init__(self, conv_id) -> None:
        self.conv_id = conv_id
        self.turns, self.chars, self.loss = 0, 0, 0
        self.said, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int | None, length: int | None) -> None:
        role, text = read_piece(piece)
        self.turns += 1
        self.chars += len(piece)
        self.said.update(f"{role}\n{text}\n".encode())
        if start is not None:
            text = unescape(piece[start : start + length])
            self.loss += len(text)
            self.learned.update(text.encode())

    def row(self) -> tuple:
        return (
            self.conv_id, self.turns, self.said.hexdigest(), self.loss, self.learned.hexdigest(), self.chars,
        )


_TOLD = {
    "n_turns": ("long", pa.int64()), "turns_sha256": ("string", pa.string()),
    "loss_chars": ("long", pa.int64()), "loss_sha256": ("string", pa.string()),
    "formatted_chars": ("long", pa.int64()),
}


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Read formatted turns back and tell one row per conversation."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done, kind = None, [], None

        def pack() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * (1 + len(_TOLD))
            kinds = [kind, *(k for _, k in _TOLD.values())]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", *_TOLD]
            )

        for batch in parts:
            kind = batch.column("conv_id").type
            columns = ("conv_id", "piece", "loss_start", "loss_length")
            for conv_id, piece, start, length in zip(*(batch.column(c).to_pylist() for c in columns)):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(conv_id)
                current.add(piece, start, length)
            if done:
                yield pack()
                done = []
        if current is not None:
            done.append(current.row())
            yield pack()

    rows = turns.select("conv_id", "turn", "piece", "loss_start", "loss_length")
    schema = rows.select("conv_id").schema
    for name, (said, _) in _TOLD.items():
        schema = schema.add(name, said)
    return (
        rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece").mapInArrow(run, schema)
    )


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """Format all conversations, store the turns, and read the digests back from them."""
    messages = conversations.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    return conversation_digests(stored(format_turns(messages), "chat-turns"))
