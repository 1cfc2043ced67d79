r"""Chat formatting with typed content parts.

A visitor flattens a turn's parts in order: text is escaped, images, audio and documents become numbered
placeholders `<|image:0|>`, and their references and expanded token counts are recorded. A turn is
`### role: ` + content + `</turn>` + newline. Escaping puts a backslash before every backslash and every control
string (`###`, `</turn>`, `<|`, and `:` in a role) and is undone by dropping each backslash that starts a pair; so no
text can end a turn or start one. The loss mask lists the code point ranges of assistant contents.

A conversation's turns are sorted by (turn, role, text) within its partition and streamed: the output has one row
per conversation, and further rows (`chunk` 1, 2, ...) where one holds more than `CHUNK_CHARS`. Reading back streams
in the same way, so no conversation is collected, however long; its digest is sequential by nature.

Null text is empty, a null role too; a null conv_id is a conversation of its own. A null part counts as none; one of an
unknown or null kind becomes a placeholder `<|other:0|>` of 0 tokens. Turns that tie are ordered by role and text.
Repeated rows are turns like all others. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>"
CHUNK_CHARS = 1 << 20
LOSS_ROLE = "assistant"
#: Expanded tokens: an image's 28-pixel patches, 25 a second of audio, 512 a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512

ATTACHMENT = "struct<kind: string, ref: string, turn: int, offset: long, tokens: long>"
SCHEMA = f"conv_id long, chunk int, formatted string, n_turns int, loss array<struct<start: long, stop: long>>, attachments array<{ATTACHMENT}>, expanded_tokens long"
_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("chunk", pa.int32()),
        ("formatted", pa.string()),
        ("n_turns", pa.int32()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("turn", pa.int32()), ("offset", pa.int64()), ("tokens", pa.int64())]))),
        ("expanded_tokens", pa.int64()),
    ]
)
READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"

_CONTROL = re.compile(r"\\|###|</turn>|<\|")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|<\||:|\n")
_PAIR = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _PAIR.sub(r"\1", text)


@dataclass
class Flattener:
    """Visits parts in order; kinds of parts are methods."""

    turn: int = 0
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict[str, Any]] = field(default_factory=list)
    length: int = 0

    def visit(self, part: dict[str, Any] | None) -> None:
        if part is not None:
            visitors = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
            visitors.get(part.get("type"), self.visit_other)(part)

    def _put(self, s: str) -> None:
        self.pieces.append(s)
        self.length += len(s)

    def _attach(self, kind: str, part: dict[str, Any], tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "turn": self.turn, "offset": self.length, "tokens": tokens})
        self._put(f"<|{kind}:{len(self.attachments) - 1}|>")

    def visit_text(self, part: dict[str, Any]) -> None:
        self._put(escape(part.get("text") or ""))

    def visit_image(self, part: dict[str, Any]) -> None:
        self._attach("image", part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict[str, Any]) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * AUDIO_RATE))

    def visit_document(self, part: dict[str, Any]) -> None:
        self._attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)

    def visit_other(self, part: dict[str, Any]) -> None:
        """A part of a kind that has no visitor (or none): its place and reference are kept, its size is unknown."""
        self._attach("other", part, 0)


def flatten(parts: list[dict[str, Any]] | None, turn: int = 0) -> tuple[str, list[dict[str, Any]]]:
    """The content of a turn and its attachments; offsets count code points of the content."""
    f = Flattener(turn)
    for part in parts or []:
        f.visit(part)
    return "".join(f.pieces), f.attachments


@dataclass
class _Chunk:
    conv_id: int | None
    chunk: int = 0
    n_turns: int = 0
    turn: int = 0
    chars: int = 0
    pieces: list[str] = field(default_factory=list)
    loss: list[dict[str, int]] = field(default_factory=list)
    attachments: list[dict[str, Any]] = field(default_factory=list)

    def add(self, role: str | None, content: str, attachments: list[dict[str, Any]]) -> None:
        head = f"{OPEN}{escape(role or '', _ROLE_CONTROL)}: "
        start = self.chars + len(head)
        if role == LOSS_ROLE:
            self.loss.append({"start": start, "stop": start + len(content)})
        self.attachments += [a | {"offset": a["offset"] + start} for a in attachments]
        piece = f"{head}{content}{CLOSE}\n"
        self.pieces.append(piece)
        self.chars, self.n_turns, self.turn = self.chars + len(piece), self.n_turns + 1, self.turn + 1

    def row(self) -> dict[str, Any]:
        return {"conv_id": self.conv_id, "chunk": self.chunk, "formatted": "".join(self.pieces), "n_turns": self.n_turns, "loss": self.loss, "attachments": self.attachments, "expanded_tokens": sum(a["tokens"] for a in self.attachments)}


def _in_order(turns: DataFrame, *order: str) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_turns(turns: DataFrame) -> DataFrame:
    """Formatted conversations, from rows with conv_id, turn, role and either text or `parts`, an array of structs
    with type (text, image, audio, document) and what that kind has: text, ref, width, height, seconds, pages."""
    typed = "parts" in turns.columns
    content = F.col("parts") if typed else F.coalesce("text", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", content.alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready, chars = None, [], 0
        for batch in batches:
            for conv, role, content in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "content"))):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        ready.append(now.row())
                    now = _Chunk(conv)
                elif now.chars >= CHUNK_CHARS:
                    ready.append(now.row())
                    now = _Chunk(conv, now.chunk + 1, turn=now.turn)
                text, attachments = flatten(content if typed else [{"type": "text", "text": content}], now.turn)
                now.add(role, text, attachments)
                chars += len(text)
                if chars > 4 * CHUNK_CHARS and ready:
                    yield pa.RecordBatch.from_pylist(ready, _ARROW)
                    ready, chars = [], 0
        if now is not None:
            ready.append(now.row())
        if ready:
            yield pa.RecordBatch.from_pylist(ready, _ARROW)

    return _in_order(rows, "turn", "role", "content").mapInArrow(run, SCHEMA)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, content still escaped, start, stop) of each turn; ValueError if anything else stands there."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = unescape(m[1])
        out.append((role, m[2], m.start(2), m.end(2)))
        at = m.end()
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted text and the loss mask alone."""
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(v, pa.string() if n.endswith("sha256") else pa.int64()) for n, v in zip(names, zip(*out))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[Any] | None = None

        def done(s: list[Any]) -> tuple:
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6], s[7])

        for batch in batches:
            out = []
            for conv, text, loss, attached, tokens in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss", "attachments", "expanded_tokens"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(done(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, content, _, _ in parse(text):
                    state[2].update(f"{role}\n{unescape(content)}\n".encode())
                    state[1] += 1
                for span in loss:
                    plain = unescape(text[span["start"] : span["stop"]])
                    state[3] += len(plain)
                    state[4].update(plain.encode())
                state[5] += len(text)
                state[6] += len(attached)
                state[7] += tokens
            if out:
                yield rows(out)
        if state is not None:
            yield rows([done(state)])

    return _in_order(formatted.select("conv_id", "chunk", "formatted", "loss", "attachments", "expanded_tokens"), "chunk").mapInArrow(run, READ_SCHEMA)
