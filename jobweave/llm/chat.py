"""Chat formatting with typed content parts."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
PARTS = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<place:int,type:string,uri:string,tokens:long>>"
#: Tokens that a placeholder stands for: per tile of an image, second of audio, page of a document.
TILE, IMAGE_TILE_TOKENS, AUDIO_SECOND_TOKENS, PAGE_TOKENS = 28, 1, 25, 768


def escape(text: str) -> str:
    """Text in which no control string can begin, and from which it can be had back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


class Flattener:
    """Visits the parts of a turn: text is escaped, everything else becomes a numbered placeholder.

    Neighbouring texts are one text before they are escaped, so that no control
    string can arise where two of them meet.
    """

    def __init__(self) -> None:
        self.out: list[str] = []
        self.texts: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        kind = (part or {}).get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_unknown)(part or {})

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def body(self) -> str:
        self.out.append(escape("".join(self.texts)))
        self.texts.clear()
        return "".join(self.out)

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or 0) / TILE) * math.ceil((part.get("height") or 0) / TILE)
        self.attach("image", part, max(1, tiles) * IMAGE_TILE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * AUDIO_SECOND_TOKENS)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, part.get("pages") or 0) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"content part of unknown type {part.get('type')!r}")

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        place = len(self.attachments)
        self.out.append(escape("".join(self.texts)) + f"<|{kind}:{place}|>")
        self.texts.clear()
        self.attachments.append({"place": place, "type": kind, "uri": part.get("uri"), "tokens": tokens})


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, list[int], list[dict]]:
    """A turn in the template, the code points [first, end) under the loss mask, and its attachments.

    Only an assistant's content is under the mask, without the turn's marks.
    """
    visitor = Flattener()
    for part in parts or []:
        visitor.visit(part)
    head, body = f"{START}{escape_role(role or '')}\n", visitor.body()
    loss = [len(head), len(head) + len(body)] if role == "assistant" else [0, 0]
    return f"{head}{body}{END}\n", loss, visitor.attachments


def read_back(formatted: str) -> list[tuple[str, str, list[tuple[str, int]]]]:
    """Role, text and placeholders of each turn in formatted output; the inverse of ``format_turn``."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn starts at {at}")
        at = m.end()
        marks = [(p[1], int(p[2])) for p in PLACEHOLDER.finditer(m[2])]
        out.append((unescape_role(m[1]), unescape(PLACEHOLDER.sub("", m[2])), marks))
    if at != len(formatted):
        raise ValueError(f"no turn starts at {at}")
    return out


def format_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [format_turn(r, p) for r, p in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True)]
        rows = {"conv_id": batch.column("conv_id"), "turn": batch.column("turn")}
        rows |= {"formatted": [d[0] for d in done], "loss_first": [d[1][0] for d in done], "loss_end": [d[1][1] for d in done]}
        rows |= {"attachments": [d[2] for d in done], "expanded_tokens": [sum(a["tokens"] for a in d[2]) for d in done]}
        yield pa.RecordBatch.from_pydict(rows, schema=schema)


def format_conversations(turns: DataFrame) -> DataFrame:
    """A row per turn (conv_id, turn, role, parts) in the chat template; a conversation is its turns' rows in order.

    Returns conv_id, turn, formatted, loss_first and loss_end (code points of
    ``formatted`` under the loss mask), attachments and expanded_tokens (what the
    placeholders stand for in all). A turn never needs another one, so a long
    conversation is not gathered anywhere. A null role is the empty one, null
    parts and texts are empty; a part of an unknown type is an error. Columns
    other than the four are dropped.
    """
    schema = (
        f"conv_id long, turn long, formatted string, loss_first long, loss_end long, attachments {ATTACHMENTS}, expanded_tokens long"
    )
    attachment = pa.struct([("place", pa.int32()), ("type", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())])
    arrow = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss_first", pa.int64()),
         ("loss_end", pa.int64()), ("attachments", pa.list_(attachment)), ("expanded_tokens", pa.int64())]
    )
    chosen = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("parts").cast(PARTS)
    )
    return chosen.mapInArrow(lambda b: format_batches(b, arrow), schema)


def text_parts(text: str = "text"):
    """The one text part of a plain turn."""
    nothing = {n: F.lit(None).cast(t) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *(c.alias(n) for n, c in nothing.items())))


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of whole conversations, read back from their formatted turns, which come in order.

    One conversation's running hashes are all that is held.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]
    conv, state = None, None

    def row():
        return [conv[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]]

    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_first", "loss_end", "expanded_tokens"))
        for c, formatted, first, end, tokens in zip(*columns, strict=True):
            if conv != (c,):
                if conv is not None:
                    out.append(row())
                conv, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, text, marks in read_back(formatted):
                state[0] += 1
                state[5] += len(marks)
                state[1].update(f"{role}\n{text}\n".encode())
            loss = unescape(PLACEHOLDER.sub("", formatted[first:end]))
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += len(formatted)
            state[6] += tokens
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) if x is None else pa.array([x]) for x in row()], names=names)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments and expanded_tokens.

    All but the last are read back from formatted turns; that is the number of
    tokens that the placeholders stand for.

    Turns go by number, null first; equal numbers by their formatted text. A hash
    over a conversation is one chain, so a conversation is read by one task, turn
    by turn, without being held.
    """
    return (
        formatted.select("conv_id", "turn", "formatted", "loss_first", "loss_end", "expanded_tokens")
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
        .mapInArrow(
            digests,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
            "n_attachments long, expanded_tokens long",
        )
    )
