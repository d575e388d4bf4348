"""Chat formatting: conversations of typed content parts as one marked text.

A message's content is a text, or an array of parts (``PART``) of type text,
image, audio or document. A visitor flattens the parts in their order: texts are
escaped, every attachment becomes a placeholder, and its reference, its place in
the formatted text and the number of tokens that it expands to are recorded.

Template, by role: ``[SYS] t [/SYS]``, ``[INST] t [/INST]``, ``<s>t</s>`` for the
assistant, ``[TURN]role[MSG] t [/TURN]`` for any other. Control strings inside a
text are broken: a backslash is doubled, and a control string gets ``\\.`` after
its first character, which is undone by reading from the left. No control string
begins inside another, so an escaped text holds none, wherever it is cut.

Messages are formatted where they lie. Conversations are then dealt by their id
and sorted, and their chunks leave one by one: a conversation is one row unless
it is longer than ``chunk`` characters, then several, cut between turns, with
offsets that go on. So no task holds more than a chunk of a conversation, even
of one with a third of all rows; its turns do pass through one task in order,
as a digest over them needs.

The loss mask is a list of spans (offsets in the formatted text): the text of
every assistant part, neither markers nor placeholders.

Defined results: null text, content, part, type or reference count as empty,
nothing, a skipped part, a file, and an empty reference; sizes that are null or
not positive make the least expansion of 1 token; a null role is ''; rows without
a conversation id make one conversation with a null id; equal turns are ordered
by role, then formatted text; repeated rows are turns of their own; other columns are left
behind; an empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Characters after which a conversation's next turn begins a new row.
CHUNK = 1_000_000
#: Edge of an image patch in pixels, milliseconds of audio, tokens of a document page.
PATCH, AUDIO_MS, PAGE_TOKENS = 14, 40, 256

#: A content part. Only the sizes that its type has are read.
PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()),
                     T.StructField("ref", T.StringType()), T.StructField("width", T.LongType()),
                     T.StructField("height", T.LongType()), T.StructField("duration_ms", T.LongType()),
                     T.StructField("pages", T.LongType())])

ATTACHMENT = "struct<kind:string,ref:string,turn:bigint,at:bigint,tokens:bigint>"
_MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
_KINDS = ("image", "audio", "document", "file")
_CONTROL = re.compile(r"\\|(?:<s>|</s>|\[/?(?:SYS|INST|TURN)\]|\[MSG\]|<\|(?:image|audio|document|file)\|>)")
_ESCAPED = re.compile(r"\\([\\.])")
_PLACEHOLDER = re.compile(r"<\|(image|audio|document|file)\|>")
_TURN = re.compile(r"\[SYS\] (?P<system>.*?) \[/SYS\]|\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>"
                   r"|\[TURN\](?P<role>.*?)\[MSG\] (?P<other>.*?) \[/TURN\]", re.DOTALL)


def escape(text: str) -> str:
    """The text with every control string broken."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\.{m[0][1:]}", text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


class Visitor:
    """Flattens the parts of one message. ``text`` grows part by part; ``attachments``
    are (kind, reference, offset, tokens); ``spans`` are the offsets of text parts."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.size = 0
        self.attachments: list[tuple[str, str, int, int]] = []
        self.spans: list[tuple[int, int]] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            kind = part["type"] if part["type"] in ("text", *_KINDS) else "file"
            getattr(self, f"visit_{kind}")(part)

    def _emit(self, s: str) -> int:
        self.out.append(s)
        self.size += len(s)
        return self.size - len(s)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        at = self._emit(f"<|{kind}|>")
        self.attachments.append((kind, part["ref"] or "", at, max(tokens, 1)))

    def visit_text(self, part: dict) -> None:
        if part["text"]:
            at = self._emit(escape(part["text"]))
            if self.spans and self.spans[-1][1] == at:
                at = self.spans.pop()[0]
            self.spans.append((at, self.size))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil(max(part[k] or 0, 0) / PATCH) for k in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(max(part["duration_ms"] or 0, 0) / AUDIO_MS))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(part["pages"] or 0, 0) * PAGE_TOKENS)

    def visit_file(self, part: dict) -> None:
        self._attach("file", part, 1)


def format_message(role: str, parts: list[dict | None]) -> tuple[str, list[tuple[int, int]], list[tuple]]:
    """The marked message, its loss spans and its attachments, by offsets in it. Two
    text parts side by side are escaped as one text."""
    v = Visitor()
    for part in _merged(parts):
        v.visit(part)
    begin, end = _MARKS.get(role) or (f"[TURN]{escape(role)}[MSG] ", " [/TURN]")
    move = len(begin)
    spans = [(i + move, j + move) for i, j in v.spans] if role == "assistant" else []
    return begin + "".join(v.out) + end, spans, [(k, r, at + move, n) for k, r, at, n in v.attachments]


def _merged(parts: list[dict | None]) -> list[dict]:
    """Neighbouring text parts as one: a control string may begin in one and end in the next."""
    out: list[dict] = []
    for p in parts:
        if p is None:
            continue
        if p["type"] == "text" and out and out[-1]["type"] == "text":
            out[-1] = {**out[-1], "text": (out[-1]["text"] or "") + (p["text"] or "")}
        else:
            out.append(p)
    return out


def text_part(text: Column) -> Column:
    """Content of one text part."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]]
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), *none))


def _formatted(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, content -> one marked message a row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [format_message(r or "", c or []) for r, c in zip(b.column("role").to_pylist(), b.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), b.column("role"), pa.array([d[0] for d in done], pa.string()),
                 pa.array([[{"start": i, "stop": j} for i, j in d[1]] for d in done], _SPANS),
                 pa.array([[{"kind": k, "ref": r, "at": a, "tokens": n} for k, r, a, n in d[2]] for d in done], _MARKED)],
                ["conv_id", "turn", "role", "message", "spans", "attachments"])

    return rows.mapInArrow(run, "conv_id long, turn long, role string, message string, "
                                "spans array<struct<start:bigint,stop:bigint>>, "
                                "attachments array<struct<kind:string,ref:string,at:bigint,tokens:bigint>>")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_MARKED = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))
_ROW = ("conv_id long, chunk int, last boolean, start long, text string, n_turns long, "
        f"loss array<struct<start:bigint,stop:bigint>>, attachments array<{ATTACHMENT}>, attachment_tokens long")


class _Conversation:
    """A conversation that is being written, chunk by chunk."""

    def __init__(self, conv_id: int | None, chunk: int):
        self.conv_id, self.limit = conv_id, chunk
        self.start = self.turns = self.chunk = 0
        self._clear()

    def _clear(self) -> None:
        self.text: list[str] = []
        self.size = self.held = self.tokens = 0
        self.loss: list[dict] = []
        self.attachments: list[dict] = []

    def _row(self, last: bool) -> tuple:
        row = (self.conv_id, self.chunk, last, self.start, "".join(self.text), self.held, self.loss, self.attachments, self.tokens)
        self.start += self.size
        self.chunk += 1
        self._clear()
        return row

    def add(self, message: str, spans: list[dict], attachments: list[dict]) -> Iterator[tuple]:
        if self.size >= self.limit:
            yield self._row(False)
        at = self.start + self.size
        self.loss += [{"start": s["start"] + at, "stop": s["stop"] + at} for s in spans]
        for a in attachments:
            self.attachments.append({"kind": a["kind"], "ref": a["ref"], "turn": self.turns, "at": a["at"] + at, "tokens": a["tokens"]})
            self.tokens += a["tokens"]
        self.text.append(message)
        self.size += len(message)
        self.turns += 1
        self.held += 1

    def close(self) -> tuple:
        return self._row(True)


def format_chat(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                content: str = "text", chunk: int = CHUNK) -> DataFrame:
    """conv_id, chunk, last, start (offset of the chunk), text, n_turns, loss (spans),
    attachments (kind, reference, turn, offset of the placeholder, tokens) and
    attachment_tokens. ``content``: a text column or an array of ``PART``."""
    small_batches(rows.sparkSession)
    c = rows[content]
    parts = c if isinstance(rows.schema[content].dataType, T.ArrayType) else text_part(c)
    kept = rows.select(rows[conv_id].cast("long").alias("conv_id"), rows[turn].cast("long").alias("turn"),
                       rows[role].cast("string").alias("role"), parts.alias("content"))
    dealt = _formatted(kept).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "message")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        for b in batches:
            done: list[tuple] = []
            for key, message, spans, attachments in zip(*(b.column(n).to_pylist() for n in ("conv_id", "message", "spans", "attachments"))):
                if now is None or key != now.conv_id:
                    done += [now.close()] if now else []
                    now = _Conversation(key, chunk)
                done += now.add(message, spans, attachments)
            yield from _chunks(done)
        yield from _chunks([now.close()] if now else [])

    return dealt.mapInArrow(run, _ROW)


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("start", pa.int64()),
                     ("text", pa.string()), ("n_turns", pa.int64()), ("loss", _SPANS),
                     ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("turn", pa.int64()),
                                                         ("at", pa.int64()), ("tokens", pa.int64())]))),
                     ("attachment_tokens", pa.int64())])


def _chunks(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def read_turns(text: str) -> list[tuple[str, str, list[str]]]:
    """Role, text and kinds of the attachments of every turn of a formatted text."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at offset {at}")
        name = m.lastgroup if m["other"] is None else unescape(m["role"])
        body = m[m.lastgroup]
        out.append((name, unescape(_PLACEHOLDER.sub("", body)), _PLACEHOLDER.findall(body)))
        at = m.end()
    return out


def read_back(chunks: DataFrame) -> DataFrame:
    """Digests of what the formatted text says, read from it alone: conv_id, n_turns,
    turns_sha256 (role, line end, text, line end of every turn), loss_chars and
    loss_sha256 (the text under the mask, unescaped), formatted_chars, n_attachments.
    ``chunks`` is what ``format_chat`` gives, in its order."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, loss, n = hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
        for b in batches:
            done = []
            for r in b.select(["conv_id", "last", "start", "text", "loss"]).to_pylist():
                for role, text, kinds in read_turns(r["text"]):
                    turns.update(f"{role}\n{text}\n".encode())
                    n[0] += 1
                    n[3] += len(kinds)
                for s in r["loss"]:
                    text = unescape(r["text"][s["start"] - r["start"]:s["stop"] - r["start"]])
                    loss.update(text.encode())
                    n[1] += len(text)
                n[2] += len(r["text"])
                if r["last"]:
                    done.append((r["conv_id"], n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2], n[3]))
                    turns, loss, n = hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), _DIGESTS)], schema=_DIGESTS)

    return chunks.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                  "formatted_chars long, n_attachments long")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64())])
