"""Chats formatted by a compiled template, with a mask over what a model is trained to say, and read back."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm import templates

#: A part of a formatted conversation ends with the turn that brings it to so many characters.
PART = 1_000_000


@dataclass(frozen=True)
class ChatFormat:
    """A template and how its output is read.

    controls are the strings that mark turns; the filter `escape` puts a backslash behind the first character of each
    that occurs inside a text (in front of those already there), so none is left and what was there can be told.
    turns has what stands before and after a text of each role; other is for all remaining roles: what stands before
    the role, between role and text, and after the text.
    """

    template: str
    controls: tuple[str, ...]
    turns: tuple[tuple[str, str, str], ...]
    other: tuple[str, str, str]

    def __post_init__(self):
        for a, b in itertools.product(self.controls, repeat=2):
            if len(a) < 2 or "\\" in a:
                raise ValueError("a control string has two characters at least and no backslash")
            if a != b and a in b or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                raise ValueError(f"control strings {a!r} and {b!r} overlap")

    def _marks(self, backslashes: str) -> re.Pattern[str]:
        return re.compile("|".join(re.escape(c[0]) + rf"\\{backslashes}" + re.escape(c[1:]) for c in self.controls))

    def escape(self):
        return lambda text, find=self._marks("*").sub: find(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self):
        return lambda text, find=self._marks("+").sub: find(lambda m: m[0][0] + m[0][2:], text)

    def compiled(self):
        return templates.Template(self.template, {"escape": self.escape(), "trim": str.strip, "upper": str.upper, "lower": str.lower}).compiled()

    def reader(self):
        """A function from formatted text to (role, text) of its turns; it stops at text that is no turn."""
        before, between, after = map(re.escape, self.other)
        ways = [f"{re.escape(a)}(?P<t{i}>.*?){re.escape(b)}" for i, (_, a, b) in enumerate(self.turns)]
        turn = re.compile("|".join([*ways, f"{before}(?P<role>.*?){between}(?P<text>.*?){after}"]), re.S)
        roles = {f"t{i}": role for i, (role, _, _) in enumerate(self.turns)}
        unescape = self.unescape()

        def read(formatted: str) -> Iterator[tuple[str, str]]:
            at = 0
            while at < len(formatted):
                m = turn.match(formatted, at)
                if not m:
                    raise ValueError(f"no turn at {at}")
                which = m.lastgroup
                yield (unescape(m["role"]), unescape(m["text"])) if which == "text" else (roles[which], unescape(m[which]))
                at = m.end()

        return read


#: The control strings of a widespread format; the three for other roles are our own.
INSTRUCTION = ChatFormat(
    template="""
{%- for m in messages -%}
  {%- if m.role == 'user' -%} {{ '<s>' + '[INST] ' }}{{ m.content | escape }}{{ ' [/INST]' }}
  {%- elif m.role == 'assistant' -%} {{ ' ' }}{% generation %}{{ m.content | escape }}{% endgeneration %}{{ ' </s>' }}
  {%- elif m.role == 'system' -%} {{ '<<SYS>>\\n' }}{{ m.content | escape }}{{ '\\n<</SYS>>\\n\\n' }}
  {%- else -%} [ROLE]{{ m.role | escape }}[/ROLE]{{ m.content | escape }}[/TURN]
  {%- endif -%}
{%- endfor -%}
""",
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]"),
    turns=(("user", "<s>[INST] ", " [/INST]"), ("assistant", " ", " </s>"), ("system", "<<SYS>>\n", "\n<</SYS>>\n\n")),
    other=("[ROLE]", "[/ROLE]", "[/TURN]"),
)

PARTS = "conv_id long, part int, formatted string, mask array<struct<start: int, end: int>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def formatted(conversations: DataFrame, form: ChatFormat = INSTRUCTION, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """Every conversation as conv_id, part (from 0), formatted and mask (spans of code points in the part).

    Turns come in order of turn, role and text, nulls first; null roles and texts are empty, repeated rows are
    repeated turns, and rows with a null conv_id are one conversation. A part holds whole turns, so a conversation
    of very many turns is many rows; it is streamed, never held. Very long texts are rendered whole. An empty table
    gives no rows. Other columns, whatever their names, are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        render = form.compiled()
        for conv, turns in itertools.groupby(rows(batches), key=lambda r: r[0]):
            n, texts, spans, length, begun = 0, [], [], 0, None
            for piece in render({"messages": ({"role": role, "content": text} for _, role, text in turns)}):
                if piece is templates.TURN:
                    if length >= part:
                        yield conv, n, "".join(texts), spans
                        n, texts, spans, length = n + 1, [], [], 0
                elif piece is templates.BEGIN:
                    if begun is not None:
                        raise templates.TemplateError("generation inside generation")
                    begun = length
                elif piece is templates.END:
                    spans.append({"start": begun, "end": length})
                    begun = None
                else:
                    texts.append(piece)
                    length += len(piece)
            if texts or not n:
                yield conv, n, "".join(texts), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        held, size = [], 0
        for row in parts(batches):
            held.append(row)
            size += len(row[2]) + 100
            if size >= 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

    empty = F.lit("")
    laid = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), empty).alias("role"), F.coalesce(F.col(text_col).cast("string"), empty).alias("text"))
    laid = laid.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return laid.select("conv_id", "role", "text").mapInArrow(run, PARTS)


def read_back(parts: DataFrame, form: ChatFormat = INSTRUCTION, laid: bool = False) -> DataFrame:
    """What the formatted conversations say: turns and trained text, unescaped, counted and digested.

    Returns conv_id, n_turns, turns_sha256 (of role, line break, text, line break of every turn), loss_chars and
    loss_sha256 (of all text under the mask), formatted_chars. laid: the parts stand as formatted() left them, each
    conversation's in order in one partition; else they are sorted first. A part that is not made of turns stops the
    read. Digests are carried along from part to part, so no conversation is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, unescape = form.reader(), form.unescape()
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        done = []

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
            n, chars, loss_chars = 0, 0, 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
            for _, text, mask in group:
                chars += len(text)
                for role, content in read(text):
                    n += 1
                    turns.update(f"{role}\n{content}\n".encode())
                for span in mask:
                    trained = unescape(text[span["start"] : span["end"]])
                    loss_chars += len(trained)
                    loss.update(trained.encode())
            done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(done) >= 10_000:
                yield batch_of(done)
                done = []
        if done:
            yield batch_of(done)

    rows = parts if laid else parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.select("conv_id", "formatted", "mask").mapInArrow(run, READ)
