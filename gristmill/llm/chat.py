"""Chat formatting by incremental black-box rendering.

A template is a function from a list of turns to a text; nothing else is known about it. Successive prefixes of a
conversation are rendered, and consecutive outputs are compared: if the longer one starts with the shorter one, what is
added is the new turn's span; if not, the template rewrites history, and what was rendered so far is closed as an
output of its own. Within its span, a turn's text is located by rendering the turn once more with a probe text.

A conversation is compared over all its turns, which are held and rendered once for each prefix. Only with a template
that is known to append (what it writes for a turn never depends on later ones), long conversations are rendered in
windows of max_turns turns (the template is told the number of the first), so that memory is bounded and work stays
proportional to the input; a conversation's turns reach one task in order, as a sorted stream.

Defined results: a null text or role is empty; rows with equal turn numbers are ordered by role and text, and repeated
rows are turns of their own; rows with a null conv_id are one conversation; null turns come first; an empty table gives
no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TURNS = 32

Turn = tuple[str, str]  #: role, text


class Span(NamedTuple):
    start: int  #: of the turn
    end: int
    text_start: int  #: of the turn's text, as the template wrote it; -1 where the template doesn't show it once
    text_end: int


class Rendered(NamedTuple):
    text: str
    first: int  #: number of the first turn whose span is in here
    spans: list[Span]
    rewritten: bool  #: the turn after the last one rewrote this


class Template(NamedTuple):
    """render(turns, number of the first turn) -> text, and the inverse of what it does to texts."""

    render: Callable[[list[Turn], int], str]
    unescape: Callable[[str], str]
    parse: Callable[[str], Iterator[tuple[str, str, bool]]] | None = None  #: role, text, whether it is learned
    appends: bool = False  #: never rewrites history, so windows can be rendered alone


# The bracket template. Its control strings.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[SEP]", "[/TURN]")
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_REST})")
_PARTS = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?)</s>|\[TURN\] (?P<role>.*?) \[SEP\] (?P<text>.*?) \[/TURN\]|<s>", re.DOTALL)


def escape(text: str) -> str:
    """A backslash after the first character of each control string (one more where there are some already)."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render_brackets(turns: list[Turn], first: int = 0) -> str:
    out = ["<s>"] if first == 0 else []
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escape(text)}</s>")
        else:
            out.append(f"[TURN] {escape(role)} [SEP] {escape(text)} [/TURN]")
    return "".join(out)


def parse_brackets(text: str) -> Iterator[tuple[str, str, bool]]:
    at = 0
    while at < len(text):
        m = _PARTS.match(text, at)
        if m is None:
            raise ValueError(f"not an output of the bracket template at {at}")
        at = m.end()
        if (x := m["user"]) is not None:
            yield "user", unescape(x), False
        elif (x := m["assistant"]) is not None:
            yield "assistant", unescape(x), True
        elif m["role"] is not None:
            yield unescape(m["role"]), unescape(m["text"]), False


BRACKETS = Template(render_brackets, unescape, parse_brackets, True)


def unsaid(turns: list[Turn]) -> str:
    """A text that no turn holds."""
    n = 1
    while True:
        mark = "\ue000" + "\ue001" * n + "\ue000"
        if not any(mark in x for turn in turns for x in turn):
            return mark
        n += 1


def locate(template: Template, turns: list[Turn], first: int, before: str, after: str, mark: str) -> Span:
    """The span of the last of turns in after, the rendering that follows before, and that of its text. mark: a text that
    none of the turns holds."""
    start = len(before) if after.startswith(before) else 0
    probe = template.render([*turns[:-1], (turns[-1][0], mark)], first)
    at = probe.find(mark)
    tail = len(probe) - at - len(mark)
    if at < 0 or probe.find(mark, at + 1) >= 0 or at + tail > len(after) or after[:at] != probe[:at] or tail and after[-tail:] != probe[-tail:]:
        return Span(start, len(after), -1, -1)
    return Span(start, len(after), at, len(after) - tail)


def render_turns(template: Template, turns: list[Turn], first: int = 0) -> list[Rendered]:
    """Renders the turns prefix by prefix. More than one output: the template rewrote history in between."""
    done: list[Rendered] = []
    before, spans, begun, mark = template.render([], first), [], first, unsaid(turns)
    for k in range(1, len(turns) + 1):
        after = template.render(turns[:k], first)
        if not after.startswith(before):
            if spans:
                done.append(Rendered(before, begun, spans, True))
            spans, begun = [], first + k - 1
        spans.append(locate(template, turns[:k], first, before, after, mark))
        before = after
    return [*done, Rendered(before, begun, spans, False)]


FORMATTED = pa.schema(
    [
        ("conv_id", pa.int64()), ("window", pa.int64()), ("part", pa.int32()), ("first_turn", pa.int64()), ("formatted", pa.string()), ("rewritten", pa.bool_()),
        ("spans", pa.list_(pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("learned", pa.bool_()), ("exact", pa.bool_())]))),
    ]
)
FORMATTED_DDL = "conv_id long, window long, part int, first_turn long, formatted string, rewritten boolean, spans array<struct<role string, start int, end int, text_start int, text_end int, learned boolean, exact boolean>>"


def _windows(rows: Iterable[tuple], max_turns: int | None) -> Iterator[tuple[int | None, int, list[Turn]]]:
    """conv_id, number of the first turn, turns."""
    held, conv, first = [], None, 0
    for i, (conv_id, role, text) in enumerate(rows):
        if i == 0 or conv_id != conv or len(held) == max_turns:
            if held:
                yield conv, first, held
            first, conv, held = (first + len(held) if i and conv_id == conv else 0), conv_id, []
        held.append((role or "", text or ""))
    if held:
        yield conv, first, held


def _batches(rows: Iterable[dict], schema: pa.Schema, most_chars: int, weigh: Callable[[dict], int]) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += weigh(row)
        if chars > most_chars or len(held) == 1000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def format_conversations(
    conversations: DataFrame, template: Template = BRACKETS, learned: Callable[[str], bool] = lambda role: role == "assistant", max_turns: int = MAX_TURNS
) -> DataFrame:
    """conv_id, window, part, first_turn, formatted, rewritten, spans: the outputs in order, with each turn's span, its
    text's span, whether that is learned (the loss mask) and whether unescaping it gives the text back.

    The rows of a conversation follow each other in one partition, in order.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def outputs(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        stream = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
        for conv, first, turns in _windows(stream, max_turns if template.appends else None):
            for part, r in enumerate(render_turns(template, turns, first)):
                spans = []
                for (role, text), s in zip(turns[r.first - first :], r.spans, strict=False):
                    exact = s.text_start >= 0 and template.unescape(r.text[s.text_start : s.text_end]) == text
                    spans.append(s._asdict() | {"role": role, "learned": bool(learned(role)) and s.text_start >= 0, "exact": exact})
                yield {"conv_id": conv, "window": first // max_turns, "part": part, "first_turn": r.first, "formatted": r.text, "rewritten": r.rewritten, "spans": spans}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(outputs(batches), FORMATTED, 4 << 20, lambda r: len(r["formatted"]))

    return rows.mapInArrow(run, FORMATTED_DDL)


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.int64())])


def digests(formatted: DataFrame, template: Template = BRACKETS) -> DataFrame:
    """What the outputs of format_conversations hold, read back from them: per conversation the turns (count, SHA-256 of
    role, line feed, text, line feed), the learned texts (code points, SHA-256), the outputs' length and rewrites."""

    def conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        conv, begun = None, False
        state: dict = {}
        for b in batches:
            for conv_id, text, spans, rewritten in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "spans", "rewritten")), strict=True):
                if not begun or conv_id != conv:
                    if begun:
                        yield finish(conv, state)
                    conv, begun = conv_id, True
                    state = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "out": 0, "rewrites": 0}
                for role, said, _ in template.parse(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    if s["learned"]:
                        said = template.unescape(text[s["text_start"] : s["text_end"]])
                        state["chars"] += len(said)
                        state["loss"].update(said.encode("utf-8", "surrogatepass"))
                state["out"] += len(text)
                state["rewrites"] += rewritten
        if begun:
            yield finish(conv, state)

    def finish(conv: int | None, s: dict) -> dict:
        return {"conv_id": conv, "n_turns": s["n"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["out"], "rewrites": s["rewrites"]}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(conversations(batches), DIGEST, 1 << 20, lambda r: 300)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long")
