"""Edits of JSON texts in place: what isn't edited keeps its bytes, white space, order and escapes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa

_PART = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')
#: Kinds of edits: another string, a further field of an object, or an array with one text block in place of a string.
TEXT, FIELD, PROMOTE = "text", "field", "promote"
#: Rows of a batch that are edited at once.
ROWS = 100


def spans(payload: str, paths: Iterable[str]) -> dict[str, tuple[int, int]]:
    """Start and end of the values at the paths (as in `messages[0].content[1].text`) that the payload has; of repeated
    fields, the last."""
    wanted, out = set(paths), {}
    stack: list[list] = []  # path of the container, index or None, start
    path, name = "", None  # of the value that comes next
    for m in _PART.finditer(payload):
        c = m[0]
        if c in "{[":
            stack.append([path, 0 if c == "[" else None, m.start()])
            path, name = (f"{path}[0]", None) if c == "[" else (path, "")
        elif c in "}]":
            path, _, start = stack.pop()
            if path in wanted:
                out[path] = start, m.end()
        elif c == ",":
            top = stack[-1]
            if top[1] is None:
                name = ""
            else:
                top[1] += 1
                path = f"{top[0]}[{top[1]}]"
        elif c == ":":
            path, name = f"{stack[-1][0]}.{name}".removeprefix("."), None
        elif name == "":
            name = json.loads(c)
        elif path in wanted:
            out[path] = m.span()
    return out


def edited(payload: str, edits: list[tuple[str, str, str]]) -> str:
    """payload after the edits (path, kind, text); an edit whose path the payload doesn't have is passed over. For a
    field or a promoted string, text is the field as it is written."""
    places = spans(payload, [p for p, _, _ in edits])
    for start, end, kind, text in sorted(((*places[p], k, t) for p, k, t in edits if p in places), reverse=True):
        value = payload[start:end]
        if kind == TEXT:
            value = json.dumps(text, ensure_ascii=False)
        elif kind == PROMOTE:
            value = f'[{{"type": "text", "text": {value}, {text}}}]'
        else:
            inner = value[1:-1].rstrip()
            value = f"{{{inner}{', ' if inner else ''}{text}}}"
        payload = payload[:start] + value + payload[end:]
    return payload


def edit_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with payload and edits (null for none); payload comes back edited. Only some rows of a batch are held as
    Python objects at once."""
    for whole in batches:
        for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
            new = [p if not e or p is None else edited(p, [(x["path"], x["kind"], x["text"]) for x in e]) for p, e in zip(b.column("payload").to_pylist(), b.column("edits").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == "payload" else b.column(n) for n in b.schema.names if n != "edits"], names=[n for n in b.schema.names if n != "edits"])
