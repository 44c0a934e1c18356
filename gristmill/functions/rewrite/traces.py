"""Shorter logs, stack traces and diffs: runs of like lines give way to a note."""

from __future__ import annotations

import re
from itertools import groupby, takewhile
from typing import NamedTuple

# Time stamps that lines may begin with, in the order tried.
STAMPS = [
    re.compile(r"^\s*\[\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?\]\s*"),
    re.compile(r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\s*"),
    re.compile(r"^\s*\d{2}:\d{2}:\d{2}(?:\.\d+)?\s*"),
]
# Frames of Python, Java, V8 (named and bare) and Rust traces.
FRAMES = [
    re.compile(r'^\s*File "(?P<file>[^"]+)", line (?P<line>\d+), in (?P<func>\S+)\s*$'),
    re.compile(r"^\s*at\s+(?P<func>[\w$.<>]+)\((?P<file>[\w./$]+):(?P<line>\d+)\)\s*$"),
    re.compile(r"^\s*at\s+(?P<func>[\w$.<>]+)\s+\((?P<file>[^():\s]+):(?P<line>\d+)(?::\d+)?\)\s*$"),
    re.compile(r"^\s*at\s+(?P<file>[^():\s]+):(?P<line>\d+)(?::\d+)?\s*$"),
    re.compile(r"^\s*\d+:\s+(?P<func>[\w:<>$]+(?:::[\w:<>$]+)*)\s*$"),
]
#: What stack_trace writes in place of frames; such lines stay when a text comes again.
EQUAL, NEAR, OMITTED = "[... {} identical frames collapsed ...]", "[... {} similar frames in {}() at {} collapsed ...]", "[... {} frames omitted; truncated trace ...]"
NOTE = re.compile(r"\s*(?:" + "|".join(re.escape(x).replace(r"\{\}", ".*") for x in (EQUAL, NEAR, OMITTED)) + r")\s*")


def log_collapse(text: str, level: str) -> tuple[str, str]:
    """Runs of at least 10 (lite) or 5 lines that are equal (without time stamps; aggressive: with any numbers) keep
    their first and last line, where that is shorter. If a run doesn't pay, the rest of it without its first lines may."""
    least = 10 if level == "lite" else 5

    def key(line: str) -> str:
        if level != "lite":
            line = next((new for p in STAMPS if (new := p.sub("", line, count=1)) != line), line)
        return re.sub(r"\d+(?:\.\d+)?", "#", line) if level == "aggressive" else line

    out, gone = [], 0
    for _, group in groupby(text.split("\n"), key):
        run = list(group)
        for skip in range(len(run) - least + 1):
            rest = run[skip:]
            short = [rest[0], f"[... {len(rest) - 2} identical lines collapsed ...]", rest[-1]]
            if len("\n".join(short)) < len("\n".join(rest)):
                run, gone = run[:skip] + short, gone + len(rest) - 2
                break
        out += run
    return "\n".join(out), f"collapsed {gone} lines" if gone else ""


class Unit(NamedTuple):
    kind: str  #: frame, note or other
    lines: list[str]
    place: tuple = ()  #: of a frame: file, function, line


def _frame(line: str) -> tuple | None:
    m = next((m for p in FRAMES if (m := p.match(line))), None)
    if m is None:
        return None
    found = m.groupdict()
    return found.get("file", "<rust>"), found.get("func", "<anon>"), found.get("line", "0")


def _units(lines: list[str]) -> list[Unit]:
    """A frame takes the next line with it if that is indented further and no frame itself."""
    depth = lambda x: len(x) - len(x.lstrip())
    units: list[Unit] = []
    for line in lines:
        last = units[-1] if units else None
        if NOTE.fullmatch(line) and not (last and last.kind == "frame" and len(last.lines) == 1 and depth(line) > depth(last.lines[0])):
            units.append(Unit("note", [line]))
        elif (place := _frame(line)) is not None:
            units.append(Unit("frame", [line], place))
        elif last and last.kind == "frame" and len(last.lines) == 1 and line.strip() and depth(line) > depth(last.lines[0]):
            last.lines.append(line)
        else:
            units.append(Unit("other", [line]))
    return units


def stack_trace(text: str, level: str) -> tuple[str, str]:
    """Runs of equal frames, then of frames of one function, become a note; aggressive also shortens long blocks."""
    same, alike = {"lite": (5, None), "standard": (3, 3), "aggressive": (2, 2)}[level]
    rest, out, gone, cut = _units(text.split("\n")), [], 0, 0
    while rest:
        head = rest[0]
        equal = list(takewhile(lambda u: u.kind == "frame" and (u.place, u.lines[1:]) == (head.place, head.lines[1:]), rest))
        near = list(takewhile(lambda u: u.kind == "frame" and u.place[:2] == head.place[:2], rest))
        n = 1
        if head.kind == "frame" and len(equal) >= same:
            n, note = len(equal), EQUAL.format(len(equal))
        elif head.kind == "frame" and alike and len(near) >= alike:
            n, note = len(near), NEAR.format(len(near), head.place[1], head.place[0])
        else:
            note = None
        out += head.lines if note is None else [note]
        gone += n - 1
        rest = rest[n:]
    if level == "aggressive":
        lines, out = out, []
        for plain, group in groupby(_units(lines), lambda u: u.kind == "other"):
            block = list(group)
            if not plain and len(block) > 5:
                cut += len(block) - 3
                block[2:-1] = [Unit("note", [OMITTED.format(len(block) - 3)])]
            out += [x for u in block for x in u.lines]
    notes = [f"collapsed {gone} frames"] * bool(gone) + [f"truncated {cut} frames"] * bool(cut)
    return "\n".join(out), "; ".join(notes)


def diff_compactor(text: str, level: str) -> tuple[str, str]:
    """In texts with @@: long runs of context lines keep their ends; aggressive also drops a line taken out and put
    back at once."""
    if "@@" not in text:
        return text, ""
    least, ends = {"lite": (20, 3), "standard": (10, 2), "aggressive": (5, 1)}[level]
    out, gone, reverts = [], 0, 0
    for context, group in groupby(text.split("\n"), lambda x: x.startswith(" ")):
        run = list(group)
        if context and len(run) >= least and len(run) > 2 * ends:
            gone += len(run) - 2 * ends
            run[ends:-ends] = [f"[... {len(run) - 2 * ends} unchanged lines ...]"]
        out += run
    if level == "aggressive":
        lines, out = out, []
        for line in lines:
            before = out[-1] if out else ""
            if line.startswith("+") and not line.startswith("+++") and before.startswith("-") and not before.startswith("---") and line[1:] == before[1:]:
                out.pop()
                reverts += 1
            else:
                out.append(line)
    notes = [f"collapsed {gone} context lines"] * bool(gone) + [f"dropped {reverts} revert pairs"] * bool(reverts)
    return "\n".join(out), "; ".join(notes)
