"""Shorter JSON: minified where a text or a fenced block is JSON, long arrays and objects cut to their ends."""

from __future__ import annotations

import json
import re
from collections import Counter

# Languages whose blank space means something, and the JSON ones.
SPACED = {"python", "py", "yaml", "yml", "makefile", "make", "haml", "coffee", "coffeescript", "fsharp", "f#", "sass"}
JSON_NAMES = ("json", "jsonc", "json5")
STRING_OR_COMMENT = re.compile(r'"(?:\\.|[^"\\])*"|/\*.*?\*/|//[^\n]*', re.S)


def parsed(text: str) -> object | None:
    """The value of a JSON array or object, or null for any other text."""
    text = text.strip()
    try:
        return json.loads(text) if text[:1] in ("{", "[") else None
    except (ValueError, RecursionError):
        return None


def minified(text: str, level: str) -> str | None:
    value = parsed(text)
    if value is None and level == "aggressive":
        parts = STRING_OR_COMMENT.findall(text)
        if any(p[0] == '"' and ("//" in p or "/*" in p) for p in parts):
            return None
        bare = STRING_OR_COMMENT.sub(lambda m: m[0] if m[0][0] == '"' else "", text)
        value = parsed(re.sub(r",(\s*[}\]])", r"\1", bare))
    return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def tidy(text: str) -> str:
    """Lines without trailing space, at most two empty ones in a row."""
    return re.sub(r"(^|\n)(\n\n)\n+", r"\1\2", "\n".join(x.rstrip() for x in text.split("\n")))


def json_aware(text: str, level: str) -> tuple[str, str]:
    out, found = [], 0
    for i, part in enumerate(text.split("```")):
        if i % 2:
            header, line, body = part.partition("\n")
            name = re.match(r"[A-Za-z0-9_+\-]*", header)[0].lower()
            tried = name in JSON_NAMES or parsed(body) is not None or level == "aggressive" and body.lstrip()[:1] in ("{", "[")
            short = minified(body, level) if line and tried else None
            if short is None and line and level != "safe" and name not in SPACED:
                body = tidy(body)
            part = header + line + (body if short is None else short)
        else:
            bare = part.strip()
            short = minified(part, level) if bare[:1] in ("{", "[") else None
            if short is not None:
                at = part.index(bare)
                part = part[:at] + short + part[at + len(bare) :]
            elif level != "safe":
                part = tidy(part)
        found += short is not None
        out.append(part)
    return "```".join(out), f"minified {found} blocks" if found else ""


KINDS = {bool: "bool", int: "int", float: "float", str: "str", list: "list", dict: "dict", type(None): "null"}
OMITTED = "__omitted__"


def json_collapse(text: str, level: str) -> tuple[str, str]:
    """Arrays of at least 50, 20 or 10 items keep three and two, objects of at least 50 or 20 keys (not at lite) five and
    three, at every depth; only where the whole gets shorter."""
    most_items, most_keys = {"lite": (50, None), "standard": (20, 50), "aggressive": (10, 20)}[level]
    cuts = 0

    def cut(value: object) -> object:
        nonlocal cuts
        if isinstance(value, list):
            new = [cut(x) for x in value]
            if len(new) >= most_items:
                cuts += 1
                kinds = Counter(KINDS[type(x)] for x in value[3:-2])
                new[3:-2] = [f"[... {len(value) - 5} items omitted; types: {', '.join(f'{k}={n}' for k, n in sorted(kinds.items()))} ...]"]
            return new
        if isinstance(value, dict):
            items = [(k, cut(x)) for k, x in value.items()]
            if most_keys and len(items) >= most_keys:
                cuts += 1
                items[5:-3] = [(OMITTED, f"[... {len(items) - 8} keys omitted ...]")]
            return dict(items)
        return value

    try:
        new = json.dumps(cut(json.loads(text)), separators=(", ", ": "), ensure_ascii=False)
    except (ValueError, RecursionError):
        return text, ""
    return (new, f"{cuts} structures collapsed") if cuts and len(new) < len(text) else (text, "")
