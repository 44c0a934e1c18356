"""Shorter code and paths: comments of fenced code go, long paths that recur get an alias."""

from __future__ import annotations

import re
from functools import cache

# Languages by the way they mark comments.
HASH = {"python", "py", "ruby", "rb", "yaml", "yml", "sh", "bash", "zsh", "shell", "perl", "r", "toml"}
SLASHES = {
    "javascript", "js", "typescript", "ts", "tsx", "jsx", "java", "c", "cpp", "c++", "h", "hpp", "cs", "csharp", "go", "rust", "rs", "swift", "kotlin", "kt",
    "scala", "dart",
}
MARKS = {x: (("#",), False) for x in HASH} | {x: (("//",), True) for x in SLASHES} | {"ini": (("#", ";"), False), "php": (("//", "#"), True)}
DOCSTRING = re.compile(r"""(?m)^([ \t]*(?:async[ \t]+)?(?:def|class)\b[^\n]*:[ \t]*\n)(?:[ \t]*\n)*[ \t]*(\"\"\"|''')[\s\S]*?\2[^\n]*(?:\n|\Z)""")
#: A fence's first line, its language, what it holds, its last line. A fence that isn't closed is none.
FENCE = re.compile(r"(?ms)^([^\S\n]*```(\S*)[^\S\n]*\n)(.*?)(^[^\S\n]*```\S*[^\S\n]*$)")
# Fixed value: what counts as a path.
PATH = re.compile(r"(?:[A-Za-z]:)?(?:/[\w.\- ]+){2,}")


@cache
def lexer(marks: tuple[str, ...], blocks: bool) -> re.Pattern:
    """Literals (one that isn't closed goes to the end of its line), comments in pairs of marks, comments up to the end."""
    literal = "|".join(rf"{q}(?:\\.|[^{q}\\])*(?:{q}|\\?$)" for q in "\"'`")
    tail = "|".join(r"(?<!:)//" if mark == "//" else re.escape(mark) for mark in marks)  # not the // of a URL
    return re.compile(f"(?P<literal>{literal})|" + (r"(?P<block>/\*.*?\*/)|" if blocks else "") + f"(?P<tail>{tail})")


def bare(line: str, marks: tuple[str, ...], blocks: bool) -> str:
    """line without the comments in it; what stands in literals is none."""
    kept, at = [], 0
    for m in lexer(marks, blocks).finditer(line):
        if m.lastgroup == "literal":
            continue
        kept.append(line[at : m.start()])
        if m.lastgroup == "tail":
            return "".join(kept).rstrip()
        at = m.end()
    return "".join(kept) + line[at:]


def comment_strip(text: str, level: str) -> tuple[str, str]:
    """lite: lines that are comments; standard: comments within lines too; aggressive: also long comments, docstrings."""
    gone = 0

    def fence(m: re.Match) -> str:
        nonlocal gone
        language = re.split("[,{]", m[2].lower(), maxsplit=1)[0]
        if language not in MARKS:
            return m[0]
        marks, blocks = MARKS[language]
        body = m[3]
        if level == "aggressive":
            body = re.sub(r"(?s)/\*.*?\*/", "", body) if blocks else body
            body = DOCSTRING.sub(r"\1", body) if language in ("python", "py") else body
        whole = re.compile("(?!#!)(?:" + "|".join(map(re.escape, marks)) + (r"|/\*.*\*/$" if blocks else "") + ")")
        kept = [x for x in body.removesuffix("\n").split("\n") if not whole.match(x.strip())]
        if level != "lite":
            kept = [x if x.lstrip().startswith("#!") else bare(x, marks, blocks) for x in kept]
        new = "\n".join(kept) + "\n"
        gone += m[3].count("\n") - new.count("\n")
        return m[1] + new + m[4]

    new = FENCE.sub(fence, text) if "```" in text else text
    return new, f"stripped {gone} comment lines" if gone else ""


def path_collapse(text: str, level: str) -> tuple[str, str]:
    """Paths of at least 80, 60 or 40 characters that occur 5, 3 or 2 times: the first stays, later ones become <Pn>, and
    a legend goes before the text; only for those that save more than their legend takes."""
    long, often = {"lite": (80, 5), "standard": (60, 3), "aggressive": (40, 2)}[level]
    counts: dict[str, int] = {}
    for path in PATH.findall(text):
        counts[path] = counts.get(path, 0) + 1
    alias: dict[str, str] = {}
    for path, n in counts.items():
        name = f"<P{len(alias) + 1}>"
        if len(path) >= long and n >= often and (n - 1) * (len(path) - len(name)) > len(name) + len(path) + 3:
            alias[path] = name
    if not alias:
        return text, ""
    seen: set[str] = set()

    def later(m: re.Match) -> str:
        if m[0] in seen:
            return alias.get(m[0], m[0])
        seen.add(m[0])
        return m[0]

    legend = "; ".join(f"{name}={path}" for path, name in alias.items())
    return f"Path aliases: {legend}\n" + PATH.sub(later, text), f"{len(alias)} path aliases"
