"""Text-rewriting engines: each a small function of a text and a level, run in Arrow batches over a column.

Engines are looked up by name; an unknown name or level is an error, and the level off gives the text back unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.rewrite import code, data, prose, traces

Rewriter = Callable[[str, str], tuple[str, str]]  #: (text, level) -> (text, note)

ENGINES: dict[str, tuple[Rewriter, tuple[str, ...]]] = {
    "caveman": (prose.caveman, ("lite", "standard", "aggressive", "ultra")),
    "rtk": (prose.rtk, ("minimal", "standard", "aggressive")),
    "json_aware": (data.json_aware, ("safe", "standard", "aggressive")),
    "json_collapse": (data.json_collapse, ("lite", "standard", "aggressive")),
    "stack_trace": (traces.stack_trace, ("lite", "standard", "aggressive")),
    "log_collapse": (traces.log_collapse, ("lite", "standard", "aggressive")),
    "diff_compactor": (traces.diff_compactor, ("lite", "standard", "aggressive")),
    "comment_strip": (code.comment_strip, ("lite", "standard", "aggressive")),
    "path_collapse": (code.path_collapse, ("lite", "standard", "aggressive")),
}
RESULT = "struct<text string, note string, original_chars int, compressed_chars int, changed boolean>"


def register(name: str, rewriter: Rewriter, levels: tuple[str, ...]) -> None:
    """Adds an engine of one's own."""
    ENGINES[name] = rewriter, levels


def rewrite_text(name: str, text: str | None, level: str) -> tuple[str | None, str]:
    rewriter, levels = ENGINES[name]
    if level != "off" and level not in levels:
        raise ValueError(f"{name} has the levels off, {', '.join(levels)}, not {level!r}")
    return (text, "") if not text or level == "off" else rewriter(text, level)


def rewritten(text: Column, name: str, level: str) -> Column:
    """struct text, note, original_chars, compressed_chars and changed (by length) of each text; null stays null."""
    rewrite_text(name, None, level)

    @F.arrow_udf(RESULT)
    def of(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            new, note = rewrite_text(name, t, level)
            n, m = len(t or ""), len(new or "")
            rows.append({"text": new, "note": note, "original_chars": n, "compressed_chars": m, "changed": n != m})
        kind = pa.struct([("text", pa.string()), ("note", pa.string()), ("original_chars", pa.int32()), ("compressed_chars", pa.int32()), ("changed", pa.bool_())])
        return pa.array(rows, kind)

    return of(text)


def skip_reason(text: Column, ready: Column | bool, least: int = 256, most: int = 200_000) -> Column:
    """Why a model-backed engine passes a text through, or null where it may run."""
    ready = F.lit(ready) if isinstance(ready, bool) else ready
    return F.when(F.length(text) < least, "too_short").when(F.length(text) > most, "too_long").when(~ready, "no_model")
