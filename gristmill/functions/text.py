"""Text functions as Column expressions: tokens, shingles, token estimate, digests, middle-out shortening."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MIXED = r"[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|[^\s]"
WORD = "[A-Za-z0-9]+"


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def tokens(text: Column) -> Column:
    """Identifiers, numbers and single other characters, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(MIXED), F.lit(0)), F.lower)


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(parts: Column, width: int) -> Column:
    """Runs of width neighbours joined by a space; fewer than that are one shingle, none are none."""

    def of(p: Column) -> Column:
        whole = F.when(F.size(p) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(p, " ")))
        runs = F.transform(F.sequence(F.lit(1), F.size(p) - (width - 1)), lambda i: F.array_join(F.slice(p, i, width), " "))
        return F.when(F.size(p) <= width, whole).otherwise(runs)

    return let(parts, of)  # else parts would be made anew for each run


def char_grams(text: Column, width: int) -> Column:
    whole = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array(text))
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - (width - 1)), lambda i: F.substring(text, i, F.lit(width)))
    return F.when(F.length(text) <= width, whole).otherwise(runs)


def hybrid_shingles(text: Column, width: int = 5, fewest: int = 16, grams: int = 8) -> Column:
    """Word shingles, or character grams with a mark before them where there are few of those."""
    return let(shingles(tokens(text), width), lambda s: F.when(F.size(s) >= fewest, s).otherwise(F.transform(char_grams(text, grams), lambda g: F.concat(F.lit("\x01"), g))))


def estimate_tokens(text: Column) -> Column:
    """Letters / 4 + digits / 2 + other characters + white-space runs / 2, or length / 3.5 where capitals or symbols
    prevail; rounded half to even, at least 1, and 0 for an empty text."""
    count = lambda cls: F.length(F.regexp_replace(text, f"[^{cls}]", ""))
    parts = F.struct(
        F.length(text).alias("n"),
        count(r"\p{L}").alias("letters"),
        count(r"\p{Lu}").alias("upper"),
        count(r"\p{Nd}").alias("digits"),
        F.length(F.regexp_replace(text, r"[\p{L}\p{Nd}\s\x1c-\x1f\x85\p{Z}]", "")).alias("marks"),
        F.regexp_count(text, F.lit(r"[\s\x1c-\x1f\x85\p{Z}]+")).alias("gaps"),
    )

    def of(p: Column) -> Column:
        heavy = ((p["letters"] > 0) & (p["upper"] / p["letters"] > 0.6)) | (p["marks"] > F.greatest(F.lit(1), F.floor(p["n"] * 0.3)))
        value = F.when(heavy, p["n"] / 3.5).otherwise(p["letters"] / 4.0 + p["digits"] / 2.0 + p["marks"] + p["gaps"] * 0.5)
        return F.when(p["n"] == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(value, 0).cast("int")))

    return F.when(text.isNull(), 0).otherwise(let(parts, of)).cast("int")


def short_digest(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def middle_out(text: Column, max_chars: int, min_omitted: int = 500, head_share: float = 0.55) -> Column:
    """Texts over max_chars keep their beginning and end around a note of what is left out.

    The note's length depends on the number in it, so the two are settled in at most three steps, as a fold.
    """

    def note(left_out: Column, n: Column, digest: Column) -> Column:
        return F.concat(
            F.lit("\n\n[... middle-out compressed locally: omitted "), left_out.cast("string"), F.lit(" chars; original_chars="), n.cast("string"),
            F.lit("; sha256="), digest, F.lit("; not reversible by the model ...]\n\n"),
        )

    def ends(mark: Column) -> tuple[Column, Column]:
        room = F.greatest(F.lit(128), F.lit(max_chars) - F.length(mark))
        head = F.greatest(F.lit(64), F.floor(room * F.lit(head_share)).cast("int"))
        return head, F.greatest(F.lit(64), room - head)

    def state(mark: Column, settled: Column) -> Column:
        head, tail = ends(mark)
        return F.struct(mark.alias("mark"), head.alias("head"), tail.alias("tail"), settled.alias("settled"))

    def of(x: Column) -> Column:
        n, digest = x["n"], x["digest"]

        def step(s: Column, _: Column) -> Column:
            new = note(n - s["head"] - s["tail"], n, digest)
            same = F.length(new) == F.length(s["mark"])
            kept = F.struct(new.alias("mark"), s["head"].alias("head"), s["tail"].alias("tail"), F.lit(True).alias("settled"))
            return F.when(s["settled"], s).when(same, kept).otherwise(state(new, F.lit(False)))

        def done(begun: Column) -> Column:
            folded = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), begun, step)
            short = let(folded, lambda s: F.concat(F.regexp_replace(F.substring(text, F.lit(1), s["head"]), r"\s+$", ""), s["mark"], F.regexp_replace(F.substring(text, n - s["tail"] + 1, s["tail"]), r"^\s+", "")))
            return F.when(begun["head"] + begun["tail"] >= n - min_omitted, text).otherwise(short)

        return let(state(note(n - max_chars, n, digest), F.lit(False)), done)

    return F.when(F.length(text) <= max_chars, text).otherwise(let(F.struct(F.length(text).alias("n"), short_digest(text).alias("digest")), of))


def duplicate_note(text: Column, place: Column, similarity: Column) -> Column:
    """What stands for a text that is nearly the same as an earlier one."""
    return F.format_string("[Near-duplicate content omitted locally. Similar to earlier block at %s; similarity=%.3f; original_chars=%d; sha256=%s.]", place, similarity, F.length(text), short_digest(text))


def glob_to_regex(glob: str) -> str:
    """An anchored regular expression for a shell pattern with *, ? and [...]."""
    import fnmatch

    return "^" + fnmatch.translate(glob).removesuffix("\\Z").removesuffix("\\z") + "$"


def serialised_chars(payload: Column) -> Column:
    """Characters of the payload as compact JSON, non-ASCII kept as it is; of what is no JSON, its own. Null for null."""

    def one(text: str | None) -> int | None:
        try:
            return None if text is None else len(json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False))
        except ValueError:
            return len(text)

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], pa.int64())

    return of(payload)


def iso_utc(seconds: Column) -> Column:
    """ISO 8601 in UTC of seconds since 1970, whatever the session's time zone; microseconds only if there are any."""
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    said = F.split(at.cast("string"), r"\.")
    fraction = F.coalesce(F.concat(F.lit("."), F.rpad(F.get(said, F.lit(1)), 6, "0")), F.lit(""))
    return F.concat(F.replace(F.get(said, F.lit(0)), F.lit(" "), F.lit("T")), fraction, F.lit("+00:00"))
