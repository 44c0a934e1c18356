"""Request payloads as rows of text blocks, and what may be changed in them.

A block is (request_id, kind, msg_idx, block_idx, sub_idx, role, block_type, text, has_marker, plain); kind is system,
tools or message. Blocks at or before the last cache marker of a request (the wall) must stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.text import estimate_tokens

#: The order in which parts of a request are cached.
KIND_ORDER = {"system": 0, "tools": 1, "message": 2}

_LIST, _VARIANT = "array<variant>", "variant"


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", _VARIANT)


def _list(value: Column) -> Column:
    """The items of a list; null for anything else."""
    return F.try_variant_get(value, "$", _LIST)


def _string(value: Column) -> Column:
    """A string; null for anything else, numbers and objects too."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _parts(request: Column) -> Column:
    """kind, msg_idx, role and content of the parts of a request that hold blocks."""
    none = F.lit(None)
    part = lambda kind, msg_idx, role, content: F.struct(F.lit(kind).alias("kind"), msg_idx.cast("int").alias("msg_idx"), role.cast("string").alias("role"), content.alias("content"))
    messages = F.coalesce(_list(_field(request, "messages")), F.array().cast(_LIST))
    said = F.transform(messages, lambda m, i: part("message", i, F.when(_is_object(m), _string(_field(m, "role"))), F.when(_is_object(m), _field(m, "content"))))
    return F.concat(F.array(part("system", none, none, _field(request, "system")), part("tools", none, none, _field(request, "tools"))), said)


def blocks(requests: DataFrame, id_col: str = "request_id", payload_col: str = "payload") -> DataFrame:
    """Blocks of JSON payloads, a row for each, or for each text of a tool result that has a list of them (sub_idx).

    A content that is a string is one block of type text, and plain. Types decide, never what a text looks like: a text
    may begin with a bracket. Blocks without a text (tools, images, unknown shapes) are rows with a null text, for they may
    hold a marker; items that are no objects are none. Payloads that are null or no JSON objects have no blocks."""
    requests = requests.select(F.col(id_col).alias("request_id"), F.try_parse_json(F.col(payload_col)).alias("p")).filter(_is_object(F.col("p")))
    rows = requests.select("request_id", F.explode(_parts(F.col("p"))).alias("c")).select("request_id", "c.*")
    item = lambda plain, i, v: F.struct(F.lit(plain).alias("plain"), F.lit(i).cast("int").alias("block_idx") if isinstance(i, int) else i.cast("int").alias("block_idx"), v.alias("b"))
    whole = (F.col("kind") != "tools") & _string(F.col("content")).isNotNull()
    each = F.when(whole, F.array(item(True, 0, F.col("content")))).otherwise(F.transform(_list(F.col("content")), lambda v, i: item(False, i, v)))
    rows = rows.select("request_id", "kind", "msg_idx", "role", F.explode(each).alias("i")).select("request_id", "kind", "msg_idx", "role", "i.*").filter(F.col("plain") | _is_object(F.col("b")))
    kind = F.when(F.col("plain"), "text").otherwise(_string(_field(F.col("b"), "type")))
    told = F.coalesce(kind == "tool_result", F.lit(False)) & ~F.col("plain")
    inner = F.when(told, _field(F.col("b"), "content"))
    text = F.when(F.col("plain"), _string(F.col("b"))).when(told, _string(inner)).when(F.col("kind") != "tools", _string(_field(F.col("b"), "text")))
    none = F.lit(None).cast("int")
    one = F.array(F.struct(none.alias("sub_idx"), text.alias("text")))
    # Items that aren't texts keep their places: only texts make rows, but a list without any makes one row.
    subs = F.filter(F.transform(_list(inner), lambda v, i: F.struct(i.alias("sub_idx"), F.when(_is_object(v), F.when(_string(_field(v, "type")) == "text", _string(_field(v, "text")))).alias("text"))), lambda x: x["text"].isNotNull())
    rows = rows.withColumn("s", F.explode(F.when(F.size(subs) > 0, subs).otherwise(one)))
    marked = ~F.col("plain") & _field(F.col("b"), "cache_control").isNotNull()
    return rows.select("request_id", "kind", "msg_idx", "block_idx", F.col("s.sub_idx").alias("sub_idx"), "role", kind.alias("block_type"), F.col("s.text").alias("text"), marked.alias("has_marker"), "plain")


def nested_texts(requests: DataFrame, id_col: str = "request_id", payload_col: str = "payload", levels: int | None = None) -> DataFrame:
    """request_id, kind, msg_idx, role, level and text of every string below the contents: strings in lists, the text of
    a block and its content, and so on down contents within contents, `levels` deep (None: to the end).

    Each level is a projection and an explode of the one above it; the loop ends with the first level that is empty."""
    requests = requests.select(F.col(id_col).alias("request_id"), F.try_parse_json(F.col(payload_col)).alias("p")).filter(_is_object(F.col("p")))
    rows = requests.select("request_id", F.explode(_parts(F.col("p"))).alias("c")).select("request_id", "c.*").filter("kind <> 'tools'")
    keep = ["request_id", "kind", "msg_idx", "role"]
    out = rows.select(*keep, F.lit(0).alias("level"), _string(F.col("content")).alias("text"))
    level = 0
    while levels is None or level < levels:
        level += 1
        rows = rows.select(*keep, F.explode(_list(F.col("content"))).alias("b"))
        if rows.isEmpty():
            break
        inner = F.when(_is_object(F.col("b")), _field(F.col("b"), "content"))
        said = F.array(_string(F.col("b")), F.when(_is_object(F.col("b")), _string(_field(F.col("b"), "text"))), _string(inner))
        out = out.unionByName(rows.select(*keep, F.lit(level).alias("level"), F.explode(said).alias("text")))
        rows = rows.select(*keep, inner.alias("content"))
    return out.filter("text is not null")


def nested_tokens(texts: DataFrame) -> DataFrame:
    """request_id, part (system, or the message's number) and tokens, of nested_texts."""
    part = F.when(F.col("kind") == "message", F.col("msg_idx").cast("string")).otherwise(F.col("kind"))
    return texts.groupBy("request_id", part.alias("part")).agg(F.sum(estimate_tokens(F.col("text")).cast("long")).alias("tokens"))


def _position() -> Column:
    order = F.create_map(*(F.lit(x) for kv in KIND_ORDER.items() for x in kv))[F.col("kind")]
    return F.struct(order.alias("kind"), F.coalesce("msg_idx", F.lit(-1)).alias("msg"), F.coalesce("block_idx", F.lit(-1)).alias("block"))


def with_wall(rows: DataFrame, kinds: tuple[str, ...] = ("system", "tools", "message")) -> DataFrame:
    """rows with protected: at or before the request's last marker among kinds; without a marker nothing is."""
    wall = F.max(F.when(F.col("has_marker") & F.col("kind").isin(*kinds), _position())).over(Window.partitionBy("request_id"))
    return rows.withColumn("protected", F.coalesce(_position() <= wall, F.lit(False)))


def volatile(rows: DataFrame) -> DataFrame:
    """Message blocks after the wall."""
    return with_wall(rows).filter("kind = 'message' and not protected").drop("protected")


def with_marker(rows: DataFrame) -> DataFrame:
    """rows of requests without a marker get one on the last tool, or else on the last block of the system."""
    any_marker = F.max("has_marker").over(Window.partitionBy("request_id"))
    last = F.max(F.when(F.col("kind").isin("system", "tools") & ~(F.col("plain") & (F.col("text") == "")), _position())).over(Window.partitionBy("request_id"))
    return rows.withColumn("has_marker", F.col("has_marker") | (~any_marker & _position().eqNullSafe(last)))


def json_path() -> Column:
    """Where a row's text is in the payload."""
    place = F.when(F.col("kind") == "message", F.concat(F.lit("messages["), F.col("msg_idx"), F.lit("].content"))).otherwise(F.col("kind"))
    block = F.concat(place, F.lit("["), F.col("block_idx"), F.lit("]"))
    inner = F.when(F.col("block_type").eqNullSafe("tool_result"), F.lit(".content")).otherwise(F.lit(".text"))
    sub = F.when(F.col("sub_idx").isNotNull(), F.concat(F.lit("["), F.col("sub_idx"), F.lit("].text"))).otherwise("")
    return F.when(F.col("plain"), place).otherwise(F.concat(block, inner, sub))


def block_path() -> Column:
    place = F.when(F.col("kind") == "message", F.concat(F.lit("messages["), F.col("msg_idx"), F.lit("].content["), F.col("block_idx"), F.lit("]"))).otherwise(F.concat("kind", F.lit("["), "block_idx", F.lit("]")))
    return F.concat(place, F.when(F.col("sub_idx").isNotNull(), F.concat(F.lit(".content["), F.col("sub_idx"), F.lit("]"))).otherwise(""))


def prefix_unchanged(original: Column, outgoing: Column, has_marker: Column, prefix: Column | None = None) -> Column:
    """Whether the bytes before the wall are as they were: the first prefix of them, or as many as both have. Without a
    marker there is no wall and nothing to keep."""
    original, outgoing = original.cast("binary"), outgoing.cast("binary")
    n = F.least(F.octet_length(original), F.octet_length(outgoing)) if prefix is None else prefix
    return ~has_marker | (F.substring(original, F.lit(1), n) == F.substring(outgoing, F.lit(1), n))


def largest_sub(rows: DataFrame) -> DataFrame:
    """Of the texts of each tool result, the longest, the first on ties."""
    w = Window.partitionBy("request_id", "kind", "msg_idx", "block_idx").orderBy(F.desc(F.length("text")), "sub_idx")
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def token_totals(rows: DataFrame) -> DataFrame:
    """request_id, role, tokens, and each request's total (role null, total true)."""
    known = rows.select("request_id", F.when(F.col("kind") == "message", F.coalesce("role", F.lit("unknown"))).otherwise(F.col("kind")).alias("role"), estimate_tokens(F.col("text")).alias("t"))
    return known.groupingSets([["request_id", "role"], ["request_id"]], "request_id", "role").agg(F.sum("t").alias("tokens"), (F.grouping("role") == 1).alias("total"))


def preview(rows: DataFrame, before: str, after: str) -> DataFrame:
    """One row: characters and estimated tokens before and after, saved, and saved percent."""
    out = rows.agg(
        F.sum(F.length(before)).alias("chars_in"), F.sum(F.length(after)).alias("chars_out"),
        F.sum(estimate_tokens(F.col(before))).alias("tokens_in"), F.sum(estimate_tokens(F.col(after))).alias("tokens_out"),
    )
    saved = F.greatest(F.lit(0), F.col("chars_in") - F.col("chars_out"))
    return out.withColumn("saved", saved).withColumn("saved_pct", F.when(F.col("chars_in") > 0, F.round(100.0 * F.col("saved") / F.col("chars_in"), 2)).otherwise(0.0))
