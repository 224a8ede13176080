"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's parts are visited in order: text is escaped and kept, every other part becomes a
numbered placeholder and a row in the conversation's attachment list, with the number of
tokens it will expand to. The template writes a turn as

    <|role|>
    text<|end|>

and escapes, reversibly, every string inside a role or text that this template or the
common chat templates use as control.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PART_TYPE = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Control strings and their escaped form: a backslash after the first character. Backslashes are doubled before.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
OPEN, MID, END = "<|", "|>\n", "<|end|>\n"
#: Expanded tokens: an image is BASE plus PER_TILE for each TILE x TILE tile, audio has a rate a second, documents a number a page.
TILE, PER_TILE, BASE, PER_SECOND, PER_PAGE = 512, 170, 85, 25.0, 512


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for s in CONTROLS:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    """A pair of backslashes is one, a single one was put in by escape()."""
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def expanded_tokens(p: Column) -> Column:
    """Tokens that a part other than text takes once expanded; 0 for parts of unknown size or kind."""
    tiles = F.ceil(p["width"] / F.lit(TILE)) * F.ceil(p["height"] / F.lit(TILE))
    n = (
        F.when(p["type"] == "image", F.lit(BASE) + F.coalesce(tiles, F.lit(0)) * PER_TILE)
        .when(p["type"] == "audio", F.ceil(p["seconds"] * PER_SECOND))
        .when(p["type"] == "document", p["pages"].cast("long") * PER_PAGE)
    )
    return F.coalesce(n.cast("long"), F.lit(0).cast("long"))


def _is_text(p: Column) -> Column:
    return F.coalesce(p["type"], F.lit("text")) == "text"


def _body(parts: Column, at: Column) -> Column:
    """The escaped text of a turn; placeholder names hold the turn's place and the part's place."""
    place = lambda p, k: F.concat(F.lit("<|"), F.regexp_replace(p["type"], "[^A-Za-z0-9_]", "_"), F.lit(":"), at.cast("string"), F.lit("."), k.cast("string"), F.lit("|>"))
    flat = F.transform(parts, lambda p, k: F.when(_is_text(p), escape(p["text"])).otherwise(place(p, k)))
    return F.array_join(flat, "")


def _attachments(parts: Column, at: Column) -> Column:
    seen = F.transform(
        parts,
        lambda p, k: F.when(~_is_text(p), F.struct(at.alias("turn"), k.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))),
    )
    return F.filter(seen, lambda x: x.isNotNull())


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_mask, attachments, expanded_tokens.

    `turns` has conv_id, turn, role, text and, if given, parts (PART_TYPE); null parts mean the
    text alone. loss_mask lists struct(start, chars) in code points of `formatted`,
    one for each turn of `loss_role`.

    Turns are ordered by turn, then role and text, nulls first, so ties have a fixed order
    and repeated rows are kept as turns of their own. Null roles, texts and part texts
    are empty; a null conv_id is a conversation too; a turn's null or empty parts list is
    its text; an empty table gives no rows. All other columns are ignored.

    Turns are formatted where they are read; a conversation is then one string by
    definition and meets in one task, where its lengths are summed in a window.
    """
    single = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))
    parts = F.when(F.size("parts") > 0, F.col("parts")).otherwise(single) if "parts" in turns.columns else single
    role = F.coalesce(F.col("role"), F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"), parts.cast(PART_TYPE).alias("parts"))
    t = t.select("conv_id", "turn", "role", "text", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID)).alias("head"), "parts")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", F.to_json("parts"))
    t = t.withColumn("at", F.row_number().over(order))
    body = _body(F.col("parts"), F.col("at"))
    t = t.select("conv_id", "at", "role", "head", body.alias("body"), _attachments(F.col("parts"), F.col("at")).alias("att"))
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.char_length("head") + F.char_length("body") + len(END)
    t = t.withColumn("start", F.coalesce(F.sum(whole).over(before), F.lit(0)) + F.char_length("head"))
    got = t.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), "att"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("role") == loss_role, F.struct("start", F.char_length("body").cast("long").alias("chars"))))).alias("loss_mask"),
    )
    attachments = F.flatten(F.transform("pieces", lambda p: p["att"]))
    return got.select(
        "conv_id",
        F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        "loss_mask",
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text), unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|end\|>\n"), 1, F.size(F.split(formatted, r"<\|end\|>\n")) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MID, 1)).alias("role"),
            unescape(F.substr(p, F.locate(MID, p) + len(MID))).alias("text"),
        ),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """The unescaped text of all spans of a loss mask, cut out of the formatted conversation in their order."""
    cut = F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["chars"].cast("int"))))
    return F.array_join(cut, "")


def digests(chats: DataFrame) -> DataFrame:
    """What a reader of the output gets: turns, the text under the loss mask, their hashes, and the attachments' tokens."""
    t = chats.withColumn("_t", read_back(F.col("formatted")))
    every = F.array_join(F.transform("_t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = masked_text(F.col("formatted"), F.col("loss_mask"))
    return t.select(
        "conv_id",
        F.size("_t").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )


def oracle(source: str) -> str:
    """DuckDB SQL of digests(format_chat(...)) for turns without attachments."""
    esc = "replace({0}, '\\', '\\\\')"
    for s in CONTROLS:
        esc = f"replace({esc}, '{s}', '{s[0]}\\{s[1:]}')"
    return f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from ({source}))
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum({len(OPEN) + len(MID) + len(END)} + length({esc.format('role')}) + length({esc.format('text')}))::bigint as formatted_chars, 0::bigint as n_attachments, 0::bigint as expanded_tokens
from t group by conv_id"""
