"""Chat formatting with typed content parts; DataFrame functions only.

A turn's content is an array of parts (type, text, ref, units). A visitor flattens the
parts of a conversation in order: text is escaped and copied, any other part becomes a
placeholder ``<image 0>`` numbered through the conversation, and an attachment row records
its reference and the tokens it expands to. The template is

    <turn ROLE>\\n BODY </turn>\\n      (without the blanks around BODY)

``&`` and ``<`` (and ``>`` in roles) are escaped as in markup, so ``<`` occurs in control
strings alone and escaping is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import table

#: Tokens for one unit of a part: an image tile, a second of audio, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 600}
#: Tokens of any such part besides its units.
FIXED_TOKENS = {"image": 2, "audio": 2, "document": 2}
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"
END = "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("&gt;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&gt;"), F.lit(">")))


def text_part(text: Column) -> Column:
    """Content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))).cast(PARTS)


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visit(part: Column, number: Column) -> Column:
    """The part's place in the formatted text."""
    return F.when(is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<"), F.regexp_replace(part["type"], r"[<>&\s]", "_"), F.lit(" "), number.cast("string"), F.lit(">"))
    )


def expanded_tokens(part: Column, unit_tokens: dict[str, int], fixed_tokens: dict[str, int]) -> Column:
    found = F.lit(None).cast("long")
    for kind, each in unit_tokens.items():
        found = F.when(part["type"] == kind, F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0)) * each + fixed_tokens.get(kind, 0)).otherwise(found)
    return F.coalesce(found, F.lit(0)).cast("long")


def format_conversations(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), unit_tokens: dict[str, int] = UNIT_TOKENS, fixed_tokens: dict[str, int] = FIXED_TOKENS) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, content or text).

    conv_id; formatted string; n_turns; loss_spans array<struct<start,length>>, in code
    points of ``formatted`` from 0; attachments array<struct<number,type,ref,tokens,turn>>;
    media_tokens long, their sum.

    Turns are ordered by (turn, role, content), null turns first, so ties and repeated rows
    come out alike each time, and repeated rows stay. Null roles and texts are empty. Null
    conv_ids are one conversation. Parts of an unknown type get a placeholder and no tokens.
    Very long texts are taken whole; time grows with the turns of a conversation, not with
    their square. Extra columns are left out. No rows: no conversations.
    """
    content = F.col("content").cast(PARTS) if "content" in rows.columns else text_part(F.coalesce(F.col("text"), F.lit("")))
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(content, F.array().cast(PARTS)).alias("parts"))
    # Placeholders and code points before each turn are running sums over its conversation,
    # whose rows are in one place already for the lists below: one shuffle in all.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    n_media = F.size(F.filter("parts", lambda p: ~is_text(p)))
    numbered = turns.select("*", (F.row_number().over(order) - 1).alias("k"), F.coalesce(F.sum(n_media).over(ahead), zero).cast("int").alias("before"))

    def number(p: Column) -> Column:
        return F.col("before") + F.size(F.filter(F.slice("parts", 1, p), lambda q: ~is_text(q)))

    body = F.array_join(F.transform("parts", lambda q, p: F.when(is_text(q), visit(q, zero)).otherwise(visit(q, number(p)))), "")
    attached = F.filter(
        F.transform("parts", lambda q, p: F.when(~is_text(q), F.struct(number(p).alias("number"), q["type"].alias("type"), q["ref"].alias("ref"), expanded_tokens(q, unit_tokens, fixed_tokens).alias("tokens"), F.col("k").alias("turn")))),
        lambda x: x.isNotNull(),
    )
    head = F.concat(F.lit("<turn "), escape_role(F.col("role")), F.lit(">\n"))
    built = numbered.select("conv_id", "k", head.alias("head"), body.alias("body"), F.col("role").isin(*loss_roles).alias("loss"), attached.alias("attached"))
    size = F.length("head") + F.length("body") + len(END)
    by_place = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = built.withColumn("start", F.coalesce(F.sum(size).over(by_place), zero) + F.length("head"))
    span = F.when(F.col("loss"), F.struct("start", F.length("body").cast("long").alias("length")))
    turn = F.struct("k", F.concat("head", "body", F.lit(END)).alias("said"), span.alias("span"), "attached")
    convs = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("ts"))
    attachments = F.flatten(F.transform("ts", lambda t: t["attached"]))
    return convs.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["said"]), "").alias("formatted"),
        F.size("ts").cast("long").alias("n_turns"),
        F.filter(F.transform("ts", lambda t: t["span"]), lambda x: x.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, zero, lambda a, x: a + x["tokens"]).alias("media_tokens"),
    )


def parse_turns(formatted: Column) -> Column:
    """array<struct<role,text>> back from the formatted text; placeholders stay in texts."""
    pieces = F.filter(F.split(formatted, END), lambda x: x != "")

    def turn(x: Column) -> Column:
        end = F.locate(">\n", x)
        return F.struct(unescape_role(x.substr(F.lit(7), end - 7)).alias("role"), unescape(x.substr(end + 2, F.length(x))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


CONTROL_SAMPLE = r"\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sample = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_SAMPLE).alias("text"))
    out = format_conversations(rows.unionByName(sample))
    read = out.select("conv_id", parse_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP5_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_SAMPLE}'
  UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_SAMPLE}'
), sized AS (
  SELECT *, length('<turn ' || replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(62) || chr(10))
    + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 8 AS chars
  FROM rows
), convs AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(chars) AS chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256,
  CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM convs
"""
