"""Tables of the driver viewed as sessions, so that every operator runs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import lookup, ntz_micros
from .schema import ASSISTANT, BLOCK, CALL, EVENTS, RESULT, SYSTEM, USAGE, USER

#: Kinds of the tools that stand for clicks.
TOOLS = {"tool_0": "read", "tool_1": "edit", "tool_2": "search", "tool_3": "execute", "tool_4": "fetch", "tool_5": "think"}


def shaped(kind: T.StructType, /, **fields: Column) -> Column:
    """A struct of a payload type; fields that aren't given are NULL."""
    return F.struct(*((fields[f.name].cast(f.dataType) if f.name in fields else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields))


def text_blocks(text: Column) -> Column:
    return F.array(shaped(BLOCK, kind=F.lit("text"), text=text))


def _wide(rows: DataFrame, payloads: dict[str, Column], **columns: Column) -> DataFrame:
    """The event table from rows and the columns that are known; the others are NULL."""
    out = []
    for f in EVENTS.fields:
        if f.name in payloads:
            out.append(payloads[f.name].alias(f.name))
        elif f.name in columns:
            out.append(columns[f.name].cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return rows.select(*out)


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` by user: sign-ups speak, clicks call tools, views and errors are results, purchases answer."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    # Dealt by the key that every operator groups by, so that none of them deals the rows again.
    order = Window.partitionBy("session_key").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = rows.select("event_id", F.col("user_id").cast("string").alias("session_key"), "event_type", "value", "props", "ts", k.alias("k")).withColumn("seq", F.row_number().over(order) - 1)
    is_type = lambda t: F.col("event_type") == t
    name = F.concat(F.lit("tool_"), (F.col("k") % 7).cast("string"))
    ident = F.col("k").cast("string")
    usage = shaped(USAGE, input_tokens=F.col("k"), output_tokens=F.floor("value"), cache_read_input_tokens=F.lit(0), cache_creation_input_tokens=F.lit(0))
    payloads = {
        "user_message": F.when(is_type("signup"), shaped(USER, origin=F.when(F.col("k") % 5 == 0, "harness").otherwise("human"), content=text_blocks(F.col("props")))),
        "tool_call": F.when(is_type("click"), shaped(CALL, tool_call_id=ident, name=name, kind=lookup(name, TOOLS, "other"), input=F.col("props"))),
        "tool_result": F.when(is_type("view") | is_type("error"), shaped(RESULT, tool_call_id=ident, is_error=is_type("error"), content=text_blocks(F.col("props")))),
        "assistant_message": F.when(is_type("purchase"), shaped(ASSISTANT, model=F.concat(F.lit("m"), (F.col("k") % 3).cast("string")), content=text_blocks(F.concat(F.lit("bought "), ident)), usage=usage)),
    }
    kind = F.when(is_type("signup"), "user_message").when(is_type("click"), "tool_call").when(is_type("purchase"), "assistant_message").otherwise("tool_result")
    return _wide(rows, payloads, session_key=F.col("session_key"), seq=F.col("seq"), kind=kind, ts_us=ntz_micros(F.col("ts")), line=F.col("seq") + 1, end_line=F.col("seq") + 1, id=F.col("event_id").cast("string"))


def conversation_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` by id: users and assistants speak, the rest are system events."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    order = Window.partitionBy("session_key").orderBy("turn", "role", "text")
    rows = rows.select(F.col("conv_id").cast("string").alias("session_key"), "turn", "role", "text").withColumn("seq", F.row_number().over(order) - 1)
    is_role = lambda r: F.coalesce(F.col("role") == r, F.lit(False))
    payloads = {
        "user_message": F.when(is_role("user"), shaped(USER, origin=F.lit("human"), content=text_blocks(F.col("text")))),
        "assistant_message": F.when(is_role("assistant"), shaped(ASSISTANT, content=text_blocks(F.col("text")))),
        "system": F.when(~is_role("user") & ~is_role("assistant"), shaped(SYSTEM, subtype=F.concat(F.lit("message/"), F.coalesce("role", F.lit(""))), text=F.col("text"))),
    }
    kind = F.when(is_role("user"), "user_message").when(is_role("assistant"), "assistant_message").otherwise("system")
    return _wide(rows, payloads, session_key=F.col("session_key"), seq=F.col("seq"), kind=kind, line=F.col("seq") + 1, end_line=F.col("seq") + 1)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def _block(kind: str, text: Column) -> Column:
    return F.array(F.struct(F.lit(kind).alias("type"), text.alias("text")))


def native_lines(spark: SparkSession, sf_dir: str, harness: str) -> DataFrame:
    """``conversations`` written as native records of a format: session_key, line, text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    key = F.col("session_key")
    order = Window.partitionBy(key).orderBy("turn", "role", "text")
    rows = rows.withColumn("session_key", F.col("conv_id").cast("string")).withColumn("n", F.row_number().over(order)).withColumn("text", F.coalesce("text", F.lit("")))
    at = F.lit("2026-01-01T00:00:00Z")
    role, text = F.col("role"), F.col("text")
    if harness == "codex":
        item = F.struct(F.lit("message").alias("type"), role.alias("role"), _block("input_text", text).alias("content"))
        said = _json(timestamp=at, type=F.lit("response_item"), payload=item)
        tokens = _json(timestamp=at, type=F.lit("event_msg"), payload=F.struct(F.lit("token_count").alias("type"), F.struct(F.struct(F.length(text).alias("input_tokens"), F.col("n").alias("output_tokens")).alias("last_token_usage")).alias("info")))
        head = _json(timestamp=at, type=F.lit("session_meta"), payload=F.struct(key.alias("id"), F.lit("0.144.1").alias("cli_version")))
        parts = F.concat(F.when(F.col("n") == 1, F.array(head)).otherwise(F.array().cast("array<string>")), F.array(said), F.when(role == "assistant", F.array(tokens)).otherwise(F.array().cast("array<string>")))
    elif harness == "claude-code":
        common = {"uuid": F.concat(key, F.lit("-"), F.col("n").cast("string")), "sessionId": key, "version": F.lit("2.1.200"), "timestamp": at}
        user = _json(type=F.lit("user"), message=F.struct(text.alias("content")), **common)
        answer = F.struct(F.concat(F.lit("msg-"), F.col("n").cast("string")).alias("id"), F.lit("m").alias("model"), _block("text", text).alias("content"), F.struct(F.length(text).alias("input_tokens"), F.col("n").alias("output_tokens")).alias("usage"))
        system = _json(type=F.lit("system"), subtype=F.lit("note"), content=text, **common)
        parts = F.array(F.when(role == "user", user).when(role == "assistant", _json(type=F.lit("assistant"), message=answer, **common)).otherwise(system))
    else:
        common = {"step_index": F.col("n"), "created_at": at, "content": text}
        kind = F.when(role == "user", "USER_INPUT").when(role == "assistant", "PLANNER_RESPONSE").otherwise("SYSTEM_MESSAGE")
        parts = F.array(_json(source=F.lit("MODEL"), type=kind, **common))
    lines = rows.select(key, "n", F.posexplode(parts).alias("i", "text"))
    number = Window.partitionBy("session_key").orderBy("n", "i")
    return lines.select("session_key", F.row_number().over(number).alias("line"), "text")


