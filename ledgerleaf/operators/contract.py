"""The strict contract of a model's structured reply, checked as data.

A reply is one JSON object with exactly six keys, alone or in one fenced block,
or the arguments of exactly one tool call.  Anything else is null: a reply is
never repaired or guessed at.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerleaf.functions import text as T

KEYS = ("documentType", "fields", "lineItems", "sections", "summary", "warnings")
KINDS = ("invoice", "manual", "other")
TYPE = "struct<documentType:string,summary:string,fields:map<string,string>,lineItems:array<struct<description:string,quantity:string,unitPrice:string,amount:string,taxRate:string>>,sections:array<string>,warnings:array<string>>"
MESSAGE = "struct<content:string,tool_calls:array<struct<type:string,function:struct<name:string,arguments:string>>>>"
TOOL = "submit_structured_document"


def structured_object(json: Column) -> Column:
    """The JSON text itself if it keeps the contract, else null."""

    def kind(v: Column, path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))

    def of(v: Column) -> Column:
        shape = (
            (F.array_sort(F.json_object_keys(json)) == F.array(*map(F.lit, KEYS)))
            & F.try_variant_get(v, "$.documentType", "string").isin(*KINDS)
            & (kind(v, "documentType") == "STRING")
            & (kind(v, "summary") == "STRING")
            & kind(v, "fields").startswith("OBJECT<")
            & kind(v, "lineItems").startswith("ARRAY<")
            & kind(v, "sections").startswith("ARRAY<")
            & kind(v, "warnings").isin("ARRAY<STRING>", "ARRAY<VOID>")
        )
        # An array with nulls would also read as one of strings.
        no_nulls = ~F.exists(F.coalesce(F.try_variant_get(v, "$.warnings", "array<variant>"), F.array().cast("array<variant>")), lambda w: F.schema_of_variant(w) != "STRING")
        return F.when(v.isNotNull() & shape & no_nulls, json)

    # The parser stops after one value; in both brackets nothing else can follow it.
    listed, keyed = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"x":'), json, F.lit("}")))
    return T.bind(F.when(keyed.isNotNull(), F.try_variant_get(listed, "$[0]", "variant")), of)


def structured_reply(content: Column) -> Column:
    """The object of a whole reply or of its one fenced block; null for anything else."""
    trimmed = T.trim_blanks(F.coalesce(content, F.lit("")))
    fence = T.pattern("\\A```(?:json)?~\\n?(.*?)\\n?```\\z")
    inner = F.when(trimmed.rlike(fence), T.trim_blanks(F.regexp_extract(trimmed, fence, 1))).otherwise(trimmed)
    return T.bind(inner, lambda c: F.when(c != "", structured_object(c)))


def structured_message(message: Column, tool: str = TOOL) -> Column:
    """The object of a chat message: of its one tool call if it has any, else of its content."""
    parsed = F.from_json(message, MESSAGE)
    calls = parsed["tool_calls"]
    has_calls = F.array_contains(F.coalesce(F.json_object_keys(message), F.array().cast("array<string>")), "tool_calls")
    call = F.get(calls, F.lit(0))
    right = (F.size(calls) == 1) & (call["type"] == "function") & (call["function"]["name"] == tool)
    return F.when(has_calls, F.when(right, structured_object(T.trim_blanks(call["function"]["arguments"])))).otherwise(structured_reply(parsed["content"]))


def lenient_block(content: Column) -> Column:
    """The first fenced JSON block or the outermost braces of a reply: for filling gaps only."""
    fenced = T.first_group(content, r"(?s)```json\s*(.*?)```")
    braces = T.first_group(content, r"(?s)(\{.*\})")
    return F.coalesce(fenced, braces, content)


def parsed_reply(json: Column) -> Column:
    """A checked reply as a struct."""
    return F.from_json(json, TYPE)


# Requests to a model and its replies, in the two usual shapes.


def request_body(text: Column, model: Column | str, system: str, max_tokens: int = 8000, messages_api: Column | bool = False) -> Column:
    """The JSON body that asks a model about a text: a list of chat messages, or a system text beside them."""
    model, messages_api = (F.lit(x) if isinstance(x, str | bool) else x for x in (model, messages_api))
    said = lambda role, what: F.struct(F.lit(role).alias("role"), what.alias("content"))
    chat = F.to_json(F.struct(model.alias("model"), F.array(said("system", F.lit(system)), said("user", text)).alias("messages"), F.lit(max_tokens).alias("max_tokens")))
    beside = F.to_json(F.struct(model.alias("model"), F.lit(max_tokens).alias("max_tokens"), F.lit(system).alias("system"), F.array(said("user", text)).alias("messages")))
    return F.when(messages_api, beside).otherwise(chat)


def reply_object(response: Column, messages_api: Column | bool = False, tool: str = TOOL) -> Column:
    """The checked object of a whole response: of its first choice's message, or of its joined text blocks; else null."""
    messages_api = F.lit(messages_api) if isinstance(messages_api, bool) else messages_api
    blocks = F.from_json(response, "struct<content:array<struct<type:string,text:string>>>")["content"]
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])
    beside = structured_reply(F.array_join(texts, ""))
    return F.when(messages_api, beside).otherwise(structured_message(F.get_json_object(response, "$.choices[0].message"), tool))
