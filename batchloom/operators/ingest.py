"""Request lines: scan, validation, duplicates, models, offsets and the dispatch plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import prefix_hash, safe_model


def message_text(content: Column) -> Column:
    """Text of a message's content (JSON): a string, or its text parts joined; '' if null; null where it is of another kind."""
    kind = F.substring(F.trim(content), 1, 1)
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    plain = F.get_json_object(F.concat(F.lit('{"v":'), content, F.lit("}")), "$.v")
    return F.when(content.isNull() | (F.trim(content) == "null") | (F.trim(content) == ""), F.lit("")).when(kind == '"', plain).when(kind == "[", joined)


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Request fields of JSON lines: custom_id, method, url, model, stream, system_text, system_ok, parsed.

    The prefix is the first system message with text; system content of another kind makes the line bad,
    other roles' content isn't looked at.
    """
    text = F.col(column)
    messages = F.from_json(F.get_json_object(text, "$.body.messages"), "array<string>")
    system = F.filter(messages, lambda m: F.get_json_object(m, "$.role") == "system")
    raw = F.transform(system, lambda m: F.to_json(F.try_variant_get(F.try_parse_json(m), "$.content", "variant")))
    texts = F.transform(F.coalesce(raw, F.array().cast("array<string>")), message_text)
    # Only what stands before the first text counts: a bad one after it isn't reached.
    first = F.get(F.filter(texts, lambda t: t.isNull() | (t != "")), F.lit(0))
    none = F.size(F.filter(texts, lambda t: t.isNull() | (t != ""))) == 0
    return lines.withColumns(
        {
            "parsed": F.try_parse_json(text).isNotNull(),
            "custom_id": F.get_json_object(text, "$.custom_id"),
            "method": F.get_json_object(text, "$.method"),
            "url": F.get_json_object(text, "$.url"),
            "model": F.get_json_object(text, "$.body.model"),
            "stream": F.coalesce(F.get_json_object(text, "$.body.stream") == "true", F.lit(False)),
            "system_text": F.coalesce(first, F.lit("")),
            "system_ok": none | first.isNotNull(),
        }
    )


def reject_reason(batch_endpoint: str, endpoints: Sequence[str] = S.ENDPOINTS, parsed: Column | None = None, system_ok: Column | None = None) -> Column:
    """The first rule that a request breaks, or null: the order of the rules is part of the result."""
    c = F.col
    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    yes = F.lit(True)
    return (
        F.when(~(parsed if parsed is not None else yes), "invalid json")
        .when(blank("custom_id"), "custom_id is required")
        .when(blank("method"), "method is required")
        .when(c("method") != "POST", "invalid method")
        .when(blank("url"), "url is required")
        .when(~c("url").startswith("/") | c("url").startswith("//") | c("url").contains("://"), "url must be relative")
        .when(~c("url").isin(*endpoints), "invalid endpoint")
        .when(c("url") != batch_endpoint, "endpoint mismatch")
        .when(blank("model"), "model is empty")
        .when(F.coalesce(c("stream"), F.lit(False)), "streaming is not supported")
        .when(~(system_ok if system_ok is not None else yes), "system content")
    )


def duplicates(requests: DataFrame) -> DataFrame:
    """Second and later requests of a batch with one custom_id."""
    order = W.partitionBy("batch_id", "custom_id").orderBy("ordinal")
    return requests.withColumn("occurrence", F.row_number().over(order)).filter("occurrence > 1")


def batch_validity(requests: DataFrame, reason: Column) -> DataFrame:
    """Per batch: lines, and the first line that fails it, by a broken rule or a repeated custom_id."""
    again = F.row_number().over(W.partitionBy("batch_id", "custom_id").orderBy("ordinal")) > 1
    bad = requests.withColumn("bad", reason.isNotNull() | again)
    return bad.groupBy("batch_id").agg(F.count("*").alias("lines"), F.min(F.when(F.col("bad"), F.col("ordinal"))).alias("first_bad"), (F.count_if("bad") == 0).alias("valid"))


def unregistered(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests whose model isn't registered: they are rejected one by one, the batch goes on."""
    return requests.join(registry.select("model"), "model", "left_anti").withColumn("error_code", F.lit("model_not_found"))


def model_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("batch_id", "model").agg(F.count("*").alias("requests"))


def offsets(lines: DataFrame, size: Column) -> DataFrame:
    """Adds offset and length of each line: a line's bytes and its line feed."""
    before = W.partitionBy("batch_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("length", (size + 1).cast("long")).withColumn("offset", F.coalesce(F.sum(size + 1).over(before), F.lit(0)).cast("long"))


def plan(requests: DataFrame) -> DataFrame:
    """Adds prefix_hash and the dispatch position within (batch, model): equal prompts together, no prompt last."""
    hashed = requests.withColumn("prefix_hash", prefix_hash(F.col("system_text")))
    return hashed.withColumn("position", F.row_number().over(W.partitionBy("batch_id", "model").orderBy("prefix_hash", "ordinal")).cast("long"))


def lines_at(plan_entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Plan entries with their lines: a join on the ordinal instead of seeks."""
    return plan_entries.join(lines, ["batch_id", "ordinal"])


def safe_names(models: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., model, first_seen) with file names within a job: collisions are numbered in first-seen order, and no number takes a name in use."""
    based = models.withColumn("base", safe_model(F.col("model")))
    ordered = F.sort_array(F.collect_list(F.struct("first_seen", "model", "base")))
    # A fold over all models of a job, a few by nature: each takes its base, or the next number that is free.
    empty = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<model:string,safe_name:string>>").alias("out"))

    def name(state: Column, row: Column) -> Column:
        base, used = row["base"], state["used"]
        numbers = F.sequence(F.lit(2), F.size(used) + 2)
        numbered = F.transform(numbers, lambda n: F.concat(base, F.lit("_"), n.cast("string")))
        free = F.get(F.filter(numbered, lambda x: ~F.array_contains(used, x)), F.lit(0))
        chosen = F.when(F.array_contains(used, base), free).otherwise(base)
        return F.struct(F.array_append(used, chosen).alias("used"), F.array_append(state["out"], F.struct(row["model"].alias("model"), chosen.alias("safe_name"))).alias("out"))

    return based.groupBy(*by).agg(F.aggregate(ordered, empty, name)["out"].alias("out")).select(*by, F.inline("out"))


def file_totals(texts: DataFrame, column: str = "text") -> DataFrame:
    """Bytes and lines of each file; a last line without its line feed counts."""
    t = F.coalesce(F.col(column), F.lit(""))
    feeds = F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit("")))
    open_line = (t != "") & ~t.endswith("\n")
    return texts.withColumn("bytes", F.octet_length(t).cast("long")).withColumn("lines", (feeds + open_line.cast("int")).cast("long"))


def route_key(tenant: Column, model: Column, per_tenant: bool) -> Column:
    return F.concat_ws("/", tenant, model) if per_tenant else model


def request_headers(headers: Column, deadline_ms: Column, now_ms: Column, objective: Column, tenant: Column) -> Column:
    """Headers of a dispatched request: time left if any, objective, and the tenant unless a fairness id is given."""
    left = deadline_ms - now_ms
    entry = lambda k, v: F.map_from_arrays(F.array(F.lit(k)), F.array(v))
    none = F.create_map().cast("map<string,string>")
    out = F.map_concat(headers, F.when(left >= 0, entry("x-slo-ttft-ms", left.cast("string"))).otherwise(none))
    out = F.map_concat(out, F.when(F.coalesce(objective, F.lit("")) != "", entry("x-gateway-inference-objective", objective)).otherwise(none))
    fair = "x-gateway-inference-fairness-id"
    return F.map_concat(out, F.when(F.map_contains_key(headers, fair), none).otherwise(entry(fair, tenant)))
