"""Metrics, workflow, agent, chat, stream and session logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.functions.text import trim_ws

# Histogram bounds in seconds and of confidences.
API_BUCKETS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0)
INFERENCE_BUCKETS = (0.001, 0.01, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0)
BROWSER_BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0)
MODEL_BUCKETS = (0.001, 0.01, 0.1, 0.5, 1.0, 2.0, 5.0)
PARSE_BUCKETS = (0.001, 0.01, 0.1, 0.5, 1.0, 2.0)
CONFIDENCE_BUCKETS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
FINISH = "FINISH"


def counters(log: DataFrame, *labels: str) -> DataFrame:
    return log.groupBy(*labels).agg(F.count("*").alias("total"))


def errors(log: DataFrame, *labels: str) -> DataFrame:
    """Requests whose status does not start with 2, per label; labels without any are absent."""
    return counters(log.filter(~F.col("status").startswith("2")), *labels)


def histogram(log: DataFrame, value: str, bounds: tuple[float, ...], *labels: str) -> DataFrame:
    """``labels.., le, n``: cumulative counts per bound, ``+Inf``, and ``sum`` and ``count`` rows.

    One aggregate per label computes every bound at once; no join with the bounds.
    """
    v = F.col(value)
    aggs = [F.count_if(v <= b).cast("double").alias(f"b{i}") for i, b in enumerate(bounds)]
    g = log.filter(v.isNotNull()).groupBy(*labels).agg(*aggs, F.sum(v).alias("s"), F.count("*").cast("double").alias("c"))
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells += [F.struct(F.lit(n).alias("le"), F.col(c).alias("n")) for n, c in (("+Inf", "c"), ("sum", "s"), ("count", "c"))]
    return g.select(*labels, F.explode(F.array(*cells)).alias("x")).select(*labels, "x.le", "x.n")


def gauge(log: DataFrame, value: str, order: list[str], *labels: str) -> DataFrame:
    """Last value per label."""
    return log.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias("value"))


def exposition(metric: Column, labels: Column, value: Column) -> Column:
    """``name{k="v",..} value``; keys in order, no braces without labels."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    body = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return F.concat(metric, body, F.lit(" "), value.cast("string"))


def workflow_progress(steps: DataFrame) -> DataFrame:
    """Per workflow: steps, successes, failures, rate, whole seconds from first to last."""
    ok = F.count_if(F.col("success"))
    n = F.count("step_name")
    return steps.groupBy("workflow_id").agg(
        n.alias("total_steps"), ok.alias("successful_steps"), (n - ok).alias("failed_steps"),
        F.when(n > 0, ok / n).otherwise(0.0).alias("success_rate"),
        F.timestamp_diff("SECOND", F.min("timestamp"), F.max("timestamp")).alias("duration_seconds"),
    )


def token_usage(usage: DataFrame, *labels: str) -> DataFrame:
    p, c = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    return usage.groupBy(*labels).agg(F.sum(p).alias("prompt_tokens"), F.sum(c).alias("completion_tokens"), F.sum(p + c).alias("total_tokens"))


def agent_step(content: Column) -> Column:
    """Struct ``thought, action, input, input_json`` of an agent message.

    The last line of each kind counts; an empty thought means the whole message.
    """
    lines = F.transform(F.split(content, r"\r?\n"), trim_ws)

    def last(prefix: str) -> Column:
        found = F.filter(lines, lambda x: x.startswith(prefix))
        return trim_ws(F.substr(F.try_element_at(found, F.lit(-1)), F.lit(len(prefix) + 1)))

    thought, raw = last("THOUGHT:"), last("ACTION INPUT:")
    return F.struct(
        F.when(F.coalesce(thought, F.lit("")) == "", content).otherwise(thought).alias("thought"),
        last("ACTION:").alias("action"), raw.alias("input"), F.try_parse_json(raw).isNotNull().alias("input_json"),
    )


def agent_steps(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, thought, action, input, input_json`` of the assistant's messages."""
    return messages.filter("role = 'assistant'").select("conv_id", "turn", agent_step(F.col("text")).alias("x")).select("conv_id", "turn", "x.*")


def agent_outcome(messages: DataFrame, max_iterations: int | None = None) -> DataFrame:
    """``conv_id, success, result, iterations``: how each run ended, and after how many messages of the assistant.

    With ``max_iterations``, a run whose first finish comes later, or never, has failed by that limit; the count is real all the same.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    first = messages.filter("role = 'assistant'").withColumn("i", F.row_number().over(w))
    s = first.select("conv_id", "i", agent_step(F.col("text")).alias("x")).select("conv_id", "i", "x.*")
    text = F.when(~F.col("input_json"), F.col("input")).when(F.col("input").startswith('"'), F.from_json(
        F.concat(F.lit("["), F.col("input"), F.lit("]")), "array<string>")[0])
    done = F.upper("action") == FINISH
    over = F.lit(False) if max_iterations is None else F.col("n") >= max_iterations
    if max_iterations is not None:
        done = done & (F.col("i") <= max_iterations)
    g = s.groupBy("conv_id").agg(
        F.min(F.when(done, F.struct("i", F.coalesce(text, "thought").alias("result")))).alias("end"), F.max("i").alias("n"))
    return g.select(
        "conv_id", F.col("end").isNotNull().alias("success"),
        F.when(F.col("end").isNotNull(), F.col("end.result")).when(over, "Maximum iterations reached").alias("result"),
        F.coalesce("end.i", "n").alias("iterations"),
    )


def chat_export_system(messages: DataFrame) -> DataFrame:
    """Messages with tool as user, and the run's system texts joined by newline beside them."""
    system = messages.filter("role = 'system'").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x")).select("conv_id", F.array_join("x.text", "\n").alias("system"))
    rest = messages.filter("role <> 'system'").select(
        "conv_id", "turn", F.when(F.col("role") == "tool", "user").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))
    return rest.join(system, "conv_id", "full_outer").select("conv_id", "turn", "role", "content", "system")


def content_block(block: Column) -> Column:
    """Struct ``type, text, url`` of a block; inline images become data URLs."""
    data = F.concat(F.lit("data:"), block["media_type"], F.lit(";base64,"), block["data"])
    is_text = block["type"] == "text"
    return F.struct(
        F.when(is_text, "text").otherwise("image_url").alias("type"), F.when(is_text, block["text"]).alias("text"),
        F.when(~is_text, F.coalesce(block["url"], data)).alias("url"),
    )


def chat_export_flat(messages: DataFrame) -> DataFrame:
    """One row per message, tool as assistant; block arrays (column ``blocks``) converted."""
    return messages.select(
        "conv_id", "turn", F.when(F.col("role") == "tool", "assistant").otherwise(F.col("role")).alias("role"), "text",
        F.transform("blocks", content_block).alias("blocks"))


def tool_schema(definition: Column) -> Column:
    """Struct ``name, description, parameters``; null unless all are there and the first two are strings."""
    v = F.try_parse_json(definition)

    def text(path: str) -> Column:
        x = F.try_variant_get(v, path, "variant")
        return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, path, "string"))

    name, desc = text("$.function.name"), text("$.function.description")
    params = F.get_json_object(definition, "$.function.parameters")
    return F.when(name.isNotNull() & desc.isNotNull() & params.isNotNull(), F.struct(
        name.alias("name"), desc.alias("description"), params.alias("parameters")))


def running_total(df: DataFrame, key: str, order: str, value: Column, name: str, block: int = 10_000) -> DataFrame:
    """Add the inclusive running sum of ``value`` per key in blocks of ``order``.

    Blocks are summed first and only the block totals are run through a
    window per key, so a key with very many rows is spread over many tasks.
    """
    d = df.withColumn("__v", value).withColumn("__b", F.floor(F.col(order) / block))
    per_key = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(key, "__b").agg(F.sum("__v").alias("__s")).select(
        key, "__b", F.coalesce(F.sum("__s").over(per_key), F.lit(0)).alias("__base")
    )
    inside = Window.partitionBy(key, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("__in", F.sum("__v").over(inside)).join(base, [key, "__b"]).withColumn(
        name, F.col("__base") + F.col("__in")).drop("__v", "__b", "__in", "__base")


def stream_lines(chunks: DataFrame) -> DataFrame:
    """``stream_id, line_no, line``: complete lines of ``stream_id, seq, bytes``.

    Chunks that are not valid UTF-8 are dropped whole.  A line is the pieces
    between two newlines; its number is the count of newlines before it, so
    pieces are grouped per line and never per stream.
    """
    ok = chunks.filter(F.is_valid_utf8(F.col("bytes").cast("string"))).select("stream_id", "seq", F.col("bytes").cast("string").alias("text"))
    parts = ok.withColumn("parts", F.split("text", "\n")).withColumn("breaks", F.size("parts") - 1)
    counted = running_total(parts.drop("text"), "stream_id", "seq", F.col("breaks"), "upto")
    pieces = counted.select("stream_id", "seq", F.posexplode("parts").alias("i", "piece"), (F.col("upto") - F.col("breaks")).alias("before"), "breaks")
    lines = pieces.select(
        "stream_id", (F.col("before") + F.col("i")).alias("line_no"), "seq", "piece", (F.col("i") < F.col("breaks")).alias("closes"))
    # the pieces of one line share its number; a line is complete if one of them ends it
    g = lines.groupBy("stream_id", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("line"),
        F.bool_or("closes").alias("complete"))
    return g.filter("complete").select("stream_id", "line_no", trim_ws(F.col("line")).alias("line"))


def reassemble_events(chunks: DataFrame) -> DataFrame:
    """``stream_id, line_no, delta`` of the event protocol, up to the stop event."""
    data = stream_lines(chunks).filter(F.col("line").startswith("data: ")).select("stream_id", "line_no", F.substr("line", F.lit(7)).alias("data"))
    e = data.select("stream_id", "line_no", F.get_json_object("data", "$.type").alias("type"),
                    F.get_json_object("data", "$.delta.text").alias("delta"), F.try_parse_json("data").isNotNull().alias("valid")).filter("valid")
    stop = e.filter("type = 'message_stop'").groupBy("stream_id").agg(F.min("line_no").alias("stop"))
    return (
        e.filter("type = 'content_block_delta' and delta is not null").join(stop, "stream_id", "left")
        .filter("stop is null or line_no < stop").select("stream_id", "line_no", "delta")
    )


def reassemble_choices(chunks: DataFrame) -> DataFrame:
    """The same for the flat protocol, which stops at a bare ``[DONE]`` line."""
    lines = stream_lines(chunks)
    stop = lines.filter("line = '[DONE]'").groupBy("stream_id").agg(F.min("line_no").alias("stop"))
    data = lines.filter(F.col("line").startswith("data: ")).select("stream_id", "line_no", F.substr("line", F.lit(7)).alias("data"))
    choices = F.from_json("data", "choices array<struct<delta:struct<content:string>>>")["choices"]
    out = data.select("stream_id", "line_no", F.posexplode(choices).alias("i", "c")).select("stream_id", "line_no", "i", F.col("c.delta.content").alias("delta"))
    return out.filter("delta is not null").join(stop, "stream_id", "left").filter("stop is null or line_no < stop").drop("stop")


def valid_tokens(tokens: DataFrame, revoked: DataFrame, now: int) -> DataFrame:
    return tokens.filter(F.col("exp") > now).join(revoked, "token", "left_anti")


def live_sessions(sessions: DataFrame, now: int) -> DataFrame:
    """Sessions without expiry or not yet expired, with their authorization header."""
    live = sessions.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    token = F.try_element_at("tokens", F.lit("access_token"))
    return live.select("id", F.concat(F.lit("Bearer "), token).alias("authorization"))
