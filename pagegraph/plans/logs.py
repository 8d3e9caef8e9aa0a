"""Queries on logs, limits and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegraph.functions import scoring as SC
from pagegraph.operators import limits as LM
from pagegraph.operators import logs as L
from pagegraph.operators import quantiles as Q
from pagegraph.plans import duck as D
from pagegraph.plans import inputs as I
from pagegraph.plans.learned import _scored, scored
from pagegraph.plans.registry import CTES, query
from pagegraph.sources import logs as SL
from pagegraph.sources.triples import scratch_path
from pagegraph.streaming import loads as ST

# --- metrics -------------------------------------------------------------------------------------


@query("metric_counters", "SELECT endpoint, method, status, count(*) AS total FROM requests GROUP BY ALL")
def metric_counters(t):
    return L.counters(I.requests(t), "endpoint", "method", "status")


@query("metric_errors", "SELECT endpoint, status, count(*) AS total FROM requests WHERE NOT starts_with(status, '2') GROUP BY ALL")
def metric_errors(t):
    return L.errors(I.requests(t), "endpoint", "status")


def _hist_sql(src: str, value: str, bounds, *labels: str) -> str:
    ls = ", ".join(labels)
    parts = [f"SELECT {ls}, '{b}' AS le, CAST(count_if({value} <= {b}) AS DOUBLE) AS n FROM {src} GROUP BY {ls}" for b in bounds]
    parts += [f"SELECT {ls}, '{n}', CAST({e} AS DOUBLE) FROM {src} GROUP BY {ls}" for n, e in (("+Inf", "count(*)"), ("sum", f"round(sum({value}), 4)"), ("count", "count(*)"))]
    return " UNION ALL ".join(parts)


@query("metric_histogram", _hist_sql("requests", "duration", L.API_BUCKETS, "endpoint", "method"))
def metric_histogram(t):
    return L.histogram(I.requests(t), "duration", L.API_BUCKETS, "endpoint", "method").withColumn("n", F.round("n", 4))


CTES["confidences"] = f"SELECT 'distmult' AS model_type, round(1 / (1 + exp(-score)), 9) AS c FROM ({_scored('distmult')}) UNION ALL SELECT 'transe', round(1 / (1 + exp(score)), 9) FROM ({_scored('transe')})"


@query("confidence_histogram", _hist_sql("confidences", "c", L.CONFIDENCE_BUCKETS, "model_type"))
def confidence_histogram(t):
    parts = [scored(t, m).select(F.lit(m).alias("model_type"), F.round(SC.confidence(m, F.col("score")), 9).alias("c")) for m in ("distmult", "transe")]
    return L.histogram(parts[0].unionByName(parts[1]), "c", L.CONFIDENCE_BUCKETS, "model_type").withColumn("n", F.round("n", 4))


@query("metric_gauge", "SELECT endpoint, arg_max(duration, (ts, id)) AS value FROM requests GROUP BY endpoint")
def metric_gauge(t):
    return L.gauge(I.requests(t), "duration", ["ts", "id"], "endpoint")


@query("latency_p95", "SELECT endpoint, round(quantile_cont(duration, 0.95), 6) AS p95 FROM requests GROUP BY endpoint")
def latency_p95(t):
    q = Q.exact_quantile(I.requests(t), ["endpoint"], "duration", 0.95, width=0.01)
    return q.select("endpoint", F.round("value", 6).alias("p95"))


@query("export_metrics", """SELECT 'pagegraph_api_requests_total{endpoint="' || endpoint || '",method="' || method || '",status="' || status || '"} ' || count(*) AS line
  FROM requests GROUP BY endpoint, method, status UNION ALL SELECT 'pagegraph_graph_size ' || count(*) FROM graph""")
def export_metrics(t):
    c = metric_counters(t)
    labels = F.create_map(*[x for n in ("endpoint", "method", "status") for x in (F.lit(n), F.col(n))])
    size = I.graph(t).agg(F.count("*").alias("total"))
    lines = c.select(L.exposition(F.lit("pagegraph_api_requests_total"), labels, F.col("total")).alias("line")).unionByName(
        size.select(L.exposition(F.lit("pagegraph_graph_size"), F.create_map().cast("map<string,string>"), F.col("total")).alias("line")))
    path = scratch_path(t.spark, "metrics")
    SL.write_metric_lines(lines, path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


# --- workflows, usage ------------------------------------------------------------------------------


@query("scan_workflow_log", "SELECT workflow_id, step_name, success, error, execution_time_ms, timestamp FROM steps")
def scan_workflow_log(t):
    s = I.steps(t)
    r = F.struct("step", "step_name", "success", F.lit("null").alias("output"), "error", "execution_time_ms", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))
    states = s.groupBy("workflow_id").agg(F.array_sort(F.collect_list(r)).alias("step_results"), F.lit("Completed").alias("status"))
    path = scratch_path(t.spark, "states")
    states.write.json(path)
    return SL.read_workflow_states(t.spark, path).select("workflow_id", "step_name", "success", "error", "execution_time_ms", "timestamp")


@query("workflow_progress", """SELECT workflow_id, count(*) AS total_steps, count_if(success) AS successful_steps, count_if(NOT success) AS failed_steps,
  count_if(success) / count(*) AS success_rate, date_diff('second', min(timestamp), max(timestamp)) AS duration_seconds FROM steps GROUP BY workflow_id""")
def workflow_progress(t):
    return L.workflow_progress(I.steps(t))


@query("token_usage", """SELECT model, sum(coalesce(prompt_tokens, 0)) AS prompt_tokens, sum(coalesce(completion_tokens, 0)) AS completion_tokens,
  sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS total_tokens FROM usage GROUP BY model""")
def token_usage(t):
    return L.token_usage(I.usage(t), "model")


# --- agents, chats, tools ----------------------------------------------------------------------------


def _last(prefix: str) -> str:
    hit = f"list_filter(ls, lambda l_: starts_with(l_, '{prefix}'))[-1]"
    return D.trim_ws(f"substr({hit}, {len(prefix) + 1})")


CTES["agent_rows"] = f"""SELECT conv_id, turn, CASE WHEN coalesce({_last('THOUGHT:')}, '') = '' THEN text ELSE {_last('THOUGHT:')} END AS thought,
  {_last('ACTION:')} AS action, {_last('ACTION INPUT:')} AS input, coalesce(json_valid({_last('ACTION INPUT:')}), false) AS input_json
  FROM (SELECT *, list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x_: {D.trim_ws('x_')}) AS ls FROM transcripts WHERE role = 'assistant')"""


@query("agent_steps", "SELECT conv_id, turn, thought, action, input, input_json FROM agent_rows")
def agent_steps(t):
    return L.agent_steps(I.transcripts(t))




@query("agent_outcome", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM agent_rows),
  e AS (SELECT conv_id, min(i) AS i FROM n WHERE upper(action) = 'FINISH' GROUP BY conv_id),
  c AS (SELECT conv_id, max(i) AS n FROM n GROUP BY conv_id)
  SELECT c.conv_id, e.i IS NOT NULL AS success, CASE WHEN e.i IS NOT NULL THEN coalesce(CASE WHEN NOT input_json THEN input
      WHEN starts_with(input, '"') THEN json_extract_string(input, '$') END, thought) END AS result,
    coalesce(e.i, c.n) AS iterations
  FROM c LEFT JOIN e USING (conv_id) LEFT JOIN n ON n.conv_id = e.conv_id AND n.i = e.i""")
def agent_outcome(t):
    return L.agent_outcome(I.transcripts(t))


@query("chat_export_system", """SELECT conv_id, turn, CASE role WHEN 'tool' THEN 'user' ELSE role END AS role, content, system FROM
  (SELECT conv_id, turn, role, text AS content FROM conversations WHERE role <> 'system') a FULL JOIN
  (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id) b USING (conv_id)""")
def chat_export_system(t):
    return L.chat_export_system(t.conversations)


@query("chat_export_flat", """SELECT conv_id, turn, CASE role WHEN 'tool' THEN 'assistant' ELSE role END AS role, 'text' AS type, text, CAST(NULL AS VARCHAR) AS url FROM conversations
  UNION ALL SELECT conv_id, turn, CASE role WHEN 'tool' THEN 'assistant' ELSE role END, 'image_url', NULL,
  CASE WHEN turn % 2 = 0 THEN 'https://img.example.com/' || conv_id ELSE 'data:image/png;base64,' || base64(encode(text)) END FROM conversations""")
def chat_export_flat(t):
    b64 = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "")
    even = F.col("turn") % 2 == 0
    none = F.lit(None).cast("string")
    fields = ("type", "text", "url", "media_type", "data")

    def block(*v):
        return F.struct(*[x.alias(n) for n, x in zip(fields, v)])

    blocks = F.array(block(F.lit("text"), F.col("text"), none, none, none), block(
        F.lit("image"), none, F.when(even, F.concat(F.lit("https://img.example.com/"), F.col("conv_id").cast("string"))),
        F.lit("image/png"), F.when(~even, b64)))
    out = L.chat_export_flat(t.conversations.withColumn("blocks", blocks))
    return out.select("conv_id", "turn", "role", F.explode("blocks").alias("b")).select("conv_id", "turn", "role", "b.*")


@query("tool_schemas", """SELECT id, json_extract_string(json, '$.function.name') AS name, json_extract_string(json, '$.function.description') AS description,
  CAST(json_extract(json, '$.function.parameters') AS VARCHAR) AS parameters FROM (SELECT id, json FROM tool_defs WHERE json_valid(json))
  WHERE json_type(json, '$.function.name') = 'VARCHAR' AND json_type(json, '$.function.description') = 'VARCHAR' AND json_extract(json, '$.function.parameters') IS NOT NULL""")
def tool_schemas(t):
    d = I.tool_defs(t).select("id", L.tool_schema(F.col("json")).alias("x")).filter("x is not null")
    return d.select("id", "x.*")


CTES["wire_lines"] = f"""SELECT stream_id, i AS line_no, {D.trim_ws('line')} AS line FROM (
  SELECT stream_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM (
    SELECT stream_id, string_split(string_agg(txt, '' ORDER BY seq), chr(10)) AS ls FROM (SELECT stream_id, seq, try(decode(bytes)) AS txt FROM stream_chunks) WHERE txt IS NOT NULL GROUP BY stream_id))
  WHERE i < n"""
CTES["wire_data"] = "SELECT stream_id, line_no, substr(line, 7) AS data FROM wire_lines WHERE starts_with(line, 'data: ') AND json_valid(substr(line, 7))"


@query("reassemble_stream", """SELECT 'events' AS protocol, stream_id, line_no - 1 AS line_no, delta FROM (
  SELECT d.stream_id, d.line_no, json_extract_string(data, '$.delta.text') AS delta FROM wire_data d
  LEFT JOIN (SELECT stream_id, min(line_no) AS stop FROM wire_data WHERE json_extract_string(data, '$.type') = 'message_stop' GROUP BY stream_id) s USING (stream_id)
  WHERE json_extract_string(data, '$.type') = 'content_block_delta' AND (stop IS NULL OR d.line_no < stop)) WHERE delta IS NOT NULL
  UNION ALL SELECT 'choices', stream_id, line_no - 1, delta FROM (
  SELECT d.stream_id, d.line_no, json_extract_string(data, '$.choices[0].delta.content') AS delta FROM wire_data d
  LEFT JOIN (SELECT stream_id, min(line_no) AS stop FROM wire_lines WHERE line = '[DONE]' GROUP BY stream_id) s USING (stream_id)
  WHERE stop IS NULL OR d.line_no < stop) WHERE delta IS NOT NULL""")
def reassemble_stream(t):
    """Delta texts of both protocols, in order of their lines."""
    chunks = I.stream_chunks(t)
    parts = {"events": L.reassemble_events(chunks), "choices": L.reassemble_choices(chunks).drop("i")}
    tagged = [d.select(F.lit(k).alias("protocol"), "stream_id", "line_no", "delta") for k, d in parts.items()]
    return tagged[0].unionByName(tagged[1])


NOW = 1700050000


@query("valid_tokens", f"SELECT token, sub, role FROM tokens WHERE exp > {NOW} AND token NOT IN (SELECT token FROM revoked)")
def valid_tokens(t):
    return L.valid_tokens(I.tokens(t), I.revoked(t), NOW).select("token", "sub", "role")


@query("live_sessions", f"""SELECT token AS id, CASE WHEN role IS NOT NULL THEN 'Bearer ' || role || '-' || token END AS "authorization"
  FROM tokens WHERE exp % 10 = 0 OR exp > {NOW}""")
def live_sessions(t):
    s = I.tokens(t).select(
        F.col("token").alias("id"), F.when(F.col("exp") % 10 != 0, F.col("exp")).alias("expires_at"),
        F.when(F.col("role").isNotNull(), F.create_map(F.lit("access_token"), F.concat("role", F.lit("-"), "token"))).otherwise(
            F.create_map().cast("map<string,string>")).alias("tokens"))
    return L.live_sessions(s, NOW)


# --- limits and alerts -----------------------------------------------------------------------------

_DAY, _PER_DAY = 86400, 2


@query("rate_limit", f"""WITH RECURSIVE anchors AS (SELECT client, min(ts) AS anchor FROM requests GROUP BY client
  UNION ALL SELECT a.client, min(r.ts) FROM anchors a JOIN requests r ON r.client = a.client AND r.ts > a.anchor + INTERVAL {_DAY} SECOND GROUP BY a.client),
  w AS (SELECT r.client, r.id, r.ts, max(a.anchor) AS anchor FROM requests r JOIN anchors a ON a.client = r.client AND a.anchor <= r.ts GROUP BY r.client, r.id, r.ts)
  SELECT client, id, ts, row_number() OVER (PARTITION BY client, anchor ORDER BY ts, id) <= {_PER_DAY} AS accepted FROM w""")
def rate_limit(t):
    return LM.rate_limit(I.requests(t), window_seconds=_DAY, limit=_PER_DAY)


@query("alert_error_rate", """WITH s AS (SELECT date_trunc('minute', ts) + i * INTERVAL 1 MINUTE AS slide, status FROM requests, range(1, 6) g(i)),
  h AS (SELECT slide FROM s GROUP BY slide HAVING count_if(starts_with(status, '5')) / count(*) > 0.05)
  SELECT a.slide AS fired_at FROM h a WHERE (SELECT count(*) FROM h b WHERE b.slide <= a.slide AND b.slide > a.slide - INTERVAL 5 MINUTE) = 5""")
def alert_error_rate(t):
    return LM.alert_error_rate(I.requests(t)).withColumnRenamed("at", "fired_at")


@query("alert_size_drop", """WITH i AS (SELECT event_type, ts, event_id, last_value(value) OVER w - first_value(value) OVER w AS increase FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW))
  SELECT event_type, ts, event_id AS key, round(increase, 6) AS increase FROM (SELECT *, max(increase) OVER (PARTITION BY event_type ORDER BY ts
    RANGE BETWEEN INTERVAL 300 SECOND PRECEDING AND CURRENT ROW) AS worst FROM i) WHERE worst < 0""")
def alert_size_drop(t):
    s = t.events.select("event_type", "ts", F.col("event_id").alias("key"), "value")
    return LM.alert_size_drop(s, "event_type").withColumn("increase", F.round("increase", 6))


@query("red_metrics", """SELECT date_trunc('minute', ts) AS minute, endpoint, count(*) AS requests, count_if(NOT starts_with(status, '2')) AS errors,
  round(sum(duration), 6) AS total_duration FROM requests GROUP BY ALL""")
def red_metrics(t):
    return LM.red_metrics(I.requests(t)).withColumn("total_duration", F.round("total_duration", 6))


# --- streams ---------------------------------------------------------------------------------------


@query("stream_pages", "SELECT page_id, url, octet_length(encode(html)) AS n_bytes FROM pages")
def stream_pages(t):
    """The page table read as a stream, file by file, into a table."""
    pages = ST.page_stream(t.spark, t.dir, "pages.parquet")
    sized = pages.select("page_id", "url", F.octet_length("html").alias("n_bytes"))
    return ST.run_to_table(sized, scratch_path(t.spark, "stream"))


_STREAMED = "SELECT DISTINCT s, p, o, o_kind, o_datatype, o_lang FROM attempts WHERE page_id >= 0 AND p NOT IN ('https://schema.org/mentions', 'https://schema.org/query')"


@query("stream_triples", _STREAMED)
def stream_triples(t):
    """Pages arrive as a stream and their new triples are appended to a store."""
    store = scratch_path(t.spark, "store")
    ST.load_pages(ST.page_stream(t.spark, t.dir, "pages.parquet"), store)
    return ST.read_store(t.spark, store).select("s", "p", "o", "o_kind", "o_datatype", "o_lang")
