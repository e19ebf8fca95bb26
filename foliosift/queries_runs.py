"""Queries over runs: stages, usage, replies, decisions and what is said of them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from foliosift.functions import fiscal, replies, text
from foliosift.operators import report, stages, usage
from foliosift.plans import columns as decided
from foliosift.queries import _results, _RESULTS
from foliosift.register import query
from foliosift.sources import registry, sinks, tables
from foliosift.streaming import runs
from foliosift.views import CALLS, COST

_LABELS = [("click", "Clicks", 2), ("view", "Views", 1), ("purchase", "Purchases", 3)]
_PLACES = "labels(stage, label, place) AS (VALUES " + ", ".join(f"('{s}', '{n}', {p})" for s, n, p in _LABELS) + ")"


def _labels(spark):
    return spark.createDataFrame(_LABELS, "stage string, label string, place int")


@query(f"""WITH {CALLS}, {_PLACES}, sums AS (SELECT stage, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM calls GROUP BY stage)
SELECT stage, coalesce(label, stage) AS label, coalesce(place, 999) AS place, prompt_tokens, completion_tokens FROM sums LEFT JOIN labels USING (stage)""")
def stage_totals_by_label(spark, d):
    return stages.by_label(tables.calls(spark, d), _labels(spark), ["prompt_tokens", "completion_tokens"]).orderBy("place", "stage")


_TIMES = """times AS (SELECT event_id, user_id, greatest(0.01::DOUBLE, (epoch_us(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), max(ts) OVER (PARTITION BY user_id))) - epoch_us(ts)) / 1e6::DOUBLE) AS duration,
(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6::DOUBLE AS since FROM events)"""


@query(f"WITH {_TIMES} SELECT coalesce(max(since + duration), 1.0) AS extent FROM times")
def timeline_extent(spark, d):
    events = tables.read(spark, d, "events").select("event_id", "user_id", "ts")
    return stages.extent(stages.since_first(stages.next_ends(events, "user_id", "ts", "event_id"), "ts"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 7 <> 0 THEN ts END NULLS LAST, event_id) AS place FROM events")
def stage_order(spark, d):
    rows = tables.read(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("start"))
    return stages.placed(rows, "user_id", "start", "event_id").drop("start")


@query("SELECT DISTINCT event_type AS stage FROM events")
def distinct_stages(spark, d):
    return tables.calls(spark, d).select("stage").distinct().orderBy("stage")


@query(f"WITH {CALLS} SELECT source, coalesce(bool_or(NOT ok AND prompt_tokens > 990), false) AS failed_large FROM calls GROUP BY source")
def any_failed_large(spark, d):
    return stages.holds_any(tables.calls(spark, d), "source", ~F.col("ok") & (F.col("prompt_tokens") > 990), "failed_large")


@query(f"WITH {CALLS} SELECT call_id, stage, source FROM calls WHERE NOT ok ORDER BY prompt_tokens DESC, call_id LIMIT 1")
def first_failed_call(spark, d):
    return stages.first_match(tables.calls(spark, d), ~F.col("ok"), F.desc("prompt_tokens"), "call_id").select("call_id", "stage", "source")


@query("""SELECT o_orderkey, CASE WHEN e < s THEN e + INTERVAL 1 DAY ELSE e END AS ends FROM (SELECT o_orderkey, TIMESTAMP '2024-03-01' + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS s, TIMESTAMP '2024-03-01' + to_minutes(CAST(o_custkey % 1440 AS INTEGER)) AS e FROM orders)""")
def rolled_over_ends(spark, d):
    at = lambda c: F.expr(f"TIMESTAMP_NTZ '2024-03-01 00:00:00' + make_dt_interval(0, 0, CAST({c} % 1440 AS INT), 0)")
    rows = tables.read(spark, d, "orders").select("o_orderkey", at("o_orderkey").alias("s"), at("o_custkey").alias("e"))
    return rows.select("o_orderkey", stages.rolled_over("s", "e").alias("ends"))


_ISO = "'2024-02-' || lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0') || 'T' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':30:15.250{0}'"


@query(f"""WITH t AS (SELECT event_id, epoch_us(CAST({_ISO.format('+02:00')} AS TIMESTAMPTZ)) AS began, CASE WHEN event_id % 3 <> 0 THEN epoch_us(CAST({_ISO.format('-05:30')} AS TIMESTAMPTZ)) END AS ended FROM events)
SELECT event_id, began, (coalesce(ended, 1709251200000000) - began) / 1e6::DOUBLE AS seconds FROM t""")
def iso_elapsed(spark, d):
    iso = lambda offset: F.expr(_ISO.format(offset).replace("VARCHAR", "STRING"))
    rows = tables.read(spark, d, "events").select("event_id", iso("+02:00").alias("a"), F.when(F.col("event_id") % 3 != 0, iso("-05:30")).alias("b"))
    rows = rows.select("event_id", stages.parsed_iso("a").alias("began"), F.try_to_timestamp("a").alias("a"), F.try_to_timestamp("b").alias("b"))
    return rows.select("event_id", "began", stages.elapsed("a", "b", F.timestamp_micros(F.lit(1709251200000000))).alias("seconds"))


_DETAILS = "details AS (SELECT user_id, 'd' || event_id % 5 AS name, max_by(event_id, event_id) AS value FROM events GROUP BY ALL)"


@query(f"WITH {_DETAILS} SELECT user_id AS stage, string_agg(name || '=' || value, ',' ORDER BY name) AS details FROM details GROUP BY user_id")
def latest_details(spark, d):
    rows = tables.read(spark, d, "events").select(F.col("user_id").alias("stage"), F.concat(F.lit("d"), (F.col("event_id") % 5).cast("string")).alias("name"), F.col("event_id").alias("value"), F.col("event_id").alias("seq"))
    pairs = F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return stages.latest_details(rows).select("stage", F.array_join(pairs, ",").alias("details"))


@query("""SELECT user_id, count(*) AS stages, string_agg(event_type || ' [' || CASE WHEN event_id % 13 <> 0 THEN 'done' ELSE 'failed' END || '] ' || printf('%.2f', event_id % 400 / 4.0::DOUBLE) || ' s', chr(10) ORDER BY place) AS summary FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 7 <> 0 THEN event_id END NULLS LAST, event_id) AS place FROM events) GROUP BY user_id""")
def run_summaries(spark, d):
    rows = tables.read(spark, d, "events").select(
        "user_id", "event_id", F.col("event_type").alias("stage"), F.when(F.col("event_id") % 13 != 0, "done").otherwise("failed").alias("status"),
        (F.col("event_id") % 400 / F.lit(4.0)).alias("duration"), F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("start"),
    )
    return report.monitor_summary(stages.placed(rows, "user_id", "start", "event_id"), "user_id")


_PER = "per AS (SELECT source, stage, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS p, CAST(sum(completion_tokens) AS BIGINT) AS c FROM calls GROUP BY ALL)"


@query(f"""WITH {CALLS}, {_PER} SELECT source, 'DEBUG_DATA:' || '{{"calls":' || CAST(sum(calls) AS BIGINT) || ',"prompt_tokens":' || CAST(sum(p) AS BIGINT) || ',"completion_tokens":' || CAST(sum(c) AS BIGINT) || ',"decisions":[' ||
string_agg('{{"stage":"' || stage || '","calls":' || calls || '}}', ',' ORDER BY stage) || ']}}' AS record FROM per GROUP BY source""")
def run_debug_records(spark, d):
    return stages.debug_records(tables.calls(spark, d))


@query(f"""WITH {CALLS}, {_PER}, chunks AS (SELECT call_id, CASE call_id % 3 WHEN 0 THEN 'DEBUG_DATA:' WHEN 1 THEN 'MONITOR:' ELSE '' END || stage AS chunk FROM calls)
SELECT call_id, CASE WHEN starts_with(chunk, 'DEBUG_DATA:') THEN 'debug' WHEN starts_with(chunk, 'MONITOR:') THEN 'monitor' ELSE 'answer' END AS kind FROM chunks""")
def chunk_kinds(spark, d):
    prefix = F.when(F.col("call_id") % 3 == 0, "DEBUG_DATA:").when(F.col("call_id") % 3 == 1, "MONITOR:").otherwise("")
    return tables.calls(spark, d).select("call_id", report.chunk_kind(F.concat(prefix, "stage")).alias("kind"))


@query(f"""WITH {CALLS}, s AS (SELECT stage, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, sum({COST}) AS cost FROM calls WHERE ok GROUP BY stage UNION ALL
SELECT 'database queries', CAST(sum(prompt_tokens) AS BIGINT), CAST(sum(completion_tokens) AS BIGINT), CAST(sum(prompt_tokens + completion_tokens) AS BIGINT), sum({COST}) FROM calls WHERE NOT ok GROUP BY source)
SELECT stage, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost), 6) AS cost FROM s GROUP BY stage""")
def merged_usage(spark, d):
    calls = tables.calls(spark, d)
    queries = usage.totals(calls.where("NOT ok"), "source").withColumn("stage", F.lit("database queries"))
    return usage.merged(usage.totals(calls.where("ok"), "stage"), queries).withColumn("cost", F.round("cost", 6))


@query(f"""WITH {CALLS}, u AS (SELECT stage, CAST(sum(prompt_tokens) AS BIGINT) AS p, CAST(sum(completion_tokens) AS BIGINT) AS c, count(*) / 4.0::DOUBLE AS s, CAST(sum(prompt_tokens) % 100 AS DOUBLE) / 8 AS cost FROM calls GROUP BY stage)
SELECT stage, p || ' input and ' || c || ' output tokens, $' || printf('%.4f', cost) || ', ' || printf('%.2f', s) || ' s' AS line FROM u""")
def usage_lines(spark, d):
    u = tables.calls(spark, d).groupBy("stage").agg(F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c"), F.count(F.lit(1)).alias("n"))
    return u.select("stage", report.usage_text(F.col("p"), F.col("c"), F.col("p") % 100 / F.lit(8.0), F.col("n") / F.lit(4.0)).alias("line"))


_LIST = "CASE len({0}) WHEN 1 THEN {0}[1] WHEN 2 THEN {0}[1] || ' and ' || {0}[2] ELSE array_to_string({0}[1:len({0}) - 1], ', ') || ', and ' || {0}[len({0})] END"


@query(f"""WITH p AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey)
SELECT n_regionkey, CASE WHEN n_regionkey % 2 = 0 THEN 'Listing what is relevant in ' ELSE 'Researching your question in ' END || {_LIST.format('names')} || '.' AS line FROM p""")
def plan_headers(spark, d):
    p = tables.read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return p.select("n_regionkey", report.plan_text(F.col("names"), F.when(F.col("n_regionkey") % 2 == 0, "metadata").otherwise("research")).alias("line"))


@query(f"""WITH {_RESULTS}, plan AS (SELECT 'src_' || i AS source FROM range(14) AS t(i)), o AS (SELECT source, count(*) FILTER (WHERE ok) AS n, CASE WHEN max(pos) % 4 = 0 THEN 'timeout' END AS error FROM results GROUP BY source)
SELECT source, CASE WHEN error IS NOT NULL THEN source || ': failed (' || error || ')' WHEN coalesce(n, 0) = 0 THEN source || ': nothing found' WHEN source > 'src_3' THEN source || ': ' || n || ' item(s)' ELSE source || ': report of ' || n || ' document(s)' END AS line
FROM plan LEFT JOIN o USING (source)""")
def source_status_lines(spark, d):
    per = _results(spark, d).groupBy("source").agg(F.count_if("ok").alias("n"), F.max("pos").alias("last"))
    plan = spark.range(14).select(F.concat(F.lit("src_"), F.col("id").cast("string")).alias("source"))
    rows = plan.join(per, "source", "left").withColumn("error", F.when(F.col("last") % 4 == 0, "timeout"))
    scope = F.when(F.col("source") > "src_3", "metadata").otherwise("research")
    return rows.select("source", report.source_line(F.col("source"), scope, F.coalesce("n", F.lit(0)), F.col("error")).alias("line"))


_FIRST = f"""plan AS (SELECT 'src_' || i AS source FROM range(14) AS t(i)), u AS (SELECT source, document_name FROM results WHERE error IS NOT NULL UNION ALL SELECT DISTINCT source, document_name FROM results WHERE error IS NULL),
per AS (SELECT source, count(*) AS n, list(DISTINCT document_name ORDER BY document_name) AS names FROM u GROUP BY source),
lines AS (SELECT source, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no items' ELSE n || ' item(s): ' || array_to_string(names[1:10], ', ') || CASE WHEN len(names) > 10 THEN ', ...' ELSE '' END END AS line FROM plan LEFT JOIN per USING (source))"""


@query(f"WITH {_RESULTS}, {_FIRST} SELECT * FROM lines")
def metadata_listing(spark, d):
    plan = spark.range(14).select(F.concat(F.lit("src_"), F.col("id").cast("string")).alias("source"))
    return report.listing(plan, _results(spark, d))


@query(f"WITH {_RESULTS}, {_FIRST} SELECT CAST(sum(n) AS BIGINT) AS items, count(*) FILTER (WHERE n > 0) AS with_items, count(*) AS sources FROM lines")
def metadata_totals(spark, d):
    return report.totals_line(metadata_listing(spark, d))


@query(f"""WITH {_RESULTS} SELECT source, pos // 1000 AS piece, trim(string_agg('### ' || document_name || chr(10) || CASE WHEN pos % 5 = 0 THEN 'No answer' ELSE 'answer ' || pos END, chr(10) || chr(10) ORDER BY pos), chr(10) || chr(9) || ' ') AS report FROM results GROUP BY ALL""")
def combined_reports(spark, d):
    return report.report_pieces(_results(spark, d).withColumn("answer", F.when(F.col("pos") % 5 != 0, F.concat(F.lit("answer "), F.col("pos").cast("string")))))


@query(f"""WITH {CALLS}, r AS (SELECT source, CASE WHEN count(*) % 3 <> 0 THEN count(*) || ' calls' END AS report FROM calls GROUP BY source)
SELECT '# Research' || chr(10) || chr(10) || '1. first' || chr(10) || '2. then' || chr(10) || chr(10) || string_agg('## ' || CASE source WHEN 'src_1' THEN 'Source one' ELSE source END || chr(10) || coalesce(report, 'No report'), chr(10) || chr(10) ORDER BY source) AS context FROM r""")
def summary_context(spark, d):
    r = tables.calls(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    r = r.select("source", F.when(F.col("n") % 3 != 0, F.concat(F.col("n").cast("string"), F.lit(" calls"))).alias("report"))
    names = spark.createDataFrame([("src_1", "Source one")], "key string, display_name string")
    return report.summary_context(registry.display_names(r, names), ["first", "then"])


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Continuing the earlier question: ' || text ELSE text END AS statement FROM conversations WHERE role = 'user'")
def continued_statements(spark, d):
    rows = tables.messages(spark, d).where("role = 'user'").withColumn("on", F.col("turn") % 2 == 0)
    return rows.select("conv_id", "turn", text.continued("content", "on").alias("statement"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' is in fiscal year ' || fy || ', quarter ' || q || ' (' || strftime(make_date(fy, 3 * q - 2, 1) - INTERVAL 2 MONTH, '%Y-%m-%d') || ' to ' ||
strftime(make_date(fy, 3 * q - 2, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') || ').' AS statement FROM (
SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate + INTERVAL 2 MONTH) AS INTEGER) AS fy, CAST(quarter(CAST(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS INTEGER) AS q FROM orders)""")
def fiscal_statements(spark, d):
    return tables.read(spark, d, "orders").select("o_orderkey", fiscal.statement(F.col("o_orderdate")).alias("statement"))


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE)) <= 30 AS warn FROM orders")
def expiry_warnings(spark, d):
    left, warn = fiscal.days_left(F.col("o_orderdate").cast("date"), F.lit("1995-06-17").cast("date"))
    return tables.read(spark, d, "orders").select("o_orderkey", left.alias("days"), warn.alias("warn"))


_QUOTED = """CASE {x} % 5 WHEN 0 THEN '["' || {x} || '","a"]' WHEN 1 THEN '[' || {x} || ']' WHEN 2 THEN 'see "' || {x} || '" and "b" or " "' WHEN 3 THEN 'or ' || chr(39) || 'c ' || {x} || chr(39) || ' only' ELSE 'none' END"""


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id || ',a' WHEN 2 THEN event_id || ',b' ELSE '' END AS ids FROM events")
def parse_id_list_any(spark, d):
    rows = tables.read(spark, d, "events").select("event_id", F.expr(_QUOTED.format(x="event_id")).alias("reply"))
    return rows.select("event_id", F.array_join(replies.id_list_column(F.col("reply"), replies.ANY), ",").alias("ids"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id || ',a' WHEN 2 THEN event_id || ',b' WHEN 3 THEN 'c ' || event_id ELSE '' END AS ids FROM events")
def parse_id_list_quotes(spark, d):
    rows = tables.read(spark, d, "events").select("event_id", F.expr(_QUOTED.format(x="event_id")).alias("reply"))
    return rows.select("event_id", F.array_join(replies.id_list_column(F.col("reply"), replies.QUOTES), ",").alias("ids"))


_ARGUMENTS = """CASE {x} % 6 WHEN 0 THEN '{{"action":"ask","output":"o' || {x} || '"}}' WHEN 1 THEN '{{"action":"proceed","output":"o","is_continuation":true}}' WHEN 2 THEN '{{"action":1,"output":"o"}}'
WHEN 3 THEN '{{"action":"ask","output":"o","is_continuation":"yes"}}' WHEN 4 THEN '["action"]' ELSE 'no json' END"""


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ask' WHEN 1 THEN 'proceed' END AS action, CASE event_id % 6 WHEN 0 THEN 'o' || event_id WHEN 1 THEN 'o' END AS output, CASE WHEN event_id % 6 = 1 THEN true END AS is_continuation,
CASE event_id % 6 WHEN 2 THEN 'action is missing or not STRING' WHEN 3 THEN 'is_continuation is not BOOLEAN' WHEN 4 THEN 'arguments must be an object' WHEN 5 THEN 'arguments must be an object' END AS wrong FROM events""")
def tool_arguments(spark, d):
    rows = tables.read(spark, d, "events").select("event_id", F.expr(_ARGUMENTS.format(x="event_id")).alias("reply"))
    found, wrong = replies.checked_arguments(F.col("reply"), {"action": "STRING", "output": "STRING"}, {"is_continuation": "BOOLEAN"})
    return rows.select("event_id", found.alias("a"), wrong.alias("wrong")).select("event_id", "a.*", "wrong")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'action must be ask or proceed' WHEN event_id % 7 = 0 THEN 'output is required' WHEN event_id % 4 <> 0 AND event_id % 5 > 1 THEN 'scope must be metadata or research' END AS wrong,
CASE WHEN event_id % 4 <> 3 AND event_id % 7 <> 0 AND event_id % 4 <> 0 AND event_id % 5 <= 1 THEN CASE event_id % 5 WHEN 0 THEN 'metadata' ELSE 'research' END END AS scope FROM events""")
def checked_clarifications(spark, d):
    e = F.col("event_id")
    rows = tables.read(spark, d, "events").select(
        "event_id", F.when(e % 4 == 0, "ask").when(e % 4 == 3, "maybe").otherwise("proceed").alias("action"), F.when(e % 7 != 0, "text").otherwise("").alias("output"),
        F.when(e % 5 == 0, "metadata").when(e % 5 == 1, "research").when(e % 5 == 2, "all").alias("scope"),
    )
    wrong, scope = decided.checked(F.col("action"), F.col("output"), F.col("scope"))
    return rows.select("event_id", wrong.alias("wrong"), scope.alias("scope"))


_ASKED = "asked AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS words FROM conversations WHERE role = 'user')"


@query(f"WITH {_ASKED} SELECT conv_id, turn, CASE WHEN len(words) <= 4 AND len(list_intersect(words, ['hello', 'hi', 'thanks', 'thank', 'bye'])) > 0 THEN 'direct_answer' ELSE 'research' END AS route FROM asked")
def routed_messages(spark, d):
    return tables.messages(spark, d).where("role = 'user'").select("conv_id", "turn", decided.route(F.col("content")).alias("route"))


@query(f"""WITH {_ASKED} SELECT conv_id, turn, CASE WHEN len(words) < 2 AND len(list_intersect(words, ['proceed', 'anyway', 'continue'])) = 0 THEN 'ask' ELSE 'proceed' END AS action,
CASE WHEN len(words) < 2 AND len(list_intersect(words, ['proceed', 'anyway', 'continue'])) = 0 THEN NULL WHEN len(list_intersect(words, ['list', 'find', 'show', 'which', 'titles'])) > 0 THEN 'metadata' ELSE 'research' END AS scope FROM asked""")
def clarified_messages(spark, d):
    rows = tables.messages(spark, d).where("role = 'user'")
    action, scope = decided.clarify(F.col("content"))
    return rows.select("conv_id", "turn", action.alias("action"), scope.alias("scope"))


@query(f"WITH {CALLS} SELECT call_id, '{{\"stage\":\"' || stage || '\",\"source\":\"' || source || '\",\"prompt_tokens\":' || prompt_tokens || ',\"ok\":' || CASE WHEN ok THEN 'true' ELSE 'false' END || '}}' AS json FROM calls")
def stage_json(spark, d):
    rows = tables.calls(spark, d)
    return sinks.as_json(rows.select("call_id", "stage", "source", "prompt_tokens", "ok"), keep=["call_id"])


@query("""WITH k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
e AS (SELECT CAST(user_id AS VARCHAR) AS run, 'stage_' || (k % 5) AS stage, event_id, event_type AS kind, epoch_us(ts) AS us, k FROM k),
cut AS (SELECT *, coalesce(us - lag(us) OVER w >= 86400000000, true) AS new FROM e WINDOW w AS (PARTITION BY run, stage ORDER BY us, event_id)),
part AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY run, stage ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS part FROM cut),
details AS (SELECT run, stage, part, string_agg(name || '=' || value, ';' ORDER BY name) AS details FROM (SELECT run, stage, part, 'k' || (k % 3) AS name, CAST(arg_max(k, (us, event_id)) AS VARCHAR) AS value FROM part WHERE kind = 'view' GROUP BY ALL) GROUP BY ALL)
SELECT run, stage, min(us) AS first_us, max(us) AS last_us, min(us) FILTER (WHERE kind = 'signup') AS start_us, coalesce(max(us) FILTER (WHERE kind IN ('purchase', 'error')), max(us)) AS end_us,
coalesce(arg_max(CASE kind WHEN 'purchase' THEN 'done' ELSE 'failed' END, (us, event_id)) FILTER (WHERE kind IN ('purchase', 'error')), 'abandoned') AS status,
CAST(coalesce(sum(k) FILTER (WHERE kind = 'click'), 0) AS BIGINT) AS tokens, count(*) AS events, coalesce(any_value(details), '') AS details
FROM part LEFT JOIN details USING (run, stage, part) GROUP BY run, stage, part""")
def run_stages(spark, d):
    rows = runs.stages(tables.stage_events(spark, d), dt.timedelta(days=1))
    details = F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    times = [F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c}_ts)").alias(f"{c}_us") for c in ("first", "last", "start", "end")]
    return rows.select("run", "stage", *times, "status", "tokens", "events", details.alias("details"))
