"""The engine's queries over the shared tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliosift.functions import fiscal, replies, text
from foliosift.operators import assembly, catalog as cat, conversation, profile, report, selection, stages, usage
from foliosift.register import ORACLES, QUERIES, query
from foliosift.sources import registry, tables
from foliosift.views import CALLS, CATALOG, COST, MEASURES, QUESTION, SECTIONS, TERMS, TITLE


@query(f"WITH {CATALOG} SELECT CAST(id AS VARCHAR) AS id, document_name, document_description FROM catalog WHERE document_source = 'src0'")
def catalog_by_source(spark, d):
    return cat.of_source(tables.catalog(spark, d), "src0")


@query(f"WITH {CATALOG}, {SECTIONS} SELECT (SELECT count(*) FROM catalog) AS documents, (SELECT count(*) FROM sections) AS sections")
def catalog_counts(spark, d):
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(tables.catalog(spark, d), "documents").join(n(tables.sections(spark, d), "sections"))


@query("SELECT source AS document_source, count(*) AS n FROM documents GROUP BY source")
def source_counts(spark, d):
    return cat.counts(tables.catalog(spark, d), "document_source")


@query("SELECT DISTINCT source AS document_source FROM documents")
def distinct_sources(spark, d):
    return tables.catalog(spark, d).select("document_source").distinct().orderBy(F.col("document_source").asc_nulls_last())


@query("""WITH asked AS (SELECT CASE WHEN quality = 1 THEN CAST(doc_id AS VARCHAR) ELSE '0' || doc_id END AS t FROM labels)
SELECT doc_id AS id, 'doc_' || doc_id AS document_name FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT t FROM asked)""")
def catalog_id_in_text(spark, d):
    asked = tables.read(spark, d, "labels").select(F.when(F.col("quality") == 1, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("0"), F.col("doc_id").cast("string"))).alias("id_text"))
    return cat.with_ids(tables.catalog(spark, d), asked).select("id", "document_name")


@query("SELECT doc_id AS id FROM documents WHERE CAST(doc_id AS VARCHAR) LIKE '%77%'")
def catalog_id_like(spark, d):
    return cat.id_like(tables.catalog(spark, d), "77").select("id")


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '^[0-9]+$') OR starts_with(text, 'Th')) AS n_true,
count(*) FILTER (WHERE regexp_matches(text, '^[0-9]+$') OR starts_with(text, 'Th')) * 100.0::DOUBLE / count(*) AS pct FROM documents""")
def id_form_share(spark, d):
    c = F.col("document_description")
    return cat.share(tables.catalog(spark, d), F.coalesce(c.rlike("^[0-9]+$") | c.startswith("Th"), F.lit(False)))


@query("SELECT doc_id AS id, 'doc_' || doc_id AS document_name FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 10")
def random_sample(spark, d):
    return cat.sample(tables.catalog(spark, d), 10).select("id", "document_name")


_SCORED = f"""{CATALOG}, scored AS (SELECT *, len(list_intersect(list_distinct(regexp_split_to_array(lower(document_description), '[^a-z0-9]+')), [{TERMS}])) AS score FROM catalog),
chosen AS (SELECT document_source, id, document_name, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY document_source ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 5)"""


@query(f"WITH {_SCORED} SELECT * FROM chosen")
def select_top5_lexical(spark, d):
    return selection.select_documents(tables.catalog(spark, d), QUESTION)


@query(f"WITH {_SCORED} SELECT id, document_name, document_description FROM catalog WHERE id IN (SELECT id FROM chosen)")
def selected_metadata(spark, d):
    c = tables.catalog(spark, d)
    return selection.selected(c, selection.select_documents(c, QUESTION)).select("id", "document_name", "document_description")


@query(f"WITH {CATALOG}, {SECTIONS} SELECT id, document_source, document_name, section_id, {TITLE} AS section_name, section_content FROM catalog JOIN sections USING (document_source, document_type, document_name)")
def assemble_documents(spark, d):
    docs = assembly.documents(tables.catalog(spark, d), tables.sections(spark, d))
    return docs.select("id", "document_source", "document_name", F.inline("sections"))


@query(f"WITH {CATALOG}, {SECTIONS} SELECT id, document_name, section_id, {TITLE} AS section_name, section_summary FROM catalog JOIN sections USING (document_source, document_type, document_name)")
def section_summaries(spark, d):
    docs = assembly.documents(tables.catalog(spark, d), tables.sections(spark, d), "section_summary")
    return docs.select("id", "document_name", F.inline("sections"))


@query(f"""WITH {SECTIONS} SELECT document_name, section_id, section_content FROM sections JOIN labels ON document_name = 'doc_' || doc_id WHERE quality = 1 AND section_id IN (0, 2)""")
def selected_sections(spark, d):
    labels = tables.read(spark, d, "labels")
    keyed = tables.catalog(spark, d).select(*assembly.KEY, F.col("id").alias("doc_id")).join(labels, "doc_id")
    choice = keyed.select(*assembly.KEY, F.when(F.col("quality") == 1, F.array(F.lit("0"), F.lit("2"))).otherwise(F.array(F.lit("0"), F.lit("first"))).alias("section_ids"))
    return assembly.chosen_sections(tables.sections(spark, d), choice).select("document_name", "section_id", "section_content")


@query(f"""WITH {CATALOG}, {SECTIONS} SELECT s.document_source, s.document_name, s.section_id, s.section_name, CAST(length(s.section_content) AS BIGINT) AS content_length
FROM sections s JOIN catalog c ON s.document_name = c.document_name AND s.document_source = c.document_source""")
def join_two_key(spark, d):
    rows = assembly.named(tables.catalog(spark, d), tables.sections(spark, d))
    return rows.select("document_source", "document_name", "section_id", "section_name", F.length("section_content").cast("long").alias("content_length"))


@query(f"WITH {CATALOG}, {SECTIONS} SELECT document_name, count(section_id) AS n FROM catalog JOIN sections USING (document_source, document_type, document_name) GROUP BY document_name")
def join_three_key_counts(spark, d):
    rows = assembly.joined(tables.catalog(spark, d), tables.sections(spark, d).select(*assembly.KEY, "section_id"))
    return rows.groupBy("document_name").agg(F.count("section_id").alias("n"))


@query("""SELECT c_custkey, coalesce(CASE WHEN n_nationkey % 3 <> 0 THEN n_name END, 'nation_' || c_nationkey) AS display_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def display_name_lookup(spark, d):
    names = tables.read(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("display_name"))
    rows = tables.read(spark, d, "customer").select("c_custkey", F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("source"))
    return registry.display_names(rows, names).select("c_custkey", "display_name")


@query(f"""WITH {CATALOG} SELECT document_source, id // 1000 AS piece, trim(string_agg('id: ' || id || chr(10) || 'name: ' || document_name || chr(10) || 'description: ' || coalesce(document_description, 'none') || chr(10), chr(10) ORDER BY id), chr(10) || chr(9) || ' ') AS text FROM catalog GROUP BY ALL""")
def catalog_text_report(spark, d):
    return assembly.pieces_of(tables.catalog(spark, d), ["document_source"], assembly.catalog_line(), "id")


@query(f"""WITH {CATALOG}, {SECTIONS} SELECT id, document_name, '# ' || document_name || chr(10) || chr(10) || trim(string_agg('## ' || {TITLE} || chr(10) || section_content || chr(10), chr(10) ORDER BY section_id), chr(10) || chr(9) || ' ') || chr(10) || chr(10) || '---' AS text
FROM catalog JOIN sections USING (document_source, document_type, document_name) GROUP BY id, document_name""")
def document_text_report(spark, d):
    return assembly.document_texts(tables.catalog(spark, d), tables.sections(spark, d))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS short FROM documents")
def preview_57(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", text.ellipsis("text").alias("short"))


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE coalesce(text, '') END AS short FROM documents")
def preview_50(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", text.preview("text").alias("short"))


@query("SELECT doc_id, left(text, 100) AS first_100, length(text) AS chars, upper(lang) AS lang FROM documents")
def left_100(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", F.left("text", F.lit(100)).alias("first_100"), F.length("text").cast("long").alias("chars"), F.upper("lang").alias("lang"))


_REPLY = "CASE {x} % 4 WHEN 0 THEN '[\"' || {x} || '\",\"a\"]' WHEN 1 THEN '[' || {x} || ']' WHEN 2 THEN 'see \"' || {x} || '\" and \"b\"' ELSE 'none' END"


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id || ',a' WHEN 2 THEN CAST(event_id AS VARCHAR) ELSE '' END AS ids FROM events")
def parse_id_list(spark, d):
    rows = tables.read(spark, d, "events").select("event_id", F.expr(_REPLY.format(x="event_id")).alias("reply"))
    return rows.select("event_id", F.array_join(replies.id_list_column(F.col("reply")), ",").alias("ids"))


#: Replies of every form: two lists, none, numbers, a string for a list, two objects, broken JSON, no brace, an empty object.
_MAPS = """CASE {x} % 8 WHEN 0 THEN 'Sure:\n{{"doc_' || {x} || '": ["0", "' || ({x} % 5) || '"], "b": []}}\nDone' WHEN 1 THEN 'none' WHEN 2 THEN '{{"a": [1]}}' WHEN 3 THEN '{{"a": "' || {x} || '"}}' WHEN 4 THEN '{{"a": ["1"]}} and {{"b": ["2"]}}' WHEN 5 THEN '{{"a": ["1"' WHEN 6 THEN '{{ "d\u00e9 ' || {x} || '" : [ "x, y" , "z" ] }}' ELSE '{{}}' END"""


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'b=;doc_' || event_id || '=0|' || (event_id % 5) WHEN 6 THEN 'd\u00e9 ' || event_id || '=x, y|z' ELSE '' END AS choice FROM events")
def parse_section_map(spark, d):
    rows = tables.read(spark, d, "events").select("event_id", F.expr(_MAPS.format(x="event_id").replace("\n", "\\n")).alias("reply"))
    entries = F.array_sort(F.map_entries(replies.section_choice_column(F.col("reply"))))
    return rows.select("event_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ";").alias("choice"))


_TOKENS = "CAST(length(coalesce(section_content, '')) // 4 AS BIGINT)"


def _section_tokens(spark, d):
    return tables.sections(spark, d).select("document_source", "document_name", "section_id", text.tokens("section_content").alias("tokens"))


def _document_tokens(spark, d):
    return tables.catalog(spark, d).select("id", F.floor(F.col("n_chars") / 4).cast("long").alias("tokens"), "n_chars")


@query(f"WITH {SECTIONS} SELECT document_source, document_name, count(*) AS sections, CAST(sum({_TOKENS}) AS BIGINT) AS tokens FROM sections GROUP BY ALL")
def doc_token_totals(spark, d):
    return profile.per_document(_section_tokens(spark, d))


@query("SELECT count(*) AS n, CAST(sum(n_chars // 4) AS BIGINT) AS total, avg(n_chars // 4) AS mean, CAST(max(n_chars // 4) AS BIGINT) AS most, CAST(min(n_chars // 4) AS BIGINT) AS least, CAST(median(n_chars // 4) AS DOUBLE) AS median FROM documents")
def token_stats_median(spark, d):
    return profile.stats(_document_tokens(spark, d))


@query("""WITH b(bucket, low, high) AS (VALUES (0, 0, 50), (1, 51, 100), (2, 101, 200), (3, 201, 300), (4, 301, 400), (5, 401, 500), (6, 501, 1000), (7, 1001, NULL))
SELECT b.bucket, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high, count(doc_id) AS n, count(doc_id) * 100.0::DOUBLE / (SELECT count(*) FROM documents) AS pct
FROM b LEFT JOIN documents ON n_chars // 4 >= low AND n_chars // 4 <= coalesce(high, 1000000000) GROUP BY ALL""")
def token_histogram(spark, d):
    return profile.histogram(_document_tokens(spark, d), profile.SMALL)


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE n_chars // 4 > {x}) AS over_{x}" for x in profile.LARGE[:5]) + " FROM documents")
def tokens_over_limits(spark, d):
    return profile.over_limits(_document_tokens(spark, d), profile.LARGE[:5])


@query("SELECT doc_id AS id, CAST(n_chars // 4 AS BIGINT) AS tokens FROM documents ORDER BY tokens DESC, id LIMIT 10")
def top10_by_tokens(spark, d):
    return profile.largest(_document_tokens(spark, d).select("id", "tokens"), "tokens", "id")


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY n_chars // 4 DESC, doc_id) AS k, sum(n_chars // 4) OVER (ORDER BY n_chars // 4 DESC, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents)
SELECT k, CAST(total AS BIGINT) AS total FROM r WHERE k IN (1, 2, 3, 5, 10)""")
def topk_cumulative_tokens(spark, d):
    return profile.top_sums(_document_tokens(spark, d), [1, 2, 3, 5, 10])


@query("""WITH r AS (SELECT n_chars // 4 AS t, row_number() OVER (ORDER BY n_chars // 4 DESC, doc_id) AS k, count(*) OVER () AS n FROM documents)
SELECT CAST(sum(t) FILTER (WHERE k > greatest(0, n // 2 - 5) AND k <= greatest(0, n // 2 - 5) + 10) AS BIGINT) AS middle, CAST(sum(t) FILTER (WHERE k > n - 10) AS BIGINT) AS bottom FROM r""")
def middle10_bottom10(spark, d):
    return profile.middle_and_bottom(_document_tokens(spark, d))


@query("SELECT source, count(n_chars) AS n, median(n_chars)::DOUBLE AS median FROM documents WHERE n_chars IS NOT NULL GROUP BY source")
def median_chars_by_source(spark, d):
    return profile.medians(tables.read(spark, d, "documents").select("source", "n_chars"), "source", "n_chars")


@query("""WITH r AS (SELECT sum(len(regexp_split_to_array(text, ' ')))::DOUBLE / sum(length(text)) AS ratio FROM conversations), c AS (SELECT sum(n_chars) AS chars FROM documents)
SELECT ratio, CAST(chars AS BIGINT) AS chars, CAST(floor(chars * ratio) AS BIGINT) AS tokens FROM r, c""")
def ratio_rescale(spark, d):
    sampled = tables.messages(spark, d).select(F.size(F.split("content", " ")).cast("long").alias("tokens"), F.length("content").cast("long").alias("chars"))
    return profile.rescaled(sampled, _document_tokens(spark, d).select(F.col("n_chars").alias("chars")), "tokens", "chars")


@query("""WITH w AS (SELECT source, doc_id, CAST(len(regexp_split_to_array(text, ' ')) AS DOUBLE) AS t, CAST(n_chars AS DOUBLE) AS c FROM documents WHERE text IS NOT NULL),
s AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) <= 100),
b AS (SELECT source, m, t, c, tt, cc, tc, n, n / m AS up FROM (SELECT source, count(*)::DOUBLE AS m, sum(t) AS t, sum(c) AS c, sum(t * t) AS tt, sum(c * c) AS cc, sum(t * c) AS tc FROM s GROUP BY source) JOIN (SELECT source, count(*)::DOUBLE AS n FROM w GROUP BY source) USING (source)),
r AS (SELECT sum(up * t) / sum(up * c) AS r, sum(up * c) AS scaled FROM b),
e AS (SELECT any_value(r) AS ratio, sqrt(sum(n * (n - m) * greatest(0, tt - 2 * r * tc + r * r * cc - m * ((t - r * c) / m) * ((t - r * c) / m)) / (m - 1) / m)) / any_value(scaled) AS error FROM b, r)
SELECT round(ratio, 9) AS ratio, round(error, 9) AS error, round(ratio - 1.96::DOUBLE * error, 9) AS low, round(ratio + 1.96::DOUBLE * error, 9) AS high, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents WHERE text IS NOT NULL) AS chars FROM e""")
def ratio_of_stratified_sample(spark, d):
    rows = tables.read(spark, d, "documents").where("text IS NOT NULL").select("source", "doc_id", F.size(F.split("text", " ")).alias("tokens"), "n_chars")
    one = profile.ratio_of_sample(rows, "source", "doc_id", "tokens", "n_chars", 100)
    return one.select(*[F.round(c, 9).alias(c) for c in ("ratio", "error", "low", "high")], "chars")


@query("SELECT conv_id, turn, role, text AS content FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10")
def last_10_messages(spark, d):
    return conversation.recent(tables.messages(spark, d))


@query("SELECT conv_id, turn, role, text AS content FROM conversations WHERE role IN ('user', 'assistant', 'system') AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def last_3_messages(spark, d):
    return conversation.recent(tables.messages(spark, d), 3, with_system=True)


@query("SELECT o_orderkey, CAST(year(o_orderdate + INTERVAL 2 MONTH) AS INTEGER) AS fiscal_year, CAST(quarter(CAST(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS INTEGER) AS fiscal_quarter FROM orders")
def fiscal_period(spark, d):
    o = F.col("o_orderdate")
    return tables.read(spark, d, "orders").select("o_orderkey", fiscal.year(o).alias("fiscal_year"), fiscal.quarter(o).alias("fiscal_quarter"))


@query("""WITH p AS (SELECT DISTINCT CAST(year(o_orderdate + INTERVAL 2 MONTH) AS INTEGER) AS fy, CAST(quarter(CAST(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS INTEGER) AS q FROM orders)
SELECT fy, q, CAST(make_date(fy, 3 * q - 2, 1) - INTERVAL 2 MONTH AS DATE) AS first_day, CAST(make_date(fy, 3 * q - 2, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS last_day,
CASE q WHEN 1 THEN 'November to January' WHEN 2 THEN 'February to April' WHEN 3 THEN 'May to July' ELSE 'August to October' END AS label FROM p""")
def fiscal_quarter_dates(spark, d):
    o = F.col("o_orderdate")
    p = tables.read(spark, d, "orders").select(fiscal.year(o).alias("fy"), fiscal.quarter(o).alias("q")).distinct()
    return p.select("fy", "q", fiscal.quarter_start(F.col("fy"), F.col("q")).alias("first_day"), fiscal.quarter_end(F.col("fy"), F.col("q")).alias("last_day"), fiscal.quarter_label(F.col("q")).alias("label"))


@query(f"WITH {CALLS} SELECT call_id, {COST} AS cost FROM calls")
def call_cost(spark, d):
    return tables.calls(spark, d).select("call_id", usage.cost().alias("cost"))


_USAGE = f"count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, round(sum({COST}), 6) AS cost"


@query(f"WITH {CALLS} SELECT stage, {_USAGE} FROM calls GROUP BY stage")
def usage_by_stage(spark, d):
    return usage.totals(tables.calls(spark, d), "stage").withColumn("cost", F.round("cost", 6))


@query(f"WITH {CALLS} SELECT {_USAGE} FROM calls")
def usage_totals(spark, d):
    return usage.totals(tables.calls(spark, d)).withColumn("cost", F.round("cost", 6))


@query(f"""WITH {CALLS}, named AS (SELECT CASE WHEN call_id % 3 = 0 THEN stage ELSE 'db_query_internal_' || stage || '_' || call_id % 4 END AS stage, prompt_tokens, completion_tokens FROM calls)
SELECT CASE WHEN starts_with(stage, 'db_query_') THEN 'database queries' ELSE stage END AS category, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens
FROM named WHERE stage NOT IN ('error', 'signup') GROUP BY ALL""")
def stage_category_rollup(spark, d):
    return stages.by_category(_named_stages(spark, d), ["prompt_tokens", "completion_tokens"], ["error", "signup"])


@query(f"""WITH {CALLS} SELECT 'internal_' || stage AS source, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, round(sum({COST}), 6) AS cost, sum(call_id % 17 / 2.0::DOUBLE) AS duration FROM calls WHERE call_id % 3 <> 0 GROUP BY stage""")
def stage_by_database(spark, d):
    return stages.by_database(_named_stages(spark, d), MEASURES).withColumn("cost", F.round("cost", 6))


@query(f"""WITH {CALLS} SELECT 'internal_' || stage AS source, min('label ' || call_id % 7) AS display_name, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, round(sum({COST}), 6) AS cost FROM calls WHERE call_id % 3 <> 0 GROUP BY stage""")
def named_stage_by_database(spark, d):
    rows = _named_stages(spark, d).withColumn("display_name", F.concat(F.lit("label "), (F.col("call_id") % 7).cast("string")))
    return stages.by_database(rows, MEASURES[:4], "display_name").withColumn("cost", F.round("cost", 6))


def _named_stages(spark, d):
    name = F.when(F.col("call_id") % 3 == 0, F.col("stage")).otherwise(F.concat(F.lit("db_query_internal_"), "stage", F.lit("_"), (F.col("call_id") % 4).cast("string")))
    rows = tables.calls(spark, d).withColumn("stage", name)
    return rows.withColumns({"total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"), "cost": usage.cost(), "duration": F.col("call_id") % 17 / F.lit(2.0)})


@query("""SELECT event_id, user_id, end_ts, greatest(0.01::DOUBLE, (epoch_us(end_ts) - epoch_us(ts)) / 1e6::DOUBLE) AS duration, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6::DOUBLE AS since FROM (
SELECT *, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), max(ts) OVER (PARTITION BY user_id)) AS end_ts FROM events)""")
def stage_timeline(spark, d):
    events = tables.read(spark, d, "events").select("event_id", "user_id", "ts")
    return stages.since_first(stages.next_ends(events, "user_id", "ts", "event_id"), "ts").select("event_id", "user_id", "end_ts", "duration", "since")


def _results(spark, d):
    """Calls as results: equal names repeat in a source, failures carry an error."""
    c = tables.calls(spark, d)
    return c.select("source", F.col("call_id").alias("pos"), F.concat(F.lit("doc_"), (F.col("call_id") % 199).cast("string")).alias("document_name"), F.when(~F.col("ok"), "failed").alias("error"), "ok")


_RESULTS = f"{CALLS}, results AS (SELECT source, call_id AS pos, 'doc_' || call_id % 199 AS document_name, CASE WHEN NOT ok THEN 'failed' END AS error, ok FROM calls)"


@query(f"""WITH {_RESULTS}, o AS (SELECT source, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS bad FROM results GROUP BY source)
SELECT source, good, bad, CASE WHEN bad = 0 THEN 'Found information in ' || good || ' document(s).' WHEN good = 0 THEN 'All ' || bad || ' document(s) failed.' ELSE good || ' document(s) answered, ' || bad || ' failed.' END AS status FROM o""")
def synthesis_status(spark, d):
    return report.outcomes(_results(spark, d))


@query(f"""WITH {_RESULTS} SELECT source, pos, document_name, error, ok FROM results WHERE error IS NOT NULL UNION ALL
(SELECT source, pos, document_name, error, ok FROM results WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY source, document_name ORDER BY pos) = 1)""")
def unique_results(spark, d):
    return report.unique(_results(spark, d))


@query(f"""WITH {_RESULTS}, plan AS (SELECT 'src_' || i AS source FROM range(14) AS t(i)), per AS (SELECT source, count(*) AS n, count(DISTINCT document_name) AS names FROM results GROUP BY source)
SELECT source, coalesce(n, 0) AS n, coalesce(names, 0) AS names FROM plan LEFT JOIN per USING (source)""")
def results_with_empty(spark, d):
    plan = spark.range(14).select(F.concat(F.lit("src_"), F.col("id").cast("string")).alias("source"))
    return report.complete(plan, _results(spark, d)).select("source", "n", F.col("different").alias("names"))


@query(f"WITH {CALLS} SELECT call_id, json_extract_string(props, '$.k') AS k FROM calls")
def json_prop_extract(spark, d):
    return tables.calls(spark, d).select("call_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS label, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 999 END AS place FROM documents")
def stage_labels(spark, d):
    labels = spark.createDataFrame([("en", "English", 1), ("de", "German", 2)], "stage string, label string, place int")
    return stages.labelled(tables.read(spark, d, "documents").select("doc_id", F.col("lang").alias("stage")), labels).select("doc_id", "label", "place")


@query("""SELECT source, CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[1:len(l) - 1], ', ') || ', and ' || l[len(l)] END AS langs
FROM (SELECT source, list(DISTINCT lang ORDER BY lang) AS l FROM documents GROUP BY source)""")
def human_list(spark, d):
    per = tables.read(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    return per.select("source", text.listed("langs").alias("langs"))


_INTERNAL = ["src0", "src1", "src2", "src3"]
_REGISTRY = """held AS (SELECT source, count(*) AS n, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS kinds FROM documents WHERE source IS NOT NULL GROUP BY source),
registry AS (SELECT CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'internal_' ELSE 'external_' END || source AS key, 'Source ' || source AS display_name, n || ' documents: ' || kinds AS description, 'questions in ' || kinds AS use_when FROM held)"""


@query(f"""WITH {_REGISTRY} SELECT string_agg('<source id="' || key || '" name="' || display_name || '">' || chr(10) || '  ' || description || chr(10) || '  Use when: ' || use_when || chr(10) || '</source>',
chr(10) ORDER BY starts_with(key, 'external_'), key) AS statement FROM registry""")
def source_statement(spark, d):
    return registry.statement(registry.of_catalog(tables.catalog(spark, d), _INTERNAL))


@query(f"WITH {_REGISTRY} SELECT key, CASE WHEN starts_with(key, 'external_') THEN 'external' ELSE 'internal' END AS tier, CASE WHEN starts_with(key, 'external_') THEN 1 ELSE 0 END AS tier_rank FROM registry")
def registry_tiers(spark, d):
    return registry.tiers(registry.of_catalog(tables.catalog(spark, d), _INTERNAL)).select("key", "tier", "tier_rank")


# the other queries register themselves
from foliosift import queries_runs, queries_search, queries_store  # noqa: E402, F401
