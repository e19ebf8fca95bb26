"""Queries over the document store: browsing, loading, choosing and writing out."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliosift import schemas
from foliosift.functions import text
from foliosift.operators import assembly, catalog as cat, profile, report, selection, tokens
from foliosift.register import query
from foliosift.sources import registry, sinks, tables
from foliosift.views import CATALOG, QUESTION, SECTIONS, TERMS, TITLE

_WIDE = """SELECT doc_id AS id, source AS document_source, lang AS document_type, 'doc_' || doc_id AS document_name, nullif(text, '') AS document_description,
'reference' AS document_usage, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 AS INTEGER)) AS date_created, TIMESTAMP '2024-06-01' + to_days(CAST(doc_id % 100 AS INTEGER)) AS date_last_modified,
'doc_' || doc_id || '.txt' AS file_name, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS file_size, '/' || source || '/doc_' || doc_id || '.txt' AS file_path FROM documents"""
_DAY = "CAST({0} AS DATE) AS {0}"


@query(f"SELECT * EXCLUDE (date_created, date_last_modified), {_DAY.format('date_created')}, {_DAY.format('date_last_modified')} FROM ({_WIDE}) WHERE document_source = 'src1'")
def wide_catalog_by_source(spark, d):
    rows = cat.wide(tables.wide_catalog(spark, d), "src1")
    return rows.withColumns({c: F.to_date(c) for c in ("date_created", "date_last_modified")})


@query(f"WITH {SECTIONS} SELECT document_name, section_id, section_name, section_summary, section_content FROM sections WHERE document_source = 'src1'")
def content_by_source(spark, d):
    return assembly.content_of(tables.sections(spark, d), "src1").select("document_name", "section_id", "section_name", "section_summary", "section_content")


@query(f"WITH {SECTIONS} SELECT document_name, section_id, section_content FROM sections WHERE document_source = 'src0' AND document_name = 'doc_10'")
def content_by_source_and_name(spark, d):
    return assembly.content_of(tables.sections(spark, d), "src0", "doc_10").select("document_name", "section_id", "section_content")


@query(f"WITH {CATALOG} SELECT id, document_name FROM catalog WHERE document_source = 'src0' AND document_type = 'en'")
def catalog_by_source_and_type(spark, d):
    return cat.of_source_and_type(tables.catalog(spark, d), "src0", "en").select("id", "document_name")


@query(f"WITH {SECTIONS} SELECT document_type, count(DISTINCT document_name) AS documents, count(*) AS sections, CAST(max(section_id) AS BIGINT) AS last_section FROM sections GROUP BY document_type")
def sql_section_counts(spark, d):
    statement = "SELECT document_type, count(DISTINCT document_name) AS documents, count(*) AS sections, CAST(max(section_id) AS BIGINT) AS last_section FROM {sections} GROUP BY document_type"
    return tables.sql(spark, statement, sections=tables.sections(spark, d))


@query("SELECT * FROM documents ORDER BY doc_id LIMIT 1")
def first_document(spark, d):
    return tables.read(spark, d, "documents").orderBy("doc_id").limit(1)


@query(f"""SELECT row_number() OVER (ORDER BY document_source NULLS LAST, id) AS id, CAST(NULL AS VARCHAR) AS created_at, document_source, document_type, document_name, document_description, document_usage,
file_name, CAST(NULL AS VARCHAR) AS file_type, file_size, file_path, CAST(NULL AS VARCHAR) AS file_link FROM ({_WIDE})""")
def loaded_catalog(spark, d):
    rows = sinks.loaded(tables.wide_catalog(spark, d).withColumnRenamed("id", "doc"), schemas.CATALOG, "document_source", "doc")
    return rows.drop("date_created", "date_last_modified").withColumn("created_at", F.col("created_at").cast("string"))


@query(f"""WITH {SECTIONS} SELECT row_number() OVER (ORDER BY document_name NULLS LAST, section_id) AS id, document_source, document_type, document_name, section_id, section_name, section_summary, section_content FROM sections""")
def loaded_sections(spark, d):
    return sinks.loaded(tables.sections(spark, d), schemas.SECTION, "document_name", "section_id").drop("created_at")


@query(f"""WITH {CATALOG}, {SECTIONS} SELECT id, document_name, '# ' || document_name || chr(10) || chr(10) || trim(string_agg('## ' || {TITLE} || chr(10) || section_content || chr(10), chr(10) ORDER BY section_id), chr(10) || chr(9) || ' ') || chr(10) || chr(10) || '---' AS text
FROM catalog JOIN sections USING (document_source, document_type, document_name) WHERE id = 7 GROUP BY id, document_name""")
def single_document_text(spark, d):
    return assembly.document_text(tables.catalog(spark, d), tables.sections(spark, d), 7)


@query(f"""WITH {CATALOG}, {SECTIONS} SELECT id, document_name, trim(string_agg('[' || section_id || '] ' || coalesce(nullif(section_name, ''), 'Main Section') || ': ' || coalesce(nullif(section_summary, ''), 'No summary available'), chr(10) ORDER BY section_id), chr(10) || chr(9) || ' ') AS text
FROM catalog JOIN sections USING (document_source, document_type, document_name) GROUP BY id, document_name""")
def section_summary_text(spark, d):
    return assembly.summary_texts(tables.catalog(spark, d), tables.sections(spark, d))


_SECTION_CHOICE = f"""{SECTIONS}, scored AS (SELECT *, len(list_intersect(list_distinct(regexp_split_to_array(lower(section_summary), '[^a-z0-9]+')), [{TERMS}])) AS score FROM sections),
chosen AS (SELECT document_source, document_type, document_name, section_id, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY document_source, document_type, document_name ORDER BY score DESC, section_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 2)"""


@query(f"WITH {_SECTION_CHOICE} SELECT * FROM chosen")
def sections_by_summary(spark, d):
    return selection.select_sections(tables.sections(spark, d), QUESTION, 2)


@query(f"WITH {_SECTION_CHOICE} SELECT document_name, section_id, section_content FROM sections SEMI JOIN chosen USING (document_source, document_type, document_name, section_id)")
def chosen_section_contents(spark, d):
    sections = tables.sections(spark, d)
    chosen = selection.select_sections(sections, QUESTION, 2)
    ids = chosen.groupBy(*assembly.KEY).agg(F.collect_list(F.col("section_id").cast("string")).alias("section_ids"))
    return assembly.chosen_sections(sections, ids).select("document_name", "section_id", "section_content")


@query("SELECT 'doc_' || doc_id AS document_name, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '')) AS tokens FROM documents")
def exact_token_counts(spark, d):
    docs = tables.catalog(spark, d).select("document_name", "document_description")
    return docs.select("document_name", text.words("document_description").alias("tokens"))


@query()
def exact_bpe_counts(spark, d):
    """Tokens of a public vocabulary; held against the library it is for by tests/test_tokens.py."""
    import public_tokenizers

    docs = tables.catalog(spark, d).select("id", "document_description")
    return tokens.counted(docs, "document_description", public_tokenizers.path("byte_bpe_50k.tiktoken")).select("id", "tokens")


@query("""WITH b(bucket, low, high) AS (VALUES (0, 0, 1000), (1, 1001, 2000), (2, 2001, 5000), (3, 5001, 10000), (4, 10001, 20000), (5, 20001, 50000), (6, 50001, NULL))
SELECT b.bucket, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high, count(doc_id) AS n, count(doc_id) * 100.0::DOUBLE / (SELECT count(*) FROM documents) AS pct
FROM b LEFT JOIN documents ON n_chars // 4 >= low AND n_chars // 4 <= coalesce(high, 1000000000) GROUP BY ALL""")
def token_histogram_large(spark, d):
    rows = tables.catalog(spark, d).select(F.floor(F.col("n_chars") / 4).cast("long").alias("tokens"))
    return profile.histogram(rows, profile.LARGE)


_WORDS = ", ".join("('{}', [{}])".format(r[0], ", ".join(f"'{w}'" for w in sorted({w for i in (2, 3, 5, 6) for w in r[i].lower().replace("-", " ").replace(",", " ").split()}))) for r in registry.DEFAULT)


@query(f"""WITH r(key, words) AS (VALUES {_WORDS}), asked AS (SELECT p_partkey, lower(p_name) || ' of policies and memos' || CASE p_partkey % 3 WHEN 0 THEN ' guidance' WHEN 1 THEN ' wording' ELSE '' END AS statement FROM part),
scored AS (SELECT p_partkey, key, len(list_intersect(words, list_distinct(regexp_split_to_array(statement, '[^a-z0-9]+')))) AS score FROM asked, r)
SELECT p_partkey, key AS source, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, starts_with(key, 'external_'), key) AS rank FROM scored QUALIFY rank <= 5""")
def plan_sources(spark, d):
    more = F.when(F.col("p_partkey") % 3 == 0, " guidance").when(F.col("p_partkey") % 3 == 1, " wording").otherwise("")
    asked = tables.read(spark, d, "part").select("p_partkey", F.concat(F.lower("p_name"), F.lit(" of policies and memos"), more).alias("statement"))
    names = schemas.SOURCE.fieldNames()
    return selection.plan_sources(asked, [dict(zip(names, r)) for r in registry.DEFAULT]).select("p_partkey", "rank", "source", "score")


@query("""WITH w AS (SELECT greatest(max(length(n_name)), 6) AS a, greatest(max(length(CAST(n_regionkey AS VARCHAR))), 11) AS b FROM nation)
SELECT n_name, n_regionkey, '| ' || rpad(n_name, CAST(a AS INTEGER), ' ') || ' | ' || rpad(CAST(n_regionkey AS VARCHAR), CAST(b AS INTEGER), ' ') || ' |' AS line FROM nation, w""")
def nation_grid(spark, d):
    return report.grid(tables.read(spark, d, "nation"), ["n_name", "n_regionkey"])


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(replace(lower(p_name), '_', ' '), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title, left(md5(p_name), 7) || '...' AS preview,
CAST(('0x' || left(md5(p_name), 8)) AS BIGINT) % 12 AS bucket FROM part""")
def names_for_display(spark, d):
    p = tables.read(spark, d, "part")
    return p.select("p_partkey", text.title_of(F.lower("p_name")).alias("title"), text.secret_preview(F.md5("p_name")).alias("preview"), text.bucket_of("p_name", 12).alias("bucket"))


@query("""SELECT doc_id, CASE WHEN text IS NOT NULL THEN len(string_split(text, ' ')) || ' items' END AS words, '2 items' AS facts, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE coalesce(text, '') END AS note FROM documents""")
def detail_values(spark, d):
    docs = tables.read(spark, d, "documents").select("doc_id", "text", F.split("text", " ", -1).alias("words"), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("facts"))
    return docs.select("doc_id", text.summed_up("array", "words").alias("words"), text.summed_up("map", "facts").alias("facts"), text.summed_up("string", "text").alias("note"))


@query("WITH p AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey) SELECT n_regionkey, array_to_string(names[1:3], ', ') AS names, len(names) > 3 AS more FROM p")
def first_names(spark, d):
    p = tables.read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("all_names"))
    few, more = text.first_names("all_names", 3)
    return p.select("n_regionkey", F.array_join(few, ", ").alias("names"), more.alias("more"))
