"""Queries that rank documents and sources for every question of the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliosift.operators import search, sources, summary
from foliosift.register import query
from foliosift.scratch import kept
from foliosift.sources import tables

_TERMS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
#: Term counts by document, and what each is worth.
_IMPACTS = rf"""d AS (SELECT source AS document_source, doc_id AS id, {_TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
tf AS (SELECT document_source, id, length, term, count(*) AS tf FROM (SELECT document_source, id, len(w) AS length, unnest(w) AS term FROM d) GROUP BY ALL),
n AS (SELECT document_source, count(*) AS n, sum(len(w)) / count(*)::DOUBLE AS mean FROM d WHERE len(w) > 0 GROUP BY ALL),
df AS (SELECT document_source, term, count(*) AS df FROM tf GROUP BY ALL),
impacts AS (SELECT document_source, id, term, CAST(round(1000::DOUBLE * (ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)))) AS BIGINT) AS impact
  FROM tf JOIN df USING (document_source, term) JOIN n USING (document_source)),
asked AS (SELECT DISTINCT conv_id, turn, unnest(list_distinct({_TERMS.format("text")})) AS term FROM conversations WHERE role = 'user')"""


def questions(spark, d):
    """The users' messages, numbered by conversation and turn (less than a million turns)."""
    rows = tables.messages(spark, d).where((F.col("role") == "user") & F.col("content").isNotNull())
    return rows.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("question"), F.col("content").alias("text"))


def told(rows):
    """conv_id and turn in place of the number."""
    return rows.select(F.expr("question div 1000000").alias("conv_id"), F.expr("question % 1000000").alias("turn"), *[c for c in rows.columns if c != "question"])


_BELIEFS = f"""{_IMPACTS}, sizes AS (SELECT document_source, sum(len(w)) AS words FROM d WHERE len(w) > 0 GROUP BY ALL),
overall AS (SELECT count(*) AS sources, avg(words)::DOUBLE AS mean_words FROM sizes),
held AS (SELECT document_source, term, df, words, count(*) OVER (PARTITION BY term) AS held FROM df JOIN sizes USING (document_source)),
beliefs AS (SELECT document_source, term, CAST(round(1000000::DOUBLE * (df / (df + 50::DOUBLE + 150::DOUBLE * words / mean_words)) * (ln((sources + 0.5::DOUBLE) / held) / ln(sources + 1::DOUBLE))) AS BIGINT) AS belief FROM held, overall)"""


@query(f"""WITH {_BELIEFS}, scores AS (SELECT conv_id, turn, document_source, CAST(sum(belief) AS BIGINT) AS score FROM asked JOIN beliefs USING (term) GROUP BY ALL HAVING sum(belief) > 0)
SELECT conv_id, turn, document_source, score, row_number() OVER best AS rank FROM scores WINDOW best AS (PARTITION BY conv_id, turn ORDER BY score DESC, document_source) QUALIFY rank <= 5 AND score * 2 >= first_value(score) OVER best""")
def sources_for_questions(spark, d):
    stood = search.index(tables.catalog(spark, d), kind="document_type")
    return told(kept(lambda: sources.choose(stood, questions(spark, d)), stood, name="chosen-sources"))


@query(f"""WITH {_IMPACTS}, scores AS (SELECT conv_id, turn, document_source, id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT conv_id, turn, document_source, id, score, row_number() OVER (PARTITION BY conv_id, turn, document_source ORDER BY score DESC, id) AS rank FROM scores QUALIFY rank <= 5""")
def documents_for_questions(spark, d):
    stood = search.index(tables.catalog(spark, d), kind="document_type")
    return told(kept(lambda: search.search(stood, questions(spark, d)), stood, name="found-documents"))


@query()
def document_summaries(spark, d):
    """Each document's sentences taken, by place; held by tests against the whole graph."""
    rows = summary.of_documents(tables.catalog(spark, d), tables.sections(spark, d))
    return rows.select("id", "document_source", "document_name", F.posexplode("summary").alias("place", "x")).select(
        "id", "document_source", "document_name", (F.col("place") + 1).cast("long").alias("place"), F.col("x.s.section_id").alias("section_id"), F.col("x.s.sentence").alias("sentence"), F.col("x.taken").alias("taken"), F.col("x.rank").alias("rank")
    )


@query()
def source_summaries(spark, d):
    """A summary of each source, in rounds over its documents' summaries."""
    rows = summary.of_sources(summary.of_documents(tables.catalog(spark, d), tables.sections(spark, d)))
    return rows.select("document_source", F.posexplode("summary").alias("place", "x")).select(
        "document_source", (F.col("place") + 1).cast("long").alias("place"), F.col("x.s.id").alias("id"), F.col("x.s.section_id").alias("section_id"), F.col("x.s.sentence").alias("sentence"), F.col("x.taken").alias("taken"), F.col("x.rank").alias("rank")
    )
