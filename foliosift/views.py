"""The shared tables as the engine sees them, in SQL, and what several queries share."""

QUESTION = "the thing that was with and other en de que worthless"

CATALOG = "catalog AS (SELECT doc_id AS id, source AS document_source, lang AS document_type, 'doc_' || doc_id AS document_name, nullif(text, '') AS document_description, n_chars FROM documents)"
SECTIONS = """sections AS (SELECT source AS document_source, lang AS document_type, 'doc_' || doc_id AS document_name, CAST(pos AS INTEGER) AS section_id,
  CASE WHEN pos > 0 THEN 'Part ' || pos END AS section_name, nullif(left(substr(text, pos * 1000 + 1, 1000), 80), '') AS section_summary, substr(text, pos * 1000 + 1, 1000) AS section_content
  FROM (SELECT *, unnest(generate_series(0, greatest((length(text) - 1) // 1000, 0))) AS pos FROM documents))"""
CALLS = """calls AS (SELECT event_id AS call_id, event_type AS stage, 'src_' || (user_id % 11) AS source, ts, value, event_id % 997 AS prompt_tokens, event_id % 331 AS completion_tokens,
  CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS prompt_cost, 1.5::DOUBLE AS completion_cost, event_id % 13 <> 0 AS ok, props FROM events)"""
COST = "(prompt_tokens / 1000.0::DOUBLE * prompt_cost + completion_tokens / 1000.0::DOUBLE * completion_cost)"
TITLE = "coalesce(nullif(section_name, ''), 'Section ' || section_id)"
MEASURES = ["prompt_tokens", "completion_tokens", "total_tokens", "cost", "duration"]
TERMS = ", ".join(f"'{w}'" for w in sorted(set(QUESTION.split())))
