"""URL filters: an as-of join of captures with dated list entries.

A list is a log: a pattern was added to, or removed from, a named list on a date. Per
list and pattern, each addition holds until the pattern's next event; these validity
intervals don't overlap. A pattern is a host, a parent domain or a host with the
first folder of a path. A capture asks for its own patterns at its fetch time; of
the entries active then, the most specific decides, and "allow" wins a tie.

The as-of join: a pattern's intervals are one row, an array of a list's entries in their
order, so a capture meets each of its patterns once, and the entries active at its time are
picked within the row. The arrays are written once and broadcast while they have at most
``broadcast_entries`` entries; above that the join is by pattern, where adaptive execution
splits a busy host's captures.

Defined results: a null or unreadable address, or a null fetch time, is not listed;
several events of a pattern on one instant count as the last by action (remove);
repeated captures each get a verdict; empty tables give no verdicts or no listings;
the captures' other columns are kept, and one named like an added column is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliosift.llm.common import cut, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def intervals(log: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (exclusive; null while it still holds)."""
    once = log.groupBy("list", "pattern", "happened").agg(F.max("action").alias("action"))
    later = Window.partitionBy("list", "pattern").orderBy("happened")
    return once.withColumn("valid_to", F.lead("happened").over(later)).where("action = 'add'").select("list", "pattern", F.col("happened").alias("valid_from"), "valid_to")


ADDED = ["host", "verdict", "pattern", "valid_from"]


def judge(captures: DataFrame, log: DataFrame, *, url_column: str = "url", time_column: str = "fetched_at", broadcast_entries: int = 1_000_000) -> DataFrame:
    """captures with host, verdict (block, allow or none), pattern and valid_from of the deciding entry."""
    entry = F.struct((F.col("list") == "allow").alias("allow"), "valid_from", "valid_to", "list")
    held = cut(intervals(log).groupBy("pattern").agg(F.sort_array(F.collect_list(entry)).alias("entries")), "intervals")
    if (held.agg(F.sum(F.size("entries"))).first()[0] or 0) <= broadcast_entries:
        held = F.broadcast(held)
    patterns = (
        "concat(array(struct(100 AS rank, concat(host, folder) AS pattern)),"
        " transform(sequence(1, size(labels)), i -> struct(100 - i AS rank, concat_ws('.', slice(labels, i, size(labels))) AS pattern)))"
    )
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    whole = F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row")
    rows = captures.select(whole, F.col(url_column).alias("url"), F.col(time_column).alias("t"))
    asked = rows.select("url", "t").where("url IS NOT NULL AND t IS NOT NULL").distinct()
    asked = asked.withColumns({"host": host, "folder": F.regexp_extract("url", r"^[^:]*://[^/?#]*(/[^/?#]*)", 1)})
    asked = asked.where("host <> ''").withColumn("labels", F.split("host", "[.]")).withColumn("p", F.explode(F.expr(patterns)))
    met = asked.select("url", "t", "p.rank", "p.pattern").join(held, "pattern")
    active = F.expr("transform(filter(entries, e -> t >= e.valid_from AND (e.valid_to IS NULL OR t < e.valid_to)), e -> struct(rank, e.allow AS allow, e.valid_from AS valid_from, pattern, e.list AS list))")
    best = met.select("url", "t", F.array_max(active).alias("b")).where("b IS NOT NULL").groupBy("url", "t").agg(F.max("b").alias("b"))
    out = rows.join(best, ["url", "t"], "left")
    kept = [F.col("row")[c].alias(c) for c in captures.columns if c not in ADDED]
    return out.select(*kept, host.alias("host"), F.coalesce("b.list", F.lit("none")).alias("verdict"), F.col("b.pattern").alias("pattern"), F.col("b.valid_from").alias("valid_from"))


#: The tables have no fetch times and no lists: both are derived from the addresses, the
#: same way in Spark and in SQL. {number} is a number from the first hex digits of a hash.
LOG_SQL = """
WITH hosts AS (SELECT DISTINCT lower(regexp_extract(url, '{host}', 1)) AS host FROM {pages}),
numbered AS (SELECT host, {number} AS h, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS parent FROM hosts WHERE host <> '')
SELECT 'block' AS list, host AS pattern, 'add' AS action, {day}h % 120{end} AS happened FROM numbered WHERE h % 3 = 0
UNION ALL SELECT 'block', host, 'remove', {day}h % 120 + 60{end} FROM numbered WHERE h % 3 = 0
UNION ALL SELECT 'block', host, 'add', {day}h % 120 + 150{end} FROM numbered WHERE h % 6 = 0
UNION ALL SELECT 'block', host || '/en', 'add', {day}h % 200{end} FROM numbered WHERE h % 5 = 1
UNION ALL SELECT 'allow', host, 'add', {day}290{end} FROM numbered WHERE h % 4 = 2
UNION ALL SELECT DISTINCT 'block', parent, 'add', {day}280{end} FROM numbered WHERE parent <> '' AND h % 2 = 0
"""


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetched_at", F.expr("date_add(DATE '2024-01-01', CAST(page_id * 37 % 365 AS INT))"))
    sql = LOG_SQL.format(host=HOST.replace("\\", "\\\\"), number="CAST(conv(substr(md5(host), 1, 4), 16, 10) AS INT)", day="date_add(DATE '2024-01-01', ", end=")", pages="{pages}")
    return judge(pages, spark.sql(sql, pages=pages))


ORACLE = f"""
WITH log AS ({LOG_SQL.format(host=HOST, number="CAST('0x' || substr(md5(host), 1, 4) AS INTEGER)", day="DATE '2024-01-01' + CAST(", end=" AS INTEGER)", pages="pages")}),
held AS (
  SELECT * FROM (
    SELECT list, pattern, action, happened AS valid_from, lead(happened) OVER (PARTITION BY list, pattern ORDER BY happened) AS valid_to
    FROM (SELECT list, pattern, happened, max(action) AS action FROM log GROUP BY ALL)) WHERE action = 'add'),
captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS fetched_at,
    lower(regexp_extract(url, '{HOST}', 1)) AS host, regexp_extract(url, '^[^:]*://[^/?#]*(/[^/?#]*)', 1) AS folder FROM pages),
asked AS (
  SELECT page_id, fetched_at, 100 AS rank, host || folder AS pattern FROM captures WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, 100 - i, array_to_string(list_slice(string_split(host, '.'), i, 99), '.')
  FROM captures, unnest(generate_series(1, len(string_split(host, '.')))) AS g(i) WHERE host <> ''),
best AS (
  SELECT page_id, list, pattern, valid_from FROM asked JOIN held USING (pattern)
  WHERE fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, list = 'allow' DESC, valid_from DESC) = 1)
SELECT page_id, url, CAST(fetched_at AS DATE) AS fetched_at, host, coalesce(list, 'none') AS verdict, pattern, CAST(valid_from AS DATE) AS valid_from
FROM captures LEFT JOIN best USING (page_id)"""
