"""Choosing the sources of a question by what they hold: collection selection from term statistics.

Each source counts as one big document. The belief that a source answers a term grows with the
number of its documents that hold the term, against the source's size, and falls with the number of sources
that hold it at all (the CORI weights):

    df / (df + 50 + 150 * words / mean words) * ln((C + 0.5) / held) / ln(C + 1)

with C sources. Beliefs are whole numbers of millionths, so sums don't depend on their order. The
statistics come out of the index's own counts; no text is read. A term's beliefs for all sources
are one row, and questions meet them term by term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliosift.operators.search import MOST, terms

SCALE, SHARE = 1_000_000, 0.5


def statistics(index: DataFrame) -> DataFrame:
    """(source, term, df, words): documents of each source that hold each term, words of the source."""
    rows = index.select("source", "words", F.inline(F.arrays_zip("terms", "dfs")))
    return rows.groupBy("source", F.col("terms").alias("term")).agg(F.sum("dfs").alias("df"), F.first("words").alias("words"))


def beliefs(index: DataFrame) -> DataFrame:
    """(term, held: array of source and belief)."""
    sizes = index.select("source", "words").distinct()
    count, mean = sizes.agg(F.count(F.lit(1)), F.avg("words")).first()
    of_term = statistics(index).groupBy("term").agg(F.collect_list(F.struct("source", "df", "words")).alias("held"))
    rare = F.log((F.lit(float(count)) + 0.5) / F.size("held")) / F.log(F.lit(count + 1.0))
    belief = lambda x: F.round(F.lit(float(SCALE)) * (x["df"] / (x["df"] + F.lit(50.0) + F.lit(150.0) * x["words"] / F.lit(mean or 1.0))) * rare).cast("long")
    return of_term.select("term", F.transform("held", lambda x: F.struct(x["source"].alias("source"), belief(x).alias("belief"))).alias("held"))


def choose(index: DataFrame, questions: DataFrame, *, question: str = "question", text: str = "text", most: int = MOST, share: float = SHARE) -> DataFrame:
    """question, document_source, score, rank: for each question the sources with most belief, at
    most so many, and only those with at least ``share`` of the best one's. Ties go by name. A
    question none of whose terms is held gets no source."""
    asked = questions.select(F.col(question).cast("long").alias("question"), F.explode(F.array_distinct(terms(text))).alias("term"))
    met = asked.join(beliefs(index), "term").select("question", F.inline("held"))
    scores = met.groupBy("question", "source").agg(F.sum("belief").alias("score")).where("score > 0")
    best = Window.partitionBy("question").orderBy(F.desc("score"), F.col("source").asc_nulls_last())
    ranked = scores.select("question", F.col("source").alias("document_source"), "score", F.row_number().over(best).cast("long").alias("rank"), F.first("score").over(best).alias("top"))
    return ranked.where((F.col("rank") <= most) & (F.col("score") >= F.col("top") * F.lit(share))).drop("top")
