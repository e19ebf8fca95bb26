"""Text functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_default(c, default: Column) -> Column:
    """c, where it is null or empty the default."""
    return F.coalesce(F.nullif(col(c), F.lit("")), default)


def section_title(name, section_id) -> Column:
    return or_default(name, F.concat(F.lit("Section "), col(section_id).cast("string")))


def ellipsis(c, most: int = 60) -> Column:
    """Longer texts end in three dots and are so many characters in all."""
    return F.when(F.length(col(c)) > most, F.concat(F.left(col(c), F.lit(most - 3)), F.lit("..."))).otherwise(col(c))


def preview(c, chars: int = 50) -> Column:
    """The first characters, and three dots where there are more; null is empty."""
    c = F.coalesce(col(c), F.lit(""))
    return F.when(F.length(c) > chars, F.concat(F.left(c, F.lit(chars)), F.lit("..."))).otherwise(c)


def listed(names) -> Column:
    """An array as 'a', 'a and b' or 'a, b, and c'."""
    a = col(names)
    return (
        F.when(F.size(a) == 0, "").when(F.size(a) == 1, F.get(a, F.lit(0))).when(F.size(a) == 2, F.array_join(a, " and "))
        .otherwise(F.concat(F.array_join(F.slice(a, F.lit(1), F.size(a) - 1), ", "), F.lit(", and "), F.element_at(a, -1)))
    )


def first_names(names, most: int = 10) -> tuple[Column, Column]:
    """The first names of an array, and whether there are more."""
    return F.slice(col(names), 1, most), F.size(col(names)) > most


def title_of(c) -> Column:
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def stage_parts(stage) -> tuple[Column, Column]:
    """Source and number in 'db_query_<source>_<number>'; the source may hold underscores."""
    pattern = r"^db_query_(.+)_([0-9]+)$"
    return F.regexp_extract(col(stage), pattern, 1), F.regexp_extract(col(stage), pattern, 2).try_cast("int")


def bucket_of(c, buckets: int) -> Column:
    """A bucket that is the same in every process and every engine: of the first 32 bits of md5."""
    return F.conv(F.left(F.md5(col(c)), F.lit(8)), 16, 10).cast("long") % buckets


def secret_preview(c, shown: int = 7) -> Column:
    return F.concat(F.left(col(c), F.lit(shown)), F.lit("..."))


def continued(statement, is_continuation) -> Column:
    return F.when(col(is_continuation), F.concat(F.lit("Continuing the earlier question: "), col(statement))).otherwise(col(statement))


def summed_up(kind: str, c) -> Column:
    """A detail for a report: the size of a list or map, the first 50 characters of a text."""
    if kind in ("array", "map"):
        return F.concat(F.size(col(c)).cast("string"), F.lit(" items"))
    return preview(col(c).cast("string"))


def tokens(c) -> Column:
    """The estimate of a quarter token a character, rounded down; null is 0."""
    return F.floor(F.length(F.coalesce(col(c), F.lit(""))) / F.lit(4)).cast("long")


def words(c: str) -> Column:
    """How many words a text has: what lies between spaces, tabs and line ends."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "[ \t\n\r]+"), lambda w: w != "")).cast("long")
