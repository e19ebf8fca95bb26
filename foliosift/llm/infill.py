"""Fill-in-the-middle transformation of whole texts.

The kernel works on the UTF-8 buffer of a batch of rows. A table of byte classes tells letters
and bytes that continue a code point; a token starts at a byte that continues none, unless it and
the byte before it in its row are letters. Sums of these starts, begun anew in each row, number
the tokens, and one searchsorted over them finds both cuts of all rows. Which cuts and which form
a row gets is drawn by Spark from the SHA-256 of seed and id, so it doesn't depend on partitioning.

Forms: plain is the text as it is; psm is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; spm is
``<S>`` suffix ``<P>`` prefix ``<M>`` middle. ``restored`` undoes them: a text that holds a mark
stays plain, and no mark can begin in a part and end in the mark after it, so the first of each is the one set.

Defined results: a null or empty text is plain and empty; a null id is drawn for as an empty one;
repeated rows come out alike; rows that share an id but differ in text share what is drawn, and
each is cut by its own length; texts of any length are cut as wholes; an empty table gives an
empty result; only the id and text columns are read, so no other name can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliosift.llm.buffers import in_slices, utf8
from foliosift.llm.common import table
from foliosift.packaged import ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that are handled at once.
TOGETHER = 4 << 20
LETTER, INSIDE = 1, 2
CLASSES = np.zeros(256, np.uint8)
CLASSES[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
CLASSES[0x80:0xC0] = INSIDE
PARTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _marked(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows that hold one of the marks."""
    hit = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & np.isin(data[1:-1], np.frombuffer(b"PSM", np.uint8)))
    row = np.searchsorted(at, hit, side="right") - 1
    out = np.zeros(len(at) - 1, bool)
    out[row[hit + 2 < at[row + 1]]] = True
    return out


def kernel(data: np.ndarray, at: np.ndarray, draws: list[np.ndarray], plain: int, spm: int) -> tuple[np.ndarray, ...]:
    """Of each row: tokens, form (0 plain, 1 psm, 2 spm), where the prefix and the middle end,
    and the code points of both."""
    kind = CLASSES[data]
    letter, lead = kind == LETTER, kind != INSIDE
    joined = letter.copy()
    joined[1:] &= letter[:-1]
    joined[:1] = False
    joined[at[:-1][at[:-1] < at[1:]]] = False
    tokens, chars = (np.append(0, np.cumsum(x)) for x in (lead & ~joined, lead))
    base = tokens[at[:-1]]
    n = tokens[at[1:]] - base
    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    cuts = np.searchsorted(tokens, np.concatenate([base + np.minimum(one, two), base + np.maximum(one, two)]), side="right") - 1
    first, last = np.minimum(cuts, np.tile(at[1:], 2)).reshape(2, -1)
    form = np.where((n == 0) | _marked(data, at) | (draws[2] % 100 >= plain), 0, np.where(draws[3] % 100 < spm, 2, 1))
    return n, form, first, last, chars[first] - chars[at[:-1]], chars[last] - chars[first]


def _transformed(plain: int, spm: int) -> Callable:
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1, TOGETHER):
            data, at = utf8(batch.column(1))
            n, form, first, last, prefix, middle = kernel(data, at, [batch.column(i).to_numpy() for i in range(2, 6)], plain, spm)
            raw, out = data.tobytes(), []
            for a, b, c, d, f in zip(at.tolist(), first.tolist(), last.tolist(), at[1:].tolist(), form.tolist()):
                if f == 0:
                    out.append(raw[a:d])
                elif f == 1:
                    out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
                else:
                    out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
            cut = form > 0
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(["plain", "psm", "spm"])[form]), pa.array(prefix, pa.int64(), mask=~cut),
                 pa.array(middle, pa.int64(), mask=~cut), pa.array(out, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", seed: int = 1, transformed: int = 90, spm: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, tokens n, form, code points of prefix and middle, output.
    Of a hundred texts some ``transformed`` are, ``spm`` in a hundred of these suffix first."""
    ship(docs.sparkSession)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(drawn, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), *draws)
    return rows.mapInArrow(_transformed(transformed, spm), PARTS)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made from."""

    def split(text: Column, mark: str) -> tuple[Column, Column]:
        head = F.substring_index(text, mark, 1)
        return head, F.substr(text, F.length(head) + 1 + len(mark))

    body = F.substr(output, F.lit(1 + len(PREFIX)))
    prefix, rest = split(body, SUFFIX)
    suffix, middle = split(rest, MIDDLE)
    psm = F.concat(prefix, middle, suffix)
    suffix, rest = split(body, PREFIX)
    prefix, middle = split(rest, MIDDLE)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return parts.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), numbers AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS one, greatest(h1 % (n + 1), h2 % (n + 1)) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT *, array_to_string(units[1:one], '') AS prefix, array_to_string(units[one + 1:two], '') AS middle, array_to_string(units[two + 1:n], '') AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""
