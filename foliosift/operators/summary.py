"""Extractive summaries: of each document, and of whole sources.

A text's sentences are the nodes of a graph, weighted by the cosine of their terms (repeats times
the logarithm of how few of the text's sentences have the term). A sentence's rank is its share of a random walk
that follows the weights and with ``1 - DAMPING`` starts anew, in even shares or, given a question, in
shares that grow with the question's terms a sentence has. The walk is iterated until no text's
shares change by ``TOLERANCE`` in sum. The graph itself is never built: a step goes from
sentences to terms and back, so it costs as much as the text is long, and no pair of sentences is formed.

Sentences are then taken one by one: the best by rank times (1 - the largest cosine with one already
taken), as long as it fits the budget of tokens. What repeats a taken sentence has nothing to add
and is left out; if none fits at all, the best is taken alone. Ties go to the earlier sentence.

Sources are summarised in rounds over bounded groups of summaries, so no task sees a whole source.

Words are hashed and sentences cut by Spark; tasks get numbers alone, and rank all texts of a batch together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foliosift.functions.arrays import changes, lists, spread
from foliosift.operators import search
from foliosift.operators.assembly import KEY, documents
from foliosift.packaged import ship
from foliosift.scratch import dropped, written

DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-6, 200
#: Tokens of a summary; how much a question's terms draw the walk's starts; summaries of a group.
BUDGET, DRAW, FAN_IN = 120, 4.0, 64
#: Entries (a term in a sentence) that are worked on at once.
TOGETHER = 1 << 19
#: Where a sentence ends.
BREAK = r"(?<=[.!?])\s+|\n+"


class Graph:
    """The sentences of several texts: ``at`` is where each text's sentences start and the last end;
    ``words`` are the terms of all sentences, ``size`` how many each has."""

    def __init__(self, at: np.ndarray, words: np.ndarray, size: np.ndarray):
        self.at, self.n = at, len(size)
        self.text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        row = np.repeat(np.arange(self.n), size)
        by = np.lexsort((row, words, self.text[row]))
        row, words = row[by], words[by]
        text = self.text[row]
        new = changes(words, text)
        term = np.cumsum(new) - 1
        first = np.flatnonzero(changes(term, row))
        tf = np.diff(np.append(first, len(row)))
        self.row, self.term, self.hash = row[first], term[first], words[new]
        self.terms, self.of_text = int(new.sum()), text[new]
        held = np.bincount(self.term, minlength=self.terms)
        self.rare = np.log(1 + np.diff(at)[self.of_text] / np.maximum(held, 1))
        weight = tf * self.rare[self.term]
        norm = np.sqrt(np.bincount(self.row, weight**2, self.n))
        self.weight = weight / norm[self.row]
        self.full = (norm > 0).astype(float)

    def drawn(self, asked: list[np.ndarray | None]) -> np.ndarray:
        """Of each sentence the share of its text's question that it has, by the terms' weights."""
        wanted = np.zeros(self.terms)
        bounds = np.searchsorted(self.of_text, np.arange(len(self.at)))
        for t, words in enumerate(asked):
            if words is not None and len(words):
                own = slice(bounds[t], bounds[t + 1])
                wanted[own] = np.isin(self.hash[own], words)
        total = np.bincount(self.of_text, wanted * self.rare, len(self.at) - 1)
        got = np.bincount(self.row, (wanted * self.rare)[self.term], self.n)
        return got / np.maximum(total, 1e-300)[self.text]

    def ranks(self, draw: np.ndarray) -> np.ndarray:
        texts = len(self.at) - 1
        start = 1 + DRAW * draw
        start /= np.bincount(self.text, start, texts)[self.text]
        row, term, weight = self.row, self.term, self.weight
        near = lambda x, r, t, w: np.bincount(r, w * np.bincount(t, w * x[r], self.terms)[t], self.n) - self.full * x
        degree = near(np.ones(self.n), row, term, weight)
        linked = degree > 1e-12
        share, live = start.copy(), np.ones(texts, bool)
        for _ in range(ROUNDS):
            step = near(np.where(linked, share / np.where(linked, degree, 1), 0), row, term, weight)
            stuck = np.bincount(self.text, np.where(linked, 0, share), texts)[self.text]
            new = (1 - DAMPING) * start + DAMPING * (np.maximum(step, 0) * linked + stuck * start)
            change = np.bincount(self.text, np.abs(new - share), texts)
            share = np.where(live[self.text], new, share)
            live &= change >= TOLERANCE
            if not live.any():
                break
            if 2 * np.count_nonzero(live[self.text[row]]) < len(row):  # texts that have come to rest cost nothing more
                on = live[self.text[row]]
                row, term, weight = row[on], term[on], weight[on]
        return share

    def chosen(self, share: np.ndarray, tokens: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """Sentences in the order they are taken, and their ranks; texts one after another."""
        texts = len(self.at) - 1
        best, share = np.full(texts, 1e-300), share * self.full  # what has no word is never taken
        np.maximum.at(best, self.text, share)
        rank = share / best[self.text]
        left, repeated = np.full(texts, budget, np.int64), np.zeros(self.n)
        free, out, first = np.ones(self.n, bool), [], True
        by = np.argsort(self.row, kind="stable")
        term, weight, ends = self.term[by], self.weight[by], np.searchsorted(self.row[by], np.arange(self.n + 1))
        live = np.arange(self.n)
        while len(live):
            value = np.rint(1e9 * rank[live] * (1 - np.minimum(repeated[live], 1))).astype(np.int64)
            fits = tokens[live] <= left[self.text[live]]
            if first:  # a text none of whose sentences fits gives its best all the same
                fits |= ~np.isin(self.text[live], self.text[live[fits]])
            ok = free[live] & fits & (value > 0)
            live, value = live[ok], value[ok]
            if not len(live):
                break
            order = np.lexsort((live, -value, self.text[live]))
            head = np.append(True, np.diff(self.text[live[order]]) > 0)
            taken = live[order[head]]
            out.append(taken)
            free[taken] = False
            left[self.text[taken]] -= tokens[taken]
            entries, _ = spread(ends[taken], ends[taken + 1] - ends[taken])
            vector = np.zeros(self.terms)
            vector[term[entries]] = weight[entries]
            more, of = spread(ends[live], ends[live + 1] - ends[live])
            repeated[live] = np.maximum(repeated[live], np.bincount(of, weight[more] * vector[term[more]], len(live)))
            first = False
        taken = np.concatenate(out) if out else np.zeros(0, np.int64)
        by = np.argsort(self.text[taken], kind="stable")
        return taken[by], rank[taken[by]]


def _summarised(budget: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pc.greater(pc.list_value_length(whole.column("sizes")), 0))
            ends, low = np.cumsum(whole.column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while low < whole.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TOGETHER, side="right")))
                batch, low = whole.slice(low, high - low), high
                sizes, at = lists(batch.column("sizes"))
                words, _ = lists(batch.column("words"))
                tokens, _ = lists(batch.column("tokens"))
                asked = [x.values.to_numpy() if x.is_valid else None for x in batch.column("asked")]
                graph = Graph(at, words, sizes)
                taken, rank = graph.chosen(graph.ranks(graph.drawn(asked)), tokens.astype(np.int64), budget)
                text = graph.text[taken]
                places = np.searchsorted(text, np.arange(batch.num_rows + 1))
                order = np.arange(len(taken)) - places[text] + 1  # when each was taken in its text
                by = np.argsort(taken)  # a text's sentences in their order; texts stand one after another
                kinds = schema.field("summary").type.value_type
                entry = pa.StructArray.from_arrays([batch.column("texts").flatten().take(pa.array(taken[by])).cast(kinds[0].type), pa.array(order[by], pa.int64()), pa.array(np.rint(1e6 * rank[by]).astype(np.int64))], fields=list(kinds))
                yield pa.record_batch([batch.column("key"), pa.ListArray.from_arrays(pa.array(places, pa.int32()), entry)], names=["key", "summary"])

    return run


def sentences(content: Column) -> Column:
    """A text's sentences, without blanks around them."""
    return F.filter(F.transform(F.split(content, BREAK), lambda s: F.trim(s, F.lit(" \t\r\n\f\v"))), lambda s: s != "")


def tokens(text: Column) -> Column:
    """A sentence's tokens by the engine's estimate, one at least."""
    return F.greatest(F.floor(F.length(text) / 4).cast("long"), F.lit(1))


def summarise(rows: DataFrame, key: list[str], *, column: str = "sentences", asked: Column | None = None, budget: int = BUDGET) -> DataFrame:
    """rows has one row for each key, with an array of structs in which ``sentence`` is text. Returns
    the key and ``summary``: the structs taken, in their order, with ``taken`` (from 1, in the order of
    choice) and ``rank`` (in millionths of the text's best). Rows without a sentence give none."""
    ship(rows.sparkSession)
    # words are hashed once: sizes and the flat list come from the column, not from the text anew
    of_words = F.transform(column, lambda s: search.terms(s["sentence"]))
    hashed = rows.select(F.struct(*key).alias("key"), F.col(column).alias("texts"), of_words.alias("of_words"), F.transform(column, lambda s: tokens(s["sentence"])).alias("tokens"), (F.lit(None).cast("array<long>") if asked is None else asked).alias("asked"))
    numbers = hashed.select("key", "texts", F.transform("of_words", F.size).alias("sizes"), F.flatten("of_words").alias("words"), "tokens", "asked")
    entry = F.struct(F.get("texts", F.lit(0)).alias("s"), F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("rank"))
    schema = numbers.select("key", F.array(entry).alias("summary")).schema
    # only the sentences taken come back; rows without a sentence go there, as a filter here would cut all texts twice
    return numbers.mapInArrow(_summarised(budget, to_arrow_schema(schema)), schema).select("key.*", "summary")


def of_documents(catalog: DataFrame, sections: DataFrame, *, budget: int = BUDGET) -> DataFrame:
    """id, document_source, document_name and the document's summary; each sentence knows its section."""
    whole = documents(catalog, sections)
    cut = F.flatten(F.transform("sections", lambda s: F.transform(sentences(s["section_content"]), lambda t: F.struct(s["section_id"].alias("section_id"), s["section_name"].alias("section_name"), t.alias("sentence")))))
    return summarise(whole.select("id", "document_source", "document_name", cut.alias("sentences")), ["id", "document_source", "document_name"], budget=budget)


def of_sources(summaries: DataFrame, *, budget: int = BUDGET, fan_in: int = FAN_IN) -> DataFrame:
    """document_source and its summary, from its documents' summaries. Each round deals each source's
    summaries into groups of some ``fan_in`` / 2 at most, and summarises each, until there is one
    for each source. ``id`` stays with each sentence."""
    entry = F.transform("summary", lambda s: F.struct(F.col("id").alias("id"), s["s"]["section_id"].alias("section_id"), s["s"]["sentence"].alias("sentence")))
    now, turn = written(summaries.select("document_source", F.col("id").alias("first"), entry.alias("sentences")), "summaries"), 0
    while True:
        most = now.groupBy("document_source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        groups = 1 if most <= fan_in else -(-2 * most // fan_in)
        dealt = now.withColumn("group", F.pmod(F.xxhash64("first", F.lit(turn)), F.lit(groups)))
        together = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "sentences"))), lambda x: x["sentences"]))
        grouped = dealt.groupBy("document_source", "group").agg(F.min("first").alias("first"), together.alias("sentences"))
        done = summarise(grouped, ["document_source", "first"], budget=budget)
        before, turn = now, turn + 1
        now = written(done.select("document_source", "first", "summary", F.transform("summary", lambda s: s["s"]).alias("sentences")), "summaries")
        dropped(before)
        if groups == 1:
            return now.select("document_source", "summary")
