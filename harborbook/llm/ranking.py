"""The highest-scoring documents for each query by sequential reads of impact-sorted postings (NRA).

An impact is what a term adds to the score of a document, so scores are sums of impacts of at most one posting a list.  Lists
are read from their largest impact on, each to the same depth.  What has been read of a document is the lower end of its
score; the upper end adds, for each list in which it has not been seen, the impact that is read next there.  Documents
whose upper end is below the last place drop out.  Reading goes on until the ends meet for all others, so that membership,
ties and scores are settled; no list is ever asked for a document.

Documents are partitioned: each task reads the lists of its own documents, a bounded number of postings at a time, and keeps the
best of each query as the last place of what it reads next.  A window selects among what the tasks kept.  The weights of
terms come from counts over all documents.  Queries are worked on in portions of bounded size, of which there is one
unless there are very many.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborbook.llm.tables import written

#: (query, term) pairs of a portion on average, postings that are read together, entries read of each list at first and how
#: many times as far with every further read, bytes of a text that are split at once.
PAIRS, POSTINGS, FIRST, FURTHER, AT_ONCE = 1_000_000, 2_000_000, 128, 4, 1 << 22

#: Bytes that part terms become blanks, A-Z become a-z.
_FOLD = bytes(
    32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)


def count_terms(text: str | None) -> Counter:
    """Occurrences of each term, as UTF-8, in the whole text; null has none.

    Terms are the longest runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased.
    """
    folded = (text or "").encode().translate(_FOLD)
    out, start = Counter(), 0
    while len(folded) - start > AT_ONCE and (end := folded.find(b" ", start + AT_ONCE)) >= 0:
        out.update(folded[start:end].split())
        start = end
    out.update((folded[start:] if start else folded).split())
    return out


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Queries:
    """Queries of a portion as numbers of terms, and the weight of each term."""

    terms: list[np.ndarray]
    weights: np.ndarray
    documents: int
    total: int


def read(lists: list[tuple[np.ndarray, np.ndarray]], order: np.ndarray, most: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, score) of the ``most`` best documents with a score of ``floor`` or more, and above 0, best first.

    ``lists`` are (documents, falling impacts), ``order`` has the place of each document among equal scores.
    """
    size = len(order)
    lower = np.zeros(size, np.int64)
    seen: list[tuple[np.ndarray, np.ndarray]] = []  # (document, number of the list) of all that has been read
    begin, depth = 0, FIRST
    while True:
        parts = [(docs[begin:depth], impacts[begin:depth]) for docs, impacts in lists]
        # Below 2^53, so doubles add these up exactly.
        lower += np.bincount(np.concatenate([d for d, _ in parts]), np.concatenate([i for _, i in parts]), size).astype(np.int64)
        seen += [(d, np.full(len(d), t)) for t, (d, _) in enumerate(parts) if len(d)]
        following = np.array([impacts[depth] if depth < len(impacts) else 0 for _, impacts in lists], np.float64)
        doc, number = (np.concatenate([s[k] for s in seen]) for k in (0, 1))
        upper = lower + int(following.sum()) - np.bincount(doc, following[number], size).astype(np.int64)
        last = max(floor, 1)
        if size > most:
            last = max(last, int(np.partition(lower, size - most)[size - most]))
        alive = np.flatnonzero(upper >= last)
        if (upper[alive] == lower[alive]).all():
            best = alive[np.lexsort((order[alive], -lower[alive]))][:most]
            return best, lower[best]
        begin, depth = depth, depth * FURTHER


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Number of terms of each document, and those of the vocabulary with their occurrences."""
    for batch in batches:
        sizes, ends, terms, times = [], [0], [], []
        for text in batch.column("text"):
            found = count_terms(text.as_py())
            sizes.append(found.total())
            for term in found.keys() & vocabulary.keys():
                terms.append(vocabulary[term])
                times.append(found[term])
            ends.append(len(terms))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (times, pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "times"])


class Search:
    """The best documents so far of each query, over the documents of one task."""

    def __init__(self, queries: Queries, most: int):
        self.queries, self.most = queries, most
        none = np.zeros(0, np.int64)
        self.best = [(none, none, none.astype(bool))] * len(queries.terms)

    def over(self, ids: np.ndarray, null: np.ndarray, sizes: np.ndarray, counts: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        """Take up the postings of some documents: ``counts`` of them for each, one document after the other."""
        q = self.queries
        doc = np.repeat(np.arange(len(ids)), counts)
        share = 100 - 50 + (50 * sizes * q.documents) // q.total
        impact = q.weights[terms] * ((1_000_000_000 * times) // (1000 * times + 20 * share[doc]))
        by = np.lexsort((-impact, terms))
        doc, impact = doc[by], impact[by]
        start = np.searchsorted(terms[by], np.arange(len(q.weights) + 1))
        order = np.empty(len(ids), np.int64)
        order[np.lexsort((ids, null))] = np.arange(len(ids))
        for k, wanted in enumerate(q.terms):
            lists = [(doc[start[t] : start[t + 1]], impact[start[t] : start[t + 1]]) for t in wanted if start[t] < start[t + 1]]
            if not lists:
                continue
            score, id, unnamed = self.best[k]
            found, value = read(lists, order, self.most, int(score[-1]) if len(score) == self.most else 0)
            score, id, unnamed = np.concatenate([score, value]), np.concatenate([id, ids[found]]), np.concatenate([unnamed, null[found]])
            kept = np.lexsort((id, unnamed, -score))[: self.most]
            self.best[k] = score[kept], id[kept], unnamed[kept]

    def rows(self) -> pa.RecordBatch:
        query = np.repeat(np.arange(len(self.best)), [len(b[0]) for b in self.best])
        score, id, unnamed = (np.concatenate([b[c] for b in self.best]) if self.best else np.zeros(0) for c in range(3))
        columns = [pa.array(query, pa.int64()), pa.array(id, pa.int64(), mask=unnamed.astype(bool)), pa.array(score, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["query", "id", "score"])


def _searched(batches: Iterator[pa.RecordBatch], queries: Queries, most: int) -> Iterator[pa.RecordBatch]:
    search, held, count = Search(queries, most), [], 0

    def work(parts: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(parts).combine_chunks()
        flat = [table.column(c).combine_chunks() for c in ("id", "n", "terms", "times")]
        id, n, terms, times = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in flat)
        null = id.is_null().to_numpy(zero_copy_only=False)
        counts = np.diff(terms.offsets.to_numpy())
        search.over(id.fill_null(0).to_numpy(), null, n.to_numpy(), counts, terms.flatten().to_numpy(), times.flatten().to_numpy())

    for batch in batches:
        while len(batch):
            # As many documents as there is room for, one at least.
            ends = batch.column("terms").offsets.to_numpy()
            fit = max(1, int(np.searchsorted(ends - ends[0], POSTINGS - count, side="right")) - 1)
            part, batch = batch.slice(0, fit), batch.slice(fit)
            held.append(part)
            count += int(ends[min(fit, len(ends) - 1)] - ends[0])
            if count >= POSTINGS or len(batch):
                work(held)
                held, count = [], 0
    if held:
        work(held)
    yield search.rows()


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, t) for i, text in enumerate(batch.column("text")) for t in count_terms(text.as_py())]
        ids = batch.column("id").take(pa.array([i for i, _ in found], pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array([t for _, t in found], pa.binary())], names=["id", "term"])


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    *,
    most: int = 50,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` highest-scoring documents of each item with a score above 0.

    Terms are those of ``count_terms``.  N counts the documents with a term, L all their terms, n those of one document, df
    the documents that hold a term, tf its occurrences in one.  A term weighs w = floor(1000 * ln((2N + 2) / (2 df + 1))), and a
    document scores the sum over the item's terms, once each, of w * ((10^9 tf) div (1000 tf + 20 m)), m = 50 + (50 n N) div L.
    Equal scores are ranked by the smaller id.

    Null and empty texts have no terms; items without a term, or of which no document holds one, have no rows.  Rows of
    ``docs`` are documents of their own, also with equal ids; null ids come last among equal scores.  Rows of ``items`` with
    one id (null too) are one item with the terms of all.  Empty tables give no rows.  Ids are integers.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).alias("text"))
    asked = written(asked.mapInArrow(_terms_of, "id bigint, term binary").distinct(), "terms")
    portions = max(1, -(-asked.count() // PAIRS))
    out = None
    for portion in range(portions):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(portions)) == portion)
        rows = mine.collect()  # about PAIRS, but for an item with more terms than that
        found = _rank_portion(base, [(r["id"], bytes(r["term"])) for r in rows], most)
        out = found if out is None else out.union(found)
    return out


def _rank_portion(base: DataFrame, pairs: list[tuple[int | None, bytes]], most: int) -> DataFrame:
    spark = base.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, t in pairs}))}
    by_item: dict[int | None, list[int]] = {}
    for item, term in pairs:
        by_item.setdefault(item, []).append(vocabulary[term])
    shared = spark.sparkContext.broadcast(vocabulary)
    counted = base.mapInArrow(lambda b: _counted(b, shared.value), "id bigint, n bigint, terms array<int>, times array<bigint>")
    counted = written(counted, "counted")
    facts = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("total")).first()
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # terms of the portion
    weights = np.zeros(len(vocabulary), np.int64)
    for r in holding:
        weights[r["term"]] = weight(facts["documents"], r["count"])
    names = list(by_item)
    queries = Queries([np.array(sorted(by_item[i])) for i in names], weights, facts["documents"], max(1, facts["total"] or 0))
    spread = spark.sparkContext.broadcast(queries)
    found = counted.where("size(terms) > 0").mapInArrow(lambda b: _searched(b, spread.value, most), "query bigint, id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    named = spark.createDataFrame(list(enumerate(names)), "number bigint, item_id bigint")
    return found.join(named, F.col("query") == F.col("number")).select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
