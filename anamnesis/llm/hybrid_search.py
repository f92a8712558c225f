"""Ranked search over whole texts, term at a time for short posting lists and document at a time for long ones.

1. One pass over the documents writes an index: blocks of documents with their lengths and, for every term that a query has,
   the documents of the block and how often they hold it. Document frequencies and lengths are sums over the index.
2. A task goes through its blocks for each query. The short lists of the query in the block are summed term at a time into
   accumulators, which from then on are one iterator with a bound for every run of ``RUN`` documents. The long
   lists have bounds by run as well. Runs whose bounds together are below the k-th best score found so far, in
   this block or an earlier one of the task, are skipped; the others are scored document at a time, in order.
3. The k best of each task are merged per query.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z in lower case, told apart by 64-bit
hashes. All scores are whole numbers. Null, empty and blank texts have no terms: such a document is never found, such a
query finds none. Every row is a document or query of its own, also if rows repeat; equal scores go by ascending id, null
ids last. Queries are gathered in blocks of ``BLOCK_TERMS`` terms, each for one pass over the index.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.llm.bytewords import ALNUM, LOWER, Words, text_runs
from anamnesis.llm.common import materialise, send_code
from anamnesis.sources.workspace import spread

#: Documents, and postings, of a block at most; a single longer document aside.
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 21
#: Documents that share a bound.
RUN = 64
#: Runs that are scored before the threshold is looked at again.
STEP = 8
#: A list is long if it has this share of the documents of a block.
LONG_SHARE = 1 / 16
#: Terms of all queries up to which only these are indexed; with more, all terms of the documents are.
MAX_TERMS = 1 << 22
#: (query, term) rows that are broadcast at once, a single longer query aside.
BLOCK_TERMS = 1 << 20


def _terms(texts: pa.Array) -> Iterator[tuple[int, Words, np.ndarray]]:
    for first, data, offsets in text_runs(texts):
        words = Words(LOWER[data], offsets, ALNUM)
        yield first, words, words.hashes().view(np.int64)


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(query, id) for each row and (query, term) once for each of its terms; written."""
    send_code(queries.sparkSession)

    def run(batches):
        for batch in batches:
            for first, words, hashes in _terms(batch.column(1)):
                numbers = batch.column(0).to_numpy()[first + words.row]
                pairs = np.unique(np.stack([numbers, hashes]), axis=1)
                yield pa.record_batch([pa.array(pairs[0].copy()), pa.array(pairs[1].copy())], names=["query", "term"])

    named = queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = materialise(named, "queries")
    return named.select("query", "id"), materialise(named.select("query", "text").mapInArrow(run, "query long, term long"), "terms")


def _blocks(batch: pa.RecordBatch, vocabulary: np.ndarray | None) -> Iterator[tuple]:
    """(first row, lengths, terms, counts, places, times) of blocks of a batch; postings go by term and place."""
    start, lengths, postings, size = 0, [], [], 0

    def block():
        term, place, times = (np.concatenate(c) for c in zip(*postings, strict=True))
        order = np.lexsort((place, term))
        terms, counts = np.unique(term, return_counts=True)
        return start, np.concatenate(lengths), terms, counts, place[order], times[order]

    for first, words, hashes in _terms(batch.column(1)):
        counts = np.diff(words.first)
        row = words.row
        if vocabulary is not None:
            at = np.searchsorted(vocabulary, hashes)
            known = vocabulary[np.minimum(at, len(vocabulary) - 1)] == hashes if len(vocabulary) else np.zeros(len(hashes), dtype=bool)
            hashes, row = hashes[known], row[known]
        order = np.lexsort((row, hashes))
        hashes, row = hashes[order], row[order]
        fresh = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))[: len(hashes)])
        if lengths and (first + len(counts) - start > BLOCK_DOCS or size + len(fresh) > BLOCK_POSTINGS):
            yield block()
            start, lengths, postings, size = first, [], [], 0
        lengths.append(counts)
        postings.append((hashes[fresh], first - start + row[fresh], np.diff(np.append(fresh, len(hashes)))))
        size += len(fresh)
    if lengths:
        yield block()


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per block of documents: ids, lengths, terms, counts (documents by term), places and times; written.

    Of a ``vocabulary`` (sorted hashes) only its terms have postings. Lengths always count all terms.
    """
    send_code(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            for start, lengths, *parts in _blocks(batch, shared.value):
                ids = batch.column(0).slice(start, len(lengths))
                lists = [pa.array([part], pa.list_(t)) for part, t in zip([lengths, *parts], types, strict=True)]
                ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.record_batch([ids, *lists], names=["ids", "lengths", "terms", "counts", "places", "times"])

    out = f"ids array<{kind}>, lengths array<int>, terms array<long>, counts array<int>, places array<int>, times array<int>"
    rows = spread(docs.select(F.col(id_col), F.col(text_col)))
    return materialise(rows.mapInArrow(run, out), "index")


class Best:
    """The k best (score, id) of a query: highest score first, then the least id, null ids last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.rows: list[tuple] = []
        self.least = 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        rows = [(-int(s), i is None, i if i is not None else 0) for s, i in zip(scores, ids, strict=True)]
        self.rows = heapq.nsmallest(self.k, self.rows + rows)
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


class Block:
    """The postings of a block as scores of its documents, bounded by runs."""

    def __init__(self, row: dict, weights: dict[int, int], docs: int, total: int) -> None:
        self.ids = row["ids"]
        lengths = row["lengths"].astype(np.int64)
        self.size = len(lengths)
        self.runs = -(-self.size // RUN)
        ends = np.append(0, np.cumsum(row["counts"].astype(np.int64)))
        m = 10 + (90 * lengths * docs) // max(total, 1)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.long: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for t, term in enumerate(row["terms"].tolist()):
            if term not in weights:
                continue
            place = row["places"][ends[t] : ends[t + 1]]
            times = row["times"][ends[t] : ends[t + 1]].astype(np.int64)
            score = weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[place]))
            if len(place) < LONG_SHARE * self.size:
                self.short[term] = place, score
            else:
                dense = np.zeros(self.runs * RUN, dtype=np.int64)
                dense[place] = score
                self.long[term] = dense, dense.reshape(-1, RUN).max(axis=1)

    def search(self, terms: list[int], best: Best) -> int:
        """Add what the block has of the best; how many runs were scored."""
        short = [self.short[t] for t in terms if t in self.short]
        long = [self.long[t] for t in terms if t in self.long]
        sums = np.zeros(self.runs * RUN, dtype=np.int64)
        for place, score in short:  # a place is once in a list
            sums[place] += score
        bound = sums.reshape(-1, RUN).max(axis=1)
        for _, most in long:
            bound = bound + most
        left = np.flatnonzero(bound >= best.least)
        scored = 0
        while len(left):
            runs, left = left[:STEP], left[STEP:]
            scored += len(runs)
            docs = (runs[:, None] * RUN + np.arange(RUN)).ravel()
            score = sums[docs]
            for dense, _ in long:
                score += dense[docs]
            fits = score >= best.least
            score, docs = score[fits], docs[fits]
            if len(score) > best.k:  # of equal scores all stay, as ids decide
                fits = score >= np.partition(score, -best.k)[-best.k]
                score, docs = score[fits], docs[fits]
            if len(score):
                best.add(score, [self.ids[d].as_py() for d in docs.tolist()])
                left = left[bound[left] >= best.least]
        return scored


def _search_blocks(index: DataFrame, weighted: pa.Table, docs: int, total: int, k: int) -> DataFrame:
    """(query, id, score): the k best of each task for the queries of ``weighted`` (query, term, weight)."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast(weighted)

    def run(batches):
        table = shared.value
        query, term, weight = (table.column(c).to_numpy() for c in ("query", "term", "weight"))
        weights = dict(zip(term.tolist(), weight.tolist(), strict=True))
        order = np.argsort(query, kind="stable")
        numbers, first = np.unique(query[order], return_index=True)
        terms = [t.tolist() for t in np.split(term[order], first[1:])] if len(numbers) else []
        best = [Best(k) for _ in numbers]
        id_type = pa.null()
        for batch in batches:
            id_type = batch.column("ids").type.value_type
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in batch.schema.names}
                row = {c: v if c == "ids" else v.to_numpy() for c, v in row.items()}
                block = Block(row, weights, docs, total)
                for own, found in zip(terms, best, strict=True):
                    block.search(own, found)
        rows = [(q, None if none else doc, -s) for q, b in zip(numbers.tolist(), best, strict=True) for s, none, doc in b.rows]
        if rows:
            q, doc, score = zip(*rows, strict=True)
            ids = pa.array(doc, id_type)
            yield pa.record_batch([pa.array(q, pa.int64()), ids, pa.array(score, pa.int64())], names=["query", "id", "score"])

    return index.mapInArrow(run, f"query long, id {kind}, score long")


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    block_terms: int = BLOCK_TERMS,
    max_terms: int = MAX_TERMS,
) -> DataFrame:
    """(query, query_id, rank, id, score): the k best documents above 0 for each row of ``queries``.

    With N documents that have a term, L terms in all, n of a document, df documents with a term and tf its times in one: the weight w of
    a term is floor(1000 * ln((2N + 2) / (2df + 1))), the norm m of a document 10 + 90nN div L, and its score the sum of
    w * (10**9 * tf div (1000 * tf + 8 * m)) over the different terms of the query.
    """
    names, terms = query_terms(queries, query_id, query_text)
    few = terms.select("term").distinct()
    rows = terms.count()
    vocabulary = None
    if rows <= max_terms or few.count() <= max_terms:
        vocabulary = np.sort(few.toArrow().column("term").to_numpy())
    index = build_index(docs, vocabulary, id_col, text_col)
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    having = F.size(F.filter("lengths", lambda x: x > 0))
    sizes = index.agg(F.coalesce(F.sum(having), F.lit(0)), F.coalesce(F.sum(length), F.lit(0))).first()
    n_docs, total = int(sizes[0]), int(sizes[1])
    counted = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    held = counted.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    blocks = max(1, -(-rows // block_terms))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")
    weighted = materialise(terms.join(held, "term").select("query", "term", weight.alias("weight"), block.alias("block")), "weighted")
    found = None
    for b in range(blocks):
        own = weighted.where(F.col("block") == b).select("query", "term", "weight").toArrow()
        part = _search_blocks(index, own, n_docs, total, k)
        found = part if found is None else found.union(part)
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    named = names.withColumnRenamed("id", "query_id")
    return ranked.join(named, "query").select("query", "query_id", "rank", "id", "score")
