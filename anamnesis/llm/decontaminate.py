"""Passages of benchmark items in documents: a broadcast set of window hashes, verified word by word.

An item gives a window for each ``n`` consecutive words, or one window of all its words when it
has fewer. The hashes of all windows are broadcast in blocks of a fixed size; a benchmark larger than
one block is gone through block by block. Every text is scanned whole, each window hash that the set
holds is compared with the item's words, and the words inside an occurrence are hit.

Null, empty and wordless texts and items have no words, hence no windows and no hits. Each row of
a repeated document is judged by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.bytewords import ALNUM, LOWER, U, Words, inside_rows, text_runs, windows
from anamnesis.llm.common import materialise, send_code

#: Bytes of benchmark text whose windows are broadcast at once.
BLOCK_BYTES = 4 << 20
SPAN = "array<struct<start:int,end:int>>"


class WindowSet:
    """Windows of items: for each length the sorted hashes, and for each hash its windows' words."""

    def __init__(self, items: pa.Table, n: int) -> None:
        ids = items.column(0).cast(pa.string()).to_pylist()
        self.places: dict[int, dict[int, list[tuple[str, tuple[bytes, ...]]]]] = {}
        for first, data, offsets in text_runs(items.column(1)):
            words = Words(LOWER[data], offsets, ALNUM)
            hashes = words.hashes()
            for row in range(len(offsets) - 1):
                a, b = words.first[row], words.first[row + 1]
                if a == b:
                    continue
                size = min(n, b - a)
                own = [words.text(i) for i in range(a, b)]
                for at, h in enumerate(windows(hashes[a:b], size).tolist()):
                    found = self.places.setdefault(int(size), {}).setdefault(h, [])
                    found.append((ids[first + row], tuple(own[at : at + size])))
        self.sorted = {size: np.sort(np.array(list(found), dtype=U)) for size, found in self.places.items()}
        self.sieve = {}
        for size, hashes in self.sorted.items():
            self.sieve[size] = np.zeros(1 << 20, dtype=bool)
            self.sieve[size][hashes >> U(44)] = True

    def occurrences(self, words: Words):
        """(row, first word, words, items) of each occurrence."""
        hashes = words.hashes()
        for size, known in self.sorted.items():
            found = windows(hashes, size)
            at = np.flatnonzero(self.sieve[size][found >> U(44)])
            place = np.minimum(np.searchsorted(known, found[at]), len(known) - 1)
            at = at[(known[place] == found[at])]
            at = at[inside_rows(words, size)[at]]
            for k, h in zip(at.tolist(), found[at].tolist(), strict=True):
                text = tuple(words.text(i) for i in range(k, k + size))
                items = {item for item, own in self.places[size][h] if own == text}
                if items:
                    yield int(words.row[k]), k, size, items


def _scan(rows: DataFrame, known: WindowSet, key: str, text: str, hits_only: bool) -> DataFrame:
    """(key, n_words, n_hit, items, spans): spans are UTF-8 byte ranges of runs of hit words."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
            items, spans = [[] for _ in range(n)], [[] for _ in range(n)]
            for first, data, offsets in text_runs(batch.column(1)):
                words = Words(LOWER[data], offsets, ALNUM)
                n_words[first : first + len(offsets) - 1] = np.diff(words.first)
                step = np.zeros(len(words) + 1, dtype=np.int32)
                met: dict[int, set[str]] = {}
                for row, at, size, found in shared.value.occurrences(words):
                    step[at] += 1
                    step[at + size] -= 1
                    met.setdefault(row, set()).update(found)
                if not met:
                    continue
                hit = np.cumsum(step[:-1]) > 0
                counts = np.bincount(words.row[hit], minlength=len(offsets) - 1)
                n_hit[first : first + len(offsets) - 1] = counts
                for row, found in met.items():
                    a, b = words.first[row], words.first[row + 1]
                    edge = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                    begin, stop = np.flatnonzero(edge == 1) + a, np.flatnonzero(edge == -1) + a - 1
                    low = words.start[begin] - offsets[row]
                    high = words.end[stop] - offsets[row]
                    items[first + row] = sorted(found)
                    spans[first + row] = [{"start": x, "end": y} for x, y in zip(low.tolist(), high.tolist(), strict=True)]
            columns = [
                batch.column(0),
                pa.array(n_words),
                pa.array(n_hit),
                pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ]
            out = pa.record_batch(columns, names=["key", "n_words", "n_hit", "items", "spans"])
            yield out.filter(pa.array(n_hit > 0)) if hits_only else out

    kind = rows.schema[key].dataType.simpleString()
    ddl = f"key {kind}, n_words long, n_hit long, items array<string>, spans {SPAN}"
    return rows.select(key, text).mapInArrow(run, ddl)


def _merge_spans(spans: Column) -> Column:
    """Sorted ranges, those that touch or overlap joined."""
    joined = F.aggregate(
        F.array_sort(spans),
        F.array().cast(SPAN),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return joined


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(key, n_words, n_hit, items, spans) for every row of ``docs``; key is its ``id_col``.

    ``n_hit`` counts words inside an occurrence of any window, ``items`` names the items with one and
    ``spans`` has the UTF-8 byte ranges of hit words, one range for each block's run of them.
    """
    spark = docs.sparkSession
    send_code(spark)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    blocks = _blocks(items, block_bytes)
    if blocks == 1:
        return _scan(docs, WindowSet(items.toArrow(), n), id_col, text_col, hits_only=False)

    # Each block finds its hits on rows numbered once; the words hit by any block are joined after.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return _by_blocks(materialise(rows, "rows"), items, n, blocks).drop("row")


def _by_blocks(rows: DataFrame, items: DataFrame, n: int, blocks: int) -> DataFrame:
    """(row, key, n_words, n_hit, items, spans) for every row of the written ``rows`` (row, key, text)."""
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    found = []
    for k in range(blocks):
        known = WindowSet(items.where(block == k).toArrow(), n)
        found.append(materialise(_scan(rows, known, "row", "text", hits_only=True), "hits"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    merged = hits.groupBy("key").agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans")
    )
    merged = merged.select(F.col("key").alias("row"), "items", _merge_spans(F.col("spans")).alias("spans"))
    joined = rows.join(merged, "row", "left")
    names = ["row", "key", "n_words", "n_hit", "items", "spans"]

    def count(batches):
        for batch in batches:
            n_words, n_hit = [], []
            spans = batch.column(4).to_pylist()
            for first, data, offsets in text_runs(batch.column(2)):
                words = Words(LOWER[data], offsets, ALNUM)
                for row in range(len(offsets) - 1):
                    a, b = words.first[row], words.first[row + 1]
                    n_words.append(int(b - a))
                    start, own = words.start[a:b] - offsets[row], spans[first + row] or []
                    n_hit.append(sum(int(np.count_nonzero((start >= s["start"]) & (start < s["end"]))) for s in own))
            counts = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())]
            yield pa.record_batch([batch.column(0), batch.column(1), *counts, batch.column(3), batch.column(4)], names=names)

    kind = rows.schema["key"].dataType.simpleString()
    empty = F.array()
    return joined.select(
        "row", "key", "text", F.coalesce("items", empty.cast("array<string>")).alias("items"), F.coalesce("spans", empty.cast(SPAN)).alias("spans")
    ).mapInArrow(count, f"row long, key {kind}, n_words long, n_hit long, items array<string>, spans {SPAN}")


def contaminated(n_hit: Column, n_words: Column, share: int = 5) -> Column:
    """Whether hit words are at least ``share`` percent of a document's words."""
    return (n_hit > 0) & (100 * n_hit >= share * n_words)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 13,
    share: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they are.

    One block of windows filters the rows where they are read. With more, the rows are numbered once and written, and
    the numbers of contaminated rows are left out by a join; either way each row is judged by itself.
    """
    spark = docs.sparkSession
    send_code(spark)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    blocks = _blocks(items, block_bytes)
    if blocks > 1:
        number = "_row"
        while number in docs.columns:
            number += "_"
        numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
        rows = numbered.select(F.col(number).alias("row"), F.lit(None).cast("string").alias("key"), F.col(text_col).alias("text"))
        found = _by_blocks(rows, items, n, blocks)
        bad = found.where(contaminated(F.col("n_hit"), F.col("n_words"), share)).select(F.col("row").alias(number))
        return numbered.join(bad, number, "left_anti").select(*docs.columns)
    shared = spark.sparkContext.broadcast(WindowSet(items.toArrow(), n))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for first, data, offsets in text_runs(batch.column(at)):
                words = Words(LOWER[data], offsets, ALNUM)
                step = np.zeros(len(words) + 1, dtype=np.int32)
                for _, k, size, _ in shared.value.occurrences(words):
                    step[k] += 1
                    step[k + size] -= 1
                hits = np.bincount(words.row[np.cumsum(step[:-1]) > 0], minlength=len(offsets) - 1)
                clean[first : first + len(hits)] = (hits == 0) | (100 * hits < share * np.diff(words.first))
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def _blocks(items: DataFrame, block_bytes: int) -> int:
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    return -(-total // block_bytes) or 1


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the byte ranges ``spans``."""
    raw = text.cast("binary")
    cuts = F.concat(
        F.transform(spans, lambda s, i: F.substring(raw, F.when(i == 0, 1).otherwise(spans[i - 1]["end"] + 1), s["start"] - F.when(i == 0, 0).otherwise(spans[i - 1]["end"]))),
        F.array(F.substring(raw, F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)) + 1, F.octet_length(text))),
    )
    return F.concat_ws("", F.transform(cuts, lambda c: c.cast("string")))
