"""Maximal repetitions of words (runs) in whole texts, by Lyndon words at every place.

1. Every run lies in a stretch whose words are all covered by windows of ``WINDOW`` words that occur twice in that
   stretch: a run of at least 2 * WINDOW words and two periods repeats each of its windows a period on. Texts are cut down
   to such stretches until nothing more falls away. What is cut can neither hold nor extend a run.
2. Suffix grouping, phase one, gives the length of the longest Lyndon word at every place of a stretch: places are grouped by
   their first word; the groups are taken from the highest down; every place of a group points to the nearest place
   to its left in a lower group; places pointed to are moved up, out of their group, by how often they are pointed to, and
   their context grows by so many times that of the group. When its turn comes, the context of a group is the Lyndon word.
   It is done under the order of the words and under its reverse, with the end of a stretch least in both.
3. By the theorem of runs the Lyndon root of every run is the longest Lyndon word at one of its places under one of the
   orders. Each such word of length q is extended by the longest common extensions to the right and left (prefix hashes,
   binary search for all places at once); it is a run if q words or more are gained. Every run is compared word by word
   afterwards; one whose hashes misled is extended word by word.

Words are what ASCII white space separates, as they are written. Null, empty and blank texts have no words and no runs;
repeated rows are results of their own. No row meets another one, so there is no shuffle, and memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.bytewords import BASE, INVERSE, NOT_SPACE, U, Words, mix, powers, text_runs, windows
from anamnesis.llm.common import send_code
from anamnesis.sources.workspace import spread

#: Words of a run at least; the windows that stretches are found by are half as long.
LEAST = 12
WINDOW = LEAST // 2


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place; ``ranks`` are 0 to k - 1, all in use."""
    n, k = len(ranks), max(ranks, default=-1) + 1
    group = list(ranks)
    members: list[list[int]] = [[] for _ in range(k)]
    for place, rank in enumerate(ranks):
        members[rank].append(place)
    context = [1] * k
    above, below = list(range(1, k + 1)), list(range(-1, k - 1))
    # For places taken: some place to the left, with only taken ones between.
    left = list(range(-1, n - 1))
    taken, lengths = bytearray(n), [0] * n
    top = k - 1
    while top >= 0:
        length = context[top]
        own = [place for place in members[top] if group[place] == top]
        for place in own:
            taken[place] = 1
            lengths[place] = length
        # Places ascend, so those that point to one place follow each other.
        moved: dict[tuple[int, int], list[int]] = {}
        target, times = -1, 0
        for place in own:
            p = place - 1
            while p >= 0 and taken[p]:
                q = left[p]
                if q >= 0 and taken[q]:
                    left[p] = left[q]
                p = q
            left[place] = p
            if p != target:
                if times and target >= 0:
                    moved.setdefault((times, group[target]), []).append(target)
                target, times = p, 0
            times += 1
        if times and target >= 0:
            moved.setdefault((times, group[target]), []).append(target)
        # The more often, the higher; each new group goes right above the one it leaves.
        for times, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            places = moved[times, old]
            new, over = len(context), above[old]
            for place in places:
                group[place] = new
            members.append(places)
            context.append(context[old] + times * length)
            above.append(over)
            below.append(old)
            above[old] = new
            if over < new:
                below[over] = new
        members[top] = own
        top = below[top]
    return lengths


def stretches(words: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, first of each stretch and the end): the words, of all ``part`` s, that may be in a run."""
    place = np.arange(len(words))
    label = part
    while len(place) >= LEAST:
        grams = windows(words[place], WINDOW)
        inside = np.flatnonzero(label[: len(grams)] == label[WINDOW - 1 :])
        keys = grams[inside] ^ mix(label[inside].astype(U) * BASE)
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        again = np.zeros(len(keys) + 1, dtype=bool)
        again[1:-1] = same
        twice = inside[order[again[1:] | again[:-1]]]
        cover = np.zeros(len(place) + 1, dtype=np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        cover = np.cumsum(cover[:-1]) > 0
        # Stretches part where words fall away, and where neighbouring texts meet.
        part_now = np.zeros(len(place), dtype=np.int64)
        part_now[1:] = (label[1:] != label[:-1]) | ~cover[1:] | ~cover[:-1]
        part_now = np.cumsum(part_now)[cover]
        long = np.bincount(part_now, minlength=1)[part_now] >= LEAST
        done = bool(cover.all() and long.all()) and len(np.unique(part_now)) == len(np.unique(label))
        place, label = place[cover][long], part_now[long]
        if done:
            break
    if len(place) < LEAST:
        return place[:0], np.zeros(1, dtype=np.int64)
    first = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    return place, np.append(first, len(place))


class _Prefixes:
    """Hashes of any range of a sequence, for common extensions."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(words * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        one = (self.sums[a + length] - self.sums[a]) * self.back[a]
        return one == (self.sums[b + length] - self.sums[b]) * self.back[b]

    def extension(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
        """How many words, at most ``limit``, agree from a and b on (step 1), or before a and b (step -1)."""
        low, high = np.zeros(len(a), dtype=np.int64), limit.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            shift = middle if step < 0 else 0
            fits = self.same(a - shift, b - shift, middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def _widen(words: np.ndarray, start: int, end: int, period: int, low: int, high: int) -> tuple[int, int]:
    """The run of ``period`` around a Lyndon root, word by word."""
    while start > low and words[start - 1] == words[start - 1 + period]:
        start -= 1
    while end < high and words[end] == words[end - period]:
        end += 1
    return start, end


def runs_of(words: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(start, end, period) of every run of the stretches that ``cuts`` bound, in order of start and period."""
    roots = []
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        ranks = np.unique(words[low:high], return_inverse=True)[1]
        for order in (ranks, ranks.max() - ranks):
            period = np.array(lyndon_lengths(order.tolist()), dtype=np.int64)
            start = np.arange(low, high)
            # Without q more words there is no run, whatever the extensions.
            roots.append(np.stack([start, period, np.full(high - low, low), np.full(high - low, high)])[:, 2 * period <= high - low])
    if not roots:
        return np.zeros((0, 3), dtype=np.int64)
    i, q, low, high = np.concatenate(roots, axis=1)
    hashes = _Prefixes(words)
    right = hashes.extension(i, i + q, high - i - q, 1)
    before = hashes.extension(i, i + q, np.minimum(i - low, i), -1)
    fits = (right + before >= q) & (right + before + q >= LEAST)
    found = np.stack([i - before, i + q + right, q, i, low, high], axis=1)[fits]
    distinct, of = np.unique(found[:, :3], axis=0, return_inverse=True)
    right = np.array([(words[s : e - p] == words[s + p : e]).all() for s, e, p in distinct.tolist()], dtype=bool)
    runs = {(s, p, e) for s, e, p in distinct[right].tolist()}
    for _, _, period, root, low_, high_ in found[~right[of.ravel()]].tolist():
        start, end = _widen(words, root, root + period, period, low_, high_)
        if end - start >= max(LEAST, 2 * period):
            runs.add((start, period, end))
    return np.array([(s, e, p) for s, p, e in sorted(runs)], dtype=np.int64).reshape(-1, 3)


def text_results(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list, list]]:
    """(first row, words, first run of each row and the end, runs, collapsed texts) of runs of whole texts."""
    for first, data, offsets in text_runs(texts):
        words = Words(data, offsets, NOT_SPACE)
        hashes = words.hashes()
        place, cuts = stretches(hashes, words.row)
        runs = runs_of(hashes[place], cuts)
        runs[:, 1] = place[runs[:, 1] - 1] + 1 if len(runs) else 0
        runs[:, 0] = place[runs[:, 0]] if len(runs) else 0
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 1], -1)
        gone = np.cumsum(gone) > 0
        counts = np.diff(words.first)
        in_row = np.searchsorted(runs[:, 0], words.first)
        raw, collapsed = data.tobytes(), []
        for row in range(len(offsets) - 1):
            own = raw[offsets[row] : offsets[row + 1]].split()
            if in_row[row] < in_row[row + 1]:
                keep = ~gone[words.first[row] : words.first[row + 1]]
                own = [own[i] for i in np.flatnonzero(keep).tolist()]
            collapsed.append(b" ".join(own))
        runs[:, :2] -= np.repeat(words.first[:-1], np.diff(in_row))[:, None]
        yield first, counts, in_row, runs, collapsed


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) for every row of ``docs``.

    ``runs`` is a list of (start, length, period) in words, by start and period: stretches with smallest period
    ``period`` of at least two periods and ``LEAST`` words that no neighbouring word extends. ``collapsed`` is the text
    without the words that are in a run behind its first period, joined by single spaces.
    """
    send_code(docs.sparkSession)
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for first, counts, in_row, runs, collapsed in text_results(batch.column(1)):
                fields = [pa.array(c.copy()) for c in (runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2])]
                lists = pa.ListArray.from_arrays(pa.array(in_row, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(shape.value_type)))
                columns = [batch.column(0).slice(first, len(counts)), pa.array(counts.astype(np.int64)), lists]
                yield pa.record_batch(
                    [*columns, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["key", "n_words", "runs", "collapsed"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return spread(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(run, out)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, wherever it is used."""
    return F.transform(F.array(value), use)[0]


def with_periods(text: Column, number: Column) -> Column:
    """The text, or for a tenth of all numbers its words with a stretch of them repeated up to the end.

    With g = number div 10 and n words, the words from a = g mod n on repeat the first 1 + (n - a) div (3 + g mod 8) of them.
    """
    g = F.floor(number / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")

        def of(shape: Column) -> Column:
            i_of = lambda i: F.when(i < shape["a"], i).otherwise(shape["a"] + (i - shape["a"]) % shape["p"])
            chosen = F.transform(F.sequence(F.lit(0).cast("long"), shape["n"] - 1), lambda i: F.get(words, i_of(i).cast("int")))
            return F.when(shape["n"] > 0, F.array_join(chosen, " ")).otherwise("")

        a = F.when(n > 0, g % n).otherwise(0)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return _bound(F.struct(n.alias("n"), a.alias("a"), p.alias("p")), of)

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when((number % 10 == 0) & text.isNotNull(), _bound(words, repeated)).otherwise(text)
