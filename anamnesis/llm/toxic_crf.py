"""Toxic spans by a linear-chain conditional random field over the words of a text.

Labels mark documents, so tokens are labelled first: in a bounded sample of labelled documents, a word of
a toxic one is marked if it, or its beginning, is found in many toxic documents and hardly in clean ones. The field has
two states, clean and toxic; words and their beginnings score the state, and a 2 x 2 table the step from
one word to the next. It is trained by gradient on the likelihood of the token labels. The largest marginal
of each sampled text then gives the log-odds at which toxic and clean texts part best, which marginals are
shifted by.

Scoring runs forward and backward over every whole text: stretches of words become 2 x 2 products that
are chained, so long and short texts share the same array steps. A document's score is the largest
shifted marginal of a word, its spans are the words whose shifted marginal is a half or more. Null, empty and wordless
texts score 0. Documents with several labels count as their highest; null labels are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.bytewords import ALNUM, LOWER, U, Words, text_runs
from anamnesis.llm.common import send_code

#: Labelled documents of each kind that are learned from at most, and bytes of one of them at most.
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 2000, 3000, 1 << 15
BUCKETS = 1 << 18
#: Lengths in bytes of the beginnings that are features; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6)
#: A feature marks words if it is in this share of toxic documents, and so many times rarer in clean ones.
MIN_SHARE, MIN_TIMES = 0.008, 30.0
WINDOW, EPOCHS, BATCH, RATE, DECAY = 48, 10, 512, 0.5, 1e-6
STRETCH = 128


def features(words: Words) -> np.ndarray:
    """Bucket of each feature of each word; a word shorter than a beginning has that of the whole word."""
    out = np.empty((len(BEGINNINGS), len(words)), dtype=np.int64)
    for k, size in enumerate(BEGINNINGS):
        end = np.minimum(words.end, words.start + size) if size else words.end
        out[k] = ((words.slices(words.start, end) ^ U(size * 0x9E37)) & U(BUCKETS - 1)).astype(np.int64)
    return out


class Field:
    """Weights: of each feature for the toxic state, and of each step; a text starts from the clean state."""

    def __init__(self) -> None:
        self.weight = np.zeros(BUCKETS)
        self.bias = -4.0
        self.step = np.array([[2.0, -2.0], [0.0, 0.0]])
        self.shift = 0.0  # log-odds of a marginal at which a text is as likely toxic as clean

    def emission(self, found: np.ndarray) -> np.ndarray:
        return self.weight[found].sum(0) + self.bias

    def calibrated(self, p: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(self.shift - _log_odds(p)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(p) - np.log1p(-p)


def best_cut(values: np.ndarray, toxic: np.ndarray) -> float:
    """The value between the clean and the toxic ones with the fewest on the wrong side, in the middle
    of the widest such gap."""
    order = np.argsort(values, kind="stable")
    values, toxic = values[order], toxic[order]
    wrong = np.append(0, np.cumsum(toxic)) + (np.sum(~toxic) - np.append(0, np.cumsum(~toxic)))
    edges = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    gap = np.concatenate([[0.0], np.diff(values), [0.0]])
    return float(edges[np.lexsort((-gap, wrong))[0]])


def _train_windows(field: Field, found: np.ndarray, labels: np.ndarray, real: np.ndarray, seed: int = 1) -> None:
    """Gradient steps on windows: found (features, windows, places), labels and real (windows, places)."""
    rng = np.random.default_rng(seed)
    slopes = [np.full(BUCKETS, 1e-2), np.full(1, 1e-2), np.full((2, 2), 1e-2)]
    for epoch in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(labels)), max(1, -(-len(labels) // BATCH))):
            f, y, on = found[:, part], labels[part], real[part]
            n, size = y.shape
            e = np.stack([np.zeros((n, size)), field.emission(f)], axis=2)
            alpha, beta = np.empty((n, size, 2)), np.zeros((n, size, 2))
            alpha[:, 0] = field.step[0] + e[:, 0]
            for t in range(1, size):
                nxt = np.logaddexp(alpha[:, t - 1, :1] + field.step[0], alpha[:, t - 1, 1:] + field.step[1]) + e[:, t]
                alpha[:, t] = np.where(on[:, t, None], nxt, alpha[:, t - 1])
            for t in range(size - 2, -1, -1):
                ahead = beta[:, t + 1] + e[:, t + 1]
                nxt = np.logaddexp(field.step[:, 0] + ahead[:, :1], field.step[:, 1] + ahead[:, 1:])
                beta[:, t] = np.where(on[:, t + 1, None], nxt, beta[:, t + 1])
            total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None])
            error = np.where(on, p - y, 0.0)
            pairs = np.exp(
                alpha[:, :-1, :, None] + field.step + (e + beta)[:, 1:, None, :] - total[:, None, None, None]
            )
            pairs *= on[:, 1:, None, None]
            step = pairs.sum((0, 1))
            np.subtract.at(step, (y[:, :-1][on[:, 1:]], y[:, 1:][on[:, 1:]]), 1.0)
            step[0] += np.array([(1 - p[:, 0]).sum(), p[:, 0].sum()]) - np.bincount(y[:, 0], minlength=2)
            flat = np.bincount(f.reshape(-1), np.broadcast_to(error, f.shape).reshape(-1), minlength=BUCKETS)
            grads = [flat / n + DECAY * field.weight, np.array([error.sum() / n]), step / n]
            rate = RATE * (1 - epoch / EPOCHS)
            moves = []
            for s, g in zip(slopes, grads, strict=True):
                s += g * g
                moves.append(rate * g / np.sqrt(s))
            field.weight -= moves[0]
            field.bias -= float(moves[1][0])
            field.step -= moves[2]


def label_tokens(first: np.ndarray, found: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for words of toxic texts with a feature that marks them; each different text counts once.

    ``first`` is the first word of each text and the end of the last.
    """
    rows = len(toxic)
    in_toxic, in_clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in range(rows):
        own = np.unique(found[:, first[row] : first[row + 1]])
        (in_toxic if toxic[row] else in_clean)[own] += 1
    n_toxic, n_clean = max(int(toxic.sum()), 1), max(int(rows - toxic.sum()), 1)
    often = in_toxic >= max(2.0, MIN_SHARE * n_toxic)
    marks = often & (in_toxic / n_toxic >= MIN_TIMES * (in_clean / n_clean))
    return (marks[found].any(0) & np.repeat(toxic, np.diff(first))).astype(np.int64)


def fit(texts: list[str], toxic: list[bool]) -> Field:
    """A field from labelled texts, each different text once."""
    field = Field()
    once = {text: bool(mark) for text, mark in sorted(zip(texts, toxic, strict=True)) if text}
    if not any(once.values()) or all(once.values()):
        return field
    parts, sizes = [], [np.zeros(1, dtype=np.int64)]
    for _, data, offsets in text_runs(pa.array(list(once))):
        words = Words(LOWER[data], offsets, ALNUM)
        parts.append(features(words).astype(np.int32))
        sizes.append(np.diff(words.first))
    found, first = np.concatenate(parts, axis=1), np.cumsum(np.concatenate(sizes))
    del parts
    marks = np.array(list(once.values()))
    if not first[-1]:
        return field
    labels = label_tokens(first, found, marks)
    # Windows of consecutive words of one text; toxic ones, and clean ones in number alike.
    per = -(-np.diff(first) // WINDOW)
    text = np.repeat(np.arange(len(per)), per)
    begin = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * WINDOW
    size = np.minimum(WINDOW, first[text + 1] - begin)
    hot = np.add.reduceat(labels, begin) > 0
    rng = np.random.default_rng(0)
    cold = np.flatnonzero(~hot)
    picked = np.concatenate([np.flatnonzero(hot), rng.permutation(cold)[: max(2 * int(hot.sum()), 4000)]])
    at = begin[picked, None] + np.arange(WINDOW)
    real = np.arange(WINDOW) < size[picked, None]
    at = np.minimum(at, first[-1] - 1)
    if hot.any():
        _train_windows(field, found[:, at], np.where(real, labels[at], 0), real)
        held = np.flatnonzero(np.diff(first))
        p = np.empty(len(held))
        for part in range(0, len(held), 64):  # whole texts, a few at a time
            rows = held[part : part + 64]
            a, b = first[rows[0]], first[rows[-1] + 1]
            own = marginals(field, field.emission(found[:, a:b]), first[rows[0] : rows[-1] + 2] - a)
            p[part : part + 64] = np.maximum.reduceat(own, first[rows] - a)
        field.shift = best_cut(_log_odds(p), marks[held])
    return field


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Field:
    """A field from at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean labelled documents, picked by a hash
    of their id."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("toxic"))
    order = [F.xxhash64("id"), F.col("id")]
    toxic = known.where("toxic > 0").orderBy(*order).limit(MAX_TOXIC)
    clean = known.where("toxic <= 0").orderBy(*order).limit(MAX_CLEAN)
    chosen = F.broadcast(toxic.union(clean))
    rows = docs.where(F.octet_length(text_col) <= MAX_BYTES).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = rows.join(chosen, "id").dropDuplicates(["id", "text"]).select("text", "toxic").toArrow()
    return fit(picked.column("text").to_pylist(), [t > 0 for t in picked.column("toxic").to_pylist()])


def marginals(field: Field, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability that each word is toxic, given ``first`` word of each text and the end of the last.

    Texts are cut into stretches of ``STRETCH`` words, all gone through in step. Within a stretch the
    products of the steps' 2 x 2 matrices are kept; over a text's stretches they are chained.
    """
    n = len(emission)
    out = np.zeros(n)
    if not n:
        return out
    sizes = np.diff(first)
    per = -(-sizes // STRETCH)
    text = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = first[:-1][text] + number * STRETCH
    length = np.minimum(STRETCH, first[1:][text] - begin)
    count, width = len(text), int(length.max())
    at = np.minimum(begin[:, None] + np.arange(width), n - 1)
    real = np.arange(width) < length[:, None]
    score = np.clip(emission[at], -40, 40)
    # Weight of each state of a word; padding changes nothing.
    e = np.ones((width, count, 2))
    e[:, :, 1] = np.exp(np.minimum(score, 0)).T
    e[:, :, 0] = np.exp(-np.maximum(score, 0)).T
    step = np.exp(field.step - field.step.max())
    one = np.eye(2)
    ahead = np.empty((width, count, 2, 2))  # product of the steps up to and with each word
    now = np.broadcast_to(one, (count, 2, 2))
    for t in range(width):
        moved = now @ step
        moved = moved * e[t][:, None, :]
        moved = moved / moved.max((1, 2), keepdims=True)
        now = np.where(real[:, t, None, None], moved, now)
        ahead[t] = now
    whole = now
    back = np.empty((width, count, 2, 2))  # product of the steps after each word
    now = np.broadcast_to(one, (count, 2, 2))
    for t in range(width - 1, -1, -1):
        back[t] = now
        moved = step @ (e[t][:, :, None] * now)
        moved = moved / moved.max((1, 2), keepdims=True)
        now = np.where(real[:, t, None, None], moved, now)
    # Chain the stretches of each text.
    enter, leave = np.empty((count, 2)), np.ones((count, 2))
    lead = np.cumsum(per) - per
    texts = np.flatnonzero(per)
    state = np.broadcast_to(np.array([1.0, 0.0]), (len(sizes), 2)).copy()
    for k in range(int(per.max())):
        texts = texts[per[texts] > k]
        own = lead[texts] + k
        enter[own] = state[texts]
        moved = np.einsum("ni,nij->nj", state[texts], whole[own])
        state[texts] = moved / moved.max(1, keepdims=True)
    state = np.ones((len(sizes), 2))
    left = per.copy()
    for _ in range(int(per.max())):
        texts = np.flatnonzero(left > 0)
        own = lead[texts] + left[texts] - 1
        leave[own] = state[texts]
        moved = np.einsum("nij,nj->ni", whole[own], state[texts])
        state[texts] = moved / moved.max(1, keepdims=True)
        left[texts] -= 1
    alpha = np.einsum("ni,tnij->tnj", enter, ahead)
    beta = np.einsum("tnij,nj->tni", back, leave)
    p = alpha * beta
    p = p[:, :, 1] / np.maximum(p.sum(2), 1e-300)
    out[at.T[real.T]] = np.clip(p[real.T], 0.0, 1.0)
    return out


def tag_toxic(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """(key, score, spans) for every row: the largest marginal, and (start, end, p) of runs of words with
    ``cut`` or more, in code points, end exclusive."""
    spark = docs.sparkSession
    send_code(spark)
    shared = spark.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            scores, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for first, data, offsets in text_runs(batch.column(1), 1 << 20):
                words = Words(LOWER[data], offsets, ALNUM)
                if not len(words):
                    continue
                p = marginals(shared.value, shared.value.emission(features(words)), words.first)
                p = shared.value.calibrated(p)
                held = np.flatnonzero(np.diff(words.first))
                scores[first + held] = np.maximum.reduceat(p, words.first[held])
                hit = p >= cut
                if not hit.any():
                    continue
                points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                fresh = hit & ~(np.append(False, hit[:-1]) & (np.append(-1, words.row[:-1]) == words.row))
                for a in np.flatnonzero(fresh).tolist():
                    b, row = a, int(words.row[a])
                    while b + 1 < len(p) and hit[b + 1] and words.row[b + 1] == row:
                        b += 1
                    zero = int(points[offsets[row]])
                    spans[first + row].append(
                        {"start": int(points[words.start[a]]) - zero, "end": int(points[words.end[b]]) - zero, "p": float(p[a : b + 1].max())}
                    )
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.record_batch([batch.column(0), pa.array(scores), pa.array(spans, kind)], names=["key", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"key {kind}, score double, spans array<struct<start:int,end:int,p:double>>")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold
