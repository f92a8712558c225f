"""A log-bilinear language model with vectors per word, trained by noise-contrastive estimation.

Words are counted over all training texts. The most frequent ones, about the square root of the number of tokens and at most
``MAX_OWN``, are classes of their own, the end of a text is one, and all other words fall into classes by their last two
bytes. Every class has a vector for each of the two places before a token, and one as the token itself. By
frequency the classes form groups of about the square root of their number, which have vectors too.

Every training token is a draw, told from noise twice: its group from groups of the corpus, and it from other classes of its
group. Tasks train in numpy on the texts they read, from common weights, and the weights are averaged by tokens, in
``ROUNDS`` rounds over a share of the texts each. A small corpus is gone through several times. Scoring takes
batched matrix products: the log-probability of the group, normalised over all groups, and that of the class, normalised over
its group. A token's probability is that of its class times its share of the class, one more count given to each word
and to an unseen one.

Frequent words are broadcast with their counts, a table of bounded size; the others are joined. Null
texts are empty, and an empty text is one end. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.bytewords import LOWER, NOT_SPACE, U, Words, text_runs
from anamnesis.llm.common import materialise, send_code

#: Words that are classes of their own: at least, and at most whatever the corpus; classes by the last bytes of a word.
MIN_OWN, MAX_OWN, ENDING_CLASSES = 39, 1 << 16, 256
#: Words whose counts are broadcast at most.
HEAD_WORDS = 1 << 18
DIMENSIONS, ROUNDS, BATCH, NOISE, RATE = 24, 3, 32_768, 16, 0.1
#: Tokens that a corpus is trained on at least, the same ones again if it has fewer.
LEAST_DRAWS = 1_000_000
#: Tasks that train at once at most, tokens that each of them has in a round at least, and weights that are averaged by one task.
TRAINERS, TRAINED, FAN_IN = 256, 2_000_000, 8
#: How moves of weights are sent: steps are of the order of ``RATE``, so they keep three digits and stay far below the largest number.
MOVED = np.float16
#: Tokens whose probabilities are made at once, and those whose groups are.
SCORED, SCORED_GROUPS = 32_768, 2048


def _endings(words: Words) -> np.ndarray:
    last = words.data[words.end - 1].astype(np.int64)
    before = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.int64)
    return (last * 31 + before * 7) % ENDING_CLASSES


class _Tally:
    """Counts by 64-bit key over many batches; merged when much has gathered."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, extra: np.ndarray) -> None:
        key, lead, count = np.unique(key, return_index=True, return_counts=True)
        self.parts.append((key, extra[lead], count))
        self.size += len(key)
        if self.size > 4_000_000 and len(self.parts) > 8:
            self.merge()

    def merge(self):
        key, extra, count = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, extra, count = key[order], extra[order], count[order]
        fresh = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        merged = key[fresh], extra[fresh], np.add.reduceat(count, fresh) if len(fresh) else count
        self.parts, self.size = [merged], len(merged[0])
        return merged


def count_words(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, ending, n): hash of each word, its class by ending, its occurrences; a task counts its own first."""

    def run(batches):
        tally = _Tally()
        for batch in batches:
            for _, data, offsets in text_runs(batch.column(0)):
                words = Words(LOWER[data], offsets, NOT_SPACE)
                tally.add(words.hashes(), _endings(words))
            if tally.size > 6_000_000:
                yield _counted(tally)
                tally = _Tally()
        if tally.parts:
            yield _counted(tally)

    def _counted(tally):
        key, ending, count = tally.merge()
        return pa.record_batch(
            [pa.array(key.view(np.int64)), pa.array(ending.astype(np.int32)), pa.array(count.astype(np.int64))],
            names=["word", "ending", "n"],
        )

    found = texts.select(text_col).mapInArrow(run, "word long, ending int, n long")
    return found.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


class _Classes:
    """Class of every token of a run, ends included: own words by their place in ``own``, then the end, then endings."""

    def __init__(self, own: np.ndarray) -> None:
        self.order = np.argsort(own)
        self.own = own[self.order]
        self.end = len(own)

    def of(self, words: Words, hashes: np.ndarray):
        """(class of each token, start of each row) with an end after every row."""
        rows = len(words.offsets) - 1
        kind = self.end + 1 + _endings(words)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
            is_own = self.own[at] == hashes
            kind[is_own] = self.order[at[is_own]]
        token = np.full(len(words) + rows, self.end, dtype=np.int64)
        token[np.arange(len(words)) + words.row] = kind
        return token, words.first[:-1] + np.arange(rows)

    def context(self, token: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes two before and one before each token; ends stand before a text."""
        one = np.append(self.end, token[:-1])
        two = np.append([self.end, self.end], token[:-2])[: len(token)]
        two[start] = self.end
        return two, one


def _log_sum(x: np.ndarray) -> np.ndarray:
    """By row; ``x`` is used up."""
    top = x.max(axis=1)
    x -= top[:, None]
    return np.log(np.exp(x, out=x).sum(axis=1)) + top


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Groups:
    """Classes in groups by frequency: the group of each, its place there, and how often groups and classes occur."""

    group: np.ndarray
    place: np.ndarray
    size: int
    group_share: np.ndarray
    class_share: np.ndarray  # by group and place, within the group; 0 where there is no class

    @classmethod
    def of(cls, counts: np.ndarray) -> Groups:
        """``counts`` of all classes; each counts once more than it occurs."""
        size = max(1, int(np.ceil(np.sqrt(len(counts)))))
        rank = np.empty(len(counts), dtype=np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        group, place = rank // size, rank % size
        table = np.zeros((int(group.max()) + 1, size))
        table[group, place] = counts + 1.0
        total = table.sum(axis=1, keepdims=True)
        return cls(group, place, size, (total / total.sum())[:, 0], table / total)


def _by_group(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by group, and where in it each group begins and the last ends."""
    order = np.argsort(group.astype(np.int32), kind="stable")
    return order, np.append(np.flatnonzero(np.append(len(order) > 0, np.diff(group[order]) != 0)), len(order))


class Weights:
    """All vectors and biases in one array, so that they can be sent and averaged."""

    def __init__(self, classes: int, groups: Groups, flat: np.ndarray | None = None) -> None:
        g, s, d = len(groups.group_share), groups.size, DIMENSIONS
        shapes = [(2, classes, d), (g, d), (g,), (g, s, d), (g, s)]
        ends = np.cumsum([0, *(int(np.prod(x)) for x in shapes)])
        if flat is None:
            flat = np.random.default_rng(1).normal(0, 0.1, ends[-1]).astype(np.float32)
            flat[ends[2] : ends[3]] = np.log(groups.group_share)
            flat[ends[4] :] = np.log(np.maximum(groups.class_share, 1e-30)).ravel()
        self.flat = flat
        parts = [flat[a:b].reshape(x) for a, b, x in zip(ends[:-1], ends[1:], shapes, strict=True)]
        self.before, self.groups, self.group_bias, self.classes, self.class_bias = parts

    def log10(self, groups: Groups, two: np.ndarray, one: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Normalised log-probability of each token's class."""
        out = np.empty(len(token))
        empty = groups.class_share == 0
        for low in range(0, len(token), SCORED):
            own = slice(low, low + SCORED)
            order, cuts = _by_group(groups.group[token[own]])
            hidden = self.before[0, two[own][order]] + self.before[1, one[own][order]]
            group, place = groups.group[token[own][order]], groups.place[token[own][order]]
            found = np.empty(len(order), dtype=np.float32)
            for first in range(0, len(order), SCORED_GROUPS):
                part = slice(first, first + SCORED_GROUPS)
                logits = hidden[part] @ self.groups.T
                logits += self.group_bias
                of_group = logits[np.arange(len(logits)), group[part]]
                found[part] = of_group - _log_sum(logits)
            for first, end in zip(cuts[:-1], cuts[1:], strict=True):
                g = group[first]
                inner = hidden[first:end] @ self.classes[g].T
                inner += np.where(empty[g], np.float32(-1e30), self.class_bias[g])
                of_class = inner[np.arange(end - first), place[first:end]]
                found[first:end] += of_class - _log_sum(inner)
            # Back to the order of the tokens.
            back = np.empty(len(order))
            back[order] = found
            found = back
            out[own] = found
        return out / np.log(10)


class Trainer:
    """Noise-contrastive steps from given weights; steps shrink with what a weight has moved (Adagrad)."""

    def __init__(self, weights: Weights, classes: int, groups: Groups, seed: int) -> None:
        self.w, self.groups = Weights(classes, groups, weights.flat.copy()), groups
        self.slopes = Weights(classes, groups, np.full_like(weights.flat, 1e-2))
        self.rng = np.random.default_rng(seed)
        self.group_steep = np.cumsum(groups.group_share)
        self.class_steep = np.cumsum(groups.class_share, axis=1)
        self.group_noise = np.log(groups.group_share).astype(np.float32)
        self.class_noise = np.log(np.maximum(groups.class_share, 1e-30)).astype(np.float32)
        self.last = [int(np.flatnonzero(share)[-1]) for share in groups.class_share]
        self.draws = 0

    def _move(self, name: str, at, slope: np.ndarray) -> None:
        weight, seen = getattr(self.w, name), getattr(self.slopes, name)
        grown = seen[at] + slope * slope
        seen[at] = grown
        weight[at] -= RATE * slope / np.sqrt(grown)

    @staticmethod
    def _contrast(hidden, targets, bias, real, fake, log_noise):
        """Slopes of hidden, targets and bias for real rows of targets against rows that are drawn once for all."""
        offset = bias - np.float32(np.log(len(fake))) - log_noise
        n = np.arange(len(real))
        real_error = _sigmoid(np.einsum("ij,ij->i", hidden, targets[real]) + offset[real]) - 1
        fake_error = _sigmoid(hidden @ targets[fake].T + offset[fake])
        back = real_error[:, None] * targets[real] + fake_error @ targets[fake]
        hot = np.zeros((len(bias), len(real)), dtype=np.float32)
        hot[real, n] = real_error
        drawn = np.zeros((len(bias), len(fake)), dtype=np.float32)
        drawn[fake, np.arange(len(fake))] = 1
        slope = hot @ hidden + drawn @ (fake_error.T @ hidden)
        return back, slope, hot.sum(axis=1) + drawn @ fake_error.sum(axis=0)

    def step(self, two: np.ndarray, one: np.ndarray, token: np.ndarray) -> None:
        w, groups = self.w, self.groups
        self.draws += len(token)
        order, cuts = _by_group(groups.group[token])
        two, one, token = two[order], one[order], token[order]
        hidden = w.before[0, two] + w.before[1, one]
        group, place = groups.group[token], groups.place[token]
        fake = np.minimum(np.searchsorted(self.group_steep, self.rng.random(NOISE)), len(self.group_steep) - 1)
        back, slope, bias = self._contrast(hidden, w.groups, w.group_bias, group, fake, self.group_noise)
        self._move("groups", slice(None), slope)
        self._move("group_bias", slice(None), bias)
        for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            g = int(group[first])
            fake = np.minimum(np.searchsorted(self.class_steep[g], self.rng.random(NOISE)), self.last[g])
            own = self._contrast(hidden[first:end], w.classes[g], w.class_bias[g], place[first:end], fake, self.class_noise[g])
            back[first:end] += own[0]
            self._move("classes", g, own[1])
            self._move("class_bias", g, own[2])
        for k, context in enumerate((two, one)):
            order, cuts = _by_group(context)
            self._move("before", (k, context[order[cuts[:-1]]]), np.add.reduceat(back[order], cuts[:-1], axis=0))


def batches_of(streams: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(two, one, token) in batches of ``size``, the last one shorter."""
    held, count = [], 0
    for stream in streams:
        held.append(stream)
        count += len(stream[2])
        if count >= size:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            full = count - count % size
            for low in range(0, full, size):
                yield tuple(x[low : low + size] for x in whole)
            held, count = [tuple(x[full:] for x in whole)], count - full
    if count:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def train(texts: DataFrame, own: np.ndarray, groups: Groups, tokens: int, text_col: str = "text") -> Weights:
    """Weights learned from all tokens of the texts."""
    context = texts.sparkSession.sparkContext
    classes = len(groups.group)
    weights = Weights(classes, groups)
    again = max(1, -(-LEAST_DRAWS // max(tokens, 1)))

    def learn(now: Weights) -> Callable:
        shared = context.broadcast((now.flat, own, groups))

        def run(batches):
            flat, mine, grouped = shared.value
            kinds = _Classes(mine)
            trainer = None

            def streams():
                for batch in batches:
                    for _, data, offsets in text_runs(batch.column(0)):
                        words = Words(LOWER[data], offsets, NOT_SPACE)
                        token, start = kinds.of(words, words.hashes())
                        yield *kinds.context(token, start), token

            own_batches = batches_of(streams(), BATCH if again == 1 else BATCH // 16)
            if again > 1:  # fewer than LEAST_DRAWS tokens in all
                kept = list(own_batches)
                own_batches = (b for _ in range(again) for b in kept)
            for two, one, token in own_batches:
                if trainer is None:
                    trainer = Trainer(Weights(classes, grouped, flat), classes, grouped, len(token) + int(token[0]))
                trainer.step(two, one, token)
            if trainer is not None:
                yield _weighed(trainer.w.flat - flat, trainer.draws)

        return run

    def add(table: pa.Table) -> pa.Table:
        draws = np.array(table.column("draws").to_pylist(), dtype=np.float64)
        moved = np.zeros(len(weights.flat))
        for one, share in zip(table.column("flat"), draws / draws.sum(), strict=True):
            moved += np.frombuffer(one.as_buffer(), dtype=MOVED) * share
        return pa.Table.from_batches([_weighed(moved, int(draws.sum()))])

    for number in range(ROUNDS):
        share = F.pmod(F.xxhash64(text_col), F.lit(ROUNDS)) == number
        rows = texts.where(share).select(text_col)
        parts = max(1, min(rows.rdd.getNumPartitions(), TRAINERS, -(-tokens // (ROUNDS * TRAINED))))
        learned = rows.coalesce(parts).mapInArrow(learn(weights), "flat binary, draws long")
        while parts > FAN_IN:
            parts = -(-parts // FAN_IN)
            numbered = learned.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(parts)))
            learned = numbered.groupBy("group").applyInArrow(add, "flat binary, draws long")
        sums = learned.toArrow()
        if sums.num_rows:
            moved = np.frombuffer(add(sums).column("flat")[0].as_buffer(), dtype=MOVED)
            weights = Weights(classes, groups, weights.flat + moved.astype(np.float32))
    return weights


def _weighed(moved: np.ndarray, draws: int) -> pa.RecordBatch:
    """How far a task, or several on average, moved the weights that it was given, and over how many draws."""
    flat = moved.astype(MOVED).tobytes()
    return pa.record_batch([pa.array([flat], pa.binary()), pa.array([draws], pa.int64())], names=["flat", "draws"])


class Model:
    """What scoring needs, all of bounded size."""

    def __init__(self, counts: DataFrame, texts: DataFrame, text_col: str = "text") -> None:
        by_size = counts.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("words")).collect()
        least, words = 0, sum(r["words"] for r in by_size)
        for r in sorted(by_size, key=lambda r: r["size"]):
            if words <= HEAD_WORDS:
                break
            least, words = 2 ** (r["size"] + 1), words - r["words"]
        self.least = least  # words with at least so many occurrences are broadcast
        head = counts.where(F.col("n") >= least).toArrow()
        word, count = head.column("word").to_numpy().view(U), head.column("n").to_numpy()
        ending = head.column("ending").to_numpy()
        order = np.argsort(word)
        self.word, self.count, ending = word[order], count[order], ending[order]
        ends = texts.count()
        sums = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
        tokens = ends + sum(r["n"] for r in sums)
        top = np.lexsort((self.word, -self.count))[: min(max(MIN_OWN, int(tokens**0.5)), MAX_OWN)]
        self.own, end = self.word[top], len(top)
        n, kinds = np.zeros(end + 1 + ENDING_CLASSES), np.zeros(end + 1 + ENDING_CLASSES)
        for r in sums:
            n[end + 1 + r["ending"]], kinds[end + 1 + r["ending"]] = r["n"], r["words"]
        n[:end], kinds[:end] = self.count[top], 1
        np.subtract.at(n, end + 1 + ending[top], self.count[top])
        np.subtract.at(kinds, end + 1 + ending[top], 1)
        n[end], kinds[end] = ends, int(ends > 0)
        self.ends, self.tokens, self.types = ends, int(n.sum()), int(kinds.sum())
        self.groups = Groups.of(n)
        self.weights = train(texts, self.own, self.groups, self.tokens, text_col)
        self.class_size = np.log10(n + kinds + 1)

    def log10(self, two: np.ndarray, one: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of each token: the log-probability of its class, less that of all that share the class."""
        return self.weights.log10(self.groups, two, one, token) - self.class_size[token]


def score_texts(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for every row; ``training`` is the
    condition that picks the texts to learn from. Scores are log10 probabilities of a whole text."""
    spark = docs.sparkSession
    send_code(spark)
    texts = docs.where(training).select(text_col)
    counts = materialise(count_words(texts, text_col), "words")
    model = Model(counts, texts, text_col)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        classes, logs = _Classes(m.own), np.log10(m.count + 1.0)
        for batch in batches:
            tokens, known, sums, scores, rare = [], [], [], [], []
            for _, data, offsets in text_runs(batch.column(1)):
                words = Words(LOWER[data], offsets, NOT_SPACE)
                hashes, rows = words.hashes(), len(offsets) - 1
                token, start = classes.of(words, hashes)
                scores.append(np.add.reduceat(m.log10(*classes.context(token, start), token), start))
                tokens.append(np.diff(words.first) + 1)
                at = np.minimum(np.searchsorted(m.word, hashes), max(len(m.word) - 1, 0))
                frequent = m.word[at] == hashes if len(m.word) else np.zeros(len(hashes), dtype=bool)
                known.append(np.bincount(words.row[frequent], minlength=rows) + int(m.ends > 0))
                sums.append(np.bincount(words.row[frequent], logs[at[frequent]], minlength=rows) + np.log10(m.ends + 1.0))
                other = np.flatnonzero(~frequent)
                cut = np.searchsorted(other, words.first)
                rare += np.split(hashes[other].view(np.int64), cut[1:-1])
            join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
            sizes = np.append(0, np.cumsum([len(r) for r in rare])).astype(np.int32)
            flat = np.concatenate(rare) if rare else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, pa.int64()))
            columns = [batch.column(0), join(tokens, pa.int64()), join(known, pa.int64()), join(sums, pa.float64()), join(scores, pa.float64()), lists]
            yield pa.record_batch(columns, names=["key", "n_tokens", "known", "logs", "table", "rare"])

    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"key {kind}, n_tokens long, known long, logs double, table double, rare array<long>"
    scanned = docs.select(id_col, text_col).mapInArrow(run, ddl).withColumn("row", F.monotonically_increasing_id())
    scanned = materialise(scanned, "scanned")
    # Only words that are not broadcast meet their counts in a join, each once for a text.
    rare = scanned.where(F.size("rare") > 0).select("row", F.explode("rare").alias("word"))
    found = rare.join(counts.where(F.col("n") < model.least).select("word", "n"), "word")
    found = found.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"))
    all_logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return scanned.drop("rare").join(found, "row", "left").select(
        "key",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (all_logs - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + model.types + 1)))).alias("base_score"),
        (all_logs + F.col("table")).alias("score"),
    )
