"""Quality verdicts by a learned decision list, in DataFrame functions only.

Numbers of every whole text (words, symbols, repeats ...) are cut into bins at quantiles of the
labelled rows, and one aggregation counts good and bad rows in each cell of bins. From those counts
sequential covering grows a conjunction of thresholds by its gain, prunes it on counts that were
not used to grow it, and goes on with the rows not yet covered. The list is an ordered Spark
conditional expression. The cells that reach the driver are at most (edges + 1) ** features.

Null, empty and blank texts have no words. Labels that are null are left out; a document with several
labels counts as its lowest. Without labels the list is empty and only the base rules decide.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What separates words, what counts as a symbol.
SPACES = "[ \\t-\\r]+"
NOT_SPACE = "[^ \\t-\\r]"
SYMBOLS = "[#*$%&|<>]"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_marks"]
FEATURES = {
    "symbols_a_word": ("n_symbols", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "upper_case": ("n_upper", "word_chars"),
    "word_length": ("word_chars", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "marks_a_word": ("n_marks", "n_words"),
}
#: Quantiles of the bad and of the good rows at which a feature may be cut.
BAD_CUTS, GOOD_CUTS = [0.1, 0.5, 0.9], [0.01, 0.99, 1.0]
MIN_PRECISION, MIN_ROWS, MAX_CONDITIONS = 0.9, 8, 3


def count_text(docs: DataFrame, text_col: str = "text", out: str = "counts") -> DataFrame:
    """Add the struct ``out`` of the counts of each text; a column of that name is replaced.

    Words in a window of three that occurs twice are found on hashes of windows, sorted with their
    places, and only where a text has equal hashes at all. Write the result before filtering by the
    counts, as a filter is pushed below them and counts again.
    """
    names = [c for c in docs.columns if c.lower() != out.lower()]
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words = F.array_remove(F.split("t", SPACES, -1), "")
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(NOT_SPACE))
    step = kept.withColumns({"w": words, "l": lines})
    w = F.col("w")
    window = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    step = step.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.when(F.size(w) >= 4, window).alias("h"),
    )
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step = step.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed))
    size = F.size("s") - 1
    equal = F.zip_with(
        F.slice("s", F.lit(1), size), F.slice("s", F.lit(2), size), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    )
    step = step.withColumn("p", F.when(F.col("s").isNotNull(), F.array_distinct(F.flatten(F.array_compact(equal)))))
    inside = F.array_distinct(F.flatten(F.transform("p", lambda i: F.array(i, i + 1, i + 2))))
    step = step.withColumn("n_repeat_words", F.when(F.col("p").isNotNull(), F.size(inside)).otherwise(0).cast("long"))
    return step.select(*[F.col("row")[c].alias(c) for c in names], F.struct(*COUNTS, *MORE).alias(out))


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def feature(counts: Column, name: str) -> Column:
    over, under = FEATURES[name]
    return counts[over] / F.greatest(counts[under], F.lit(1))


@dataclass(frozen=True)
class Rule:
    """All of ``conditions``, each (feature, at least?, threshold), hold."""

    conditions: tuple[tuple[str, bool, float], ...]
    precision: float
    rows: int

    def column(self, counts: Column) -> Column:
        out = F.lit(True)
        for name, least, cut in self.conditions:
            value = feature(counts, name)
            out = out & (value >= cut if least else value < cut)
        return out

    def __str__(self) -> str:
        parts = [f"{name} {'>=' if least else '<'} {cut:.4g}" for name, least, cut in self.conditions]
        return f"reject if {' and '.join(parts)} ({self.precision:.3f} of {self.rows})"


def _cells(counted: DataFrame, labels: DataFrame, id_col: str, out: str, label: str):
    """Edges of each feature, and {(grow?, bins): [good, bad]}."""
    lowest = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("good"))
    seen = counted.where(~base_failed(F.col(out))).select(F.col(id_col).alias("id"), out).join(lowest, "id")
    seen = seen.select(
        (F.pmod(F.xxhash64("id"), F.lit(3)) != 0).alias("grow"),
        (F.col("good") > 0).alias("good"),
        *[feature(F.col(out), f).alias(f) for f in FEATURES],
    )
    cuts = seen.agg(
        *[F.percentile_approx(F.when(~F.col("good"), F.col(f)), BAD_CUTS).alias(f"b_{f}") for f in FEATURES],
        *[F.percentile_approx(F.when(F.col("good"), F.col(f)), GOOD_CUTS).alias(f"g_{f}") for f in FEATURES],
    ).first()
    edges = {}
    for f in FEATURES:
        own = set(cuts[f"b_{f}"] or []) | set(cuts[f"g_{f}"] or [])
        top = max(cuts[f"g_{f}"] or [0.0])
        # The largest good value itself should be on the good side.
        edges[f] = sorted(math.nextafter(x, math.inf) if x == top else x for x in own)
    bins = [sum((F.col(f) >= e).cast("int") for e in edges[f]) + F.lit(0) for f in FEATURES]
    binned = seen.select("grow", "good", *[b.alias(f) for b, f in zip(bins, FEATURES, strict=True)])
    table = binned.groupBy("grow", *FEATURES).agg(
        F.count(F.when(F.col("good"), 1)).alias("n_good"), F.count(F.when(~F.col("good"), 1)).alias("n_bad")
    )
    cells = {(r["grow"], tuple(r[f] for f in FEATURES)): [r["n_good"], r["n_bad"]] for r in table.toLocalIterator()}
    return edges, cells


def cover(edges: dict[str, list[float]], cells: dict) -> list[Rule]:
    """The decision list: grown on the cells marked to grow, pruned and judged on the others."""
    names = list(FEATURES)
    tests = [(i, least, k) for i, f in enumerate(names) for k in range(1, len(edges[f]) + 1) for least in (True, False)]

    def holds(bins, test):
        i, least, k = test
        return bins[i] >= k if least else bins[i] < k

    def totals(rows, grow=None):
        picked = [v for (g, _), v in rows.items() if grow is None or g == grow]
        return sum(v[0] for v in picked), sum(v[1] for v in picked)

    def restrict(rows, tests_):
        return {key: v for key, v in rows.items() if all(holds(key[1], t) for t in tests_)}

    def precision(rows, grow):
        good, bad = totals(rows, grow)
        return (bad + 1) / (good + bad + 2)

    left, rules = dict(cells), []
    while True:
        chosen, inside = [], {key: v for key, v in left.items() if key[0]}
        while len(chosen) < MAX_CONDITIONS:
            good, bad = totals(inside)
            if not bad or not good:
                break
            start, best = math.log2(bad / (good + bad)), (0.0, None, None)
            for test in tests:
                part = restrict(inside, [test])
                g, b = totals(part)
                gain = b * (math.log2(b / (g + b)) - start) if b else 0.0
                if gain > best[0] + 1e-9:
                    best = (gain, test, part)
            if best[1] is None:
                break
            chosen.append(best[1])
            inside = best[2]
        # A condition goes when the rows not used to grow are judged as well without it.
        while len(chosen) > 1:
            whole = precision(restrict(left, chosen), False)
            less = [(precision(restrict(left, chosen[:k] + chosen[k + 1 :]), False), k) for k in range(len(chosen))]
            value, k = max(less)
            if value < whole:
                break
            chosen.pop(k)
        covered = restrict(left, chosen) if chosen else {}
        good, bad = totals(covered)
        other = totals(covered, False)
        if good + bad < MIN_ROWS or precision(covered, None) < MIN_PRECISION or other[1] < MIN_PRECISION * sum(other):
            return rules
        conditions = tuple((names[i], least, edges[names[i]][k - 1]) for i, least, k in chosen)
        rules.append(Rule(conditions, bad / (good + bad), good + bad))
        left = {key: v for key, v in left.items() if key not in covered}


def learn(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", out: str = "counts", label: str = "quality") -> list[Rule]:
    """Rules from the rows of ``counted`` that have a label and pass the base rules."""
    return cover(*_cells(counted, labels, id_col, out, label))


def kept(rules: list[Rule], counts: Column) -> Column:
    """False where the base rules or the first rule that holds reject."""
    verdict = F.when(base_failed(counts), False)
    for rule in rules:
        verdict = verdict.when(rule.column(counts), False)
    return verdict.otherwise(True)
