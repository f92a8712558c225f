"""Representation, retrieval, head and prediction queries."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import functions as F

from anamnesis.functions import arrays as A
from anamnesis.functions.vectors import text_of
from anamnesis.operators import heads as H
from anamnesis.operators import predict as P
from anamnesis.operators import retrieval as R
from anamnesis.operators import timed as M
from anamnesis.operators import training as L
from anamnesis.operators import vectors as E
from anamnesis.operators.skew import running
from anamnesis.plans import fixtures as X
from anamnesis.plans import tokens as TP
from anamnesis.plans.cohort import histories
from anamnesis.registry import register_operator as query
from anamnesis.sources.workspace import materialise

K, CUTOFF = 5, 0.5


def round6(name: str):
    return F.round(name, 6).alias(name)


def text_sql(vector: str) -> str:
    return (
        f"array_to_string(list_transform({vector}, lambda x: "
        "CAST(CAST(round(x, 6) AS DECIMAL(38, 6)) AS VARCHAR)), ',')"
    )


# --- scoring and retrieval ---------------------------------------------------------------

QUERY_SQL = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)"

SCORED_SQL = X.PADDED_SQL + ",\n" + QUERY_SQL + """,
real AS (SELECT * FROM padded WHERE list_bool_or(list_transform(repr, lambda x: x <> 0))),
scored AS (SELECT r.*, (list_cosine_similarity(r.repr, q.v) + 1) / 2 AS score FROM real r, q)"""

TOP_SQL = SCORED_SQL + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, event_idx) AS rank
  FROM scored WHERE score > 0.5),
top AS (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY time_min, event_idx) AS time_rank,
         (score + 1e-10) / sum(score + 1e-10) OVER (PARTITION BY sample_id) AS weight
  FROM ranked WHERE rank <= 5)"""


def scored(spark, sf_dir):
    real = R.mask_zero_vectors(X.padded_vectors(spark, sf_dir))
    return R.cosine_scores(real, X.first_vector(spark, sf_dir))


def top(spark, sf_dir):
    return R.retrieve_topk(scored(spark, sf_dir), "sample_id", K, CUTOFF)


@query("mask_zero_vectors", "WITH " + SCORED_SQL + " SELECT event_idx, sample_id FROM real")
def mask_zero_vectors(spark, sf_dir):
    return R.mask_zero_vectors(X.padded_vectors(spark, sf_dir)).select("event_idx", "sample_id")


@query("cosine_score", "WITH " + SCORED_SQL + " SELECT event_idx, round(score, 6) AS score FROM scored")
def cosine_score(spark, sf_dir):
    return scored(spark, sf_dir).select("event_idx", round6("score"))


@query(
    "reject_below",
    "WITH " + SCORED_SQL + " SELECT event_idx, round(score, 6) AS score FROM scored WHERE score > 0.5",
)
def reject_below(spark, sf_dir):
    return R.reject_below(scored(spark, sf_dir), CUTOFF).select("event_idx", round6("score"))


@query("topk_rank", "WITH " + TOP_SQL + " SELECT sample_id, event_idx, rank FROM ranked WHERE rank <= 5")
def topk_rank(spark, sf_dir):
    kept = R.reject_below(scored(spark, sf_dir), CUTOFF)
    best = R.topk_rank(kept, "sample_id", K)
    return best.select("sample_id", "event_idx", F.col("rank").cast("bigint").alias("rank"))


@query(
    "retrieve_topk",
    "WITH " + TOP_SQL + " SELECT sample_id, event_idx, time_min, rank, time_rank, round(score, 6) AS score FROM top",
)
def retrieve_topk(spark, sf_dir):
    return top(spark, sf_dir).select(
        "sample_id",
        "event_idx",
        "time_min",
        F.col("rank").cast("bigint").alias("rank"),
        F.col("time_rank").cast("bigint").alias("time_rank"),
        round6("score"),
    )


@query(
    "gather_topk",
    "WITH " + TOP_SQL + f" SELECT sample_id, rank, time_min, {text_sql('repr')} AS repr FROM top",
)
def gather_topk(spark, sf_dir):
    return top(spark, sf_dir).select(
        "sample_id", F.col("rank").cast("bigint").alias("rank"), "time_min", text_of(F.col("repr")).alias("repr")
    )


@query(
    "sort_by_time",
    "WITH " + TOP_SQL + """
SELECT sample_id, string_agg(CAST(event_idx AS VARCHAR), ',' ORDER BY time_min, event_idx) AS events,
       string_agg(CAST(CAST(round(score, 6) AS DECIMAL(38, 6)) AS VARCHAR), ',' ORDER BY time_min, event_idx) AS scores
FROM top GROUP BY sample_id""",
)
def sort_by_time(spark, sf_dir):
    lists = R.sort_by_time(top(spark, sf_dir), "sample_id", ["score"])
    return lists.select(
        "sample_id",
        F.array_join(F.col("events.event_idx").cast("array<string>"), ",").alias("events"),
        text_of(F.col("events.score")).alias("scores"),
    )


@query(
    "retrieval_weights",
    "WITH " + TOP_SQL + " SELECT sample_id, event_idx, round(weight, 6) AS weight FROM top",
)
def retrieval_weights(spark, sf_dir):
    weighed = R.retrieval_weights(top(spark, sf_dir), "sample_id")
    return weighed.select("sample_id", "event_idx", round6("weight"))


@query(
    "weighted_prediction",
    "WITH " + TOP_SQL + """
SELECT sample_id, round(sum(weight * (1 / (1 + exp(-repr[1])))), 6) AS pred FROM top GROUP BY sample_id""",
)
def weighted_prediction(spark, sf_dir):
    weighed = R.retrieval_weights(top(spark, sf_dir), "sample_id")
    each = weighed.withColumn("pred", 1 / (1 + F.exp(-F.col("repr")[0].cast("double"))))
    return R.weighted_prediction(each, "sample_id").select("sample_id", round6("pred"))


def mean_sql(source: str, keys: str, vector: str = "repr") -> str:
    """Element-wise mean as (keys, pooled)."""
    return f"""(
  SELECT {keys}, list(m ORDER BY i) AS pooled FROM (
    SELECT {keys}, i, avg({vector}[i]) AS m
    FROM (SELECT *, unnest(range(1, len({vector}) + 1)) AS i FROM {source}) GROUP BY {keys}, i)
  GROUP BY {keys})"""


CONSTANT = [((i * 37) % 64 - 32) / 64.0 for i in range(X.DIM)]
CONSTANT_SQL = "list_transform(range(64), lambda i: (i * 37 % 64 - 32) / 64.0::DOUBLE)"


@query(
    "mean_pool",
    "WITH " + SCORED_SQL + f" SELECT sample_id, {text_sql('pooled')} AS pooled FROM " + mean_sql("real", "sample_id"),
)
def mean_pool(spark, sf_dir):
    pooled = E.mean_pool(X.padded_vectors(spark, sf_dir), ["sample_id"], "repr")
    return pooled.select("sample_id", text_of(F.col("pooled")).alias("pooled"))


@query(
    "first_pool",
    "WITH " + X.VECTORS_SQL + f"""
SELECT sample_id, {text_sql('arg_min(repr, event_idx)')} AS pooled FROM vectors GROUP BY sample_id""",
)
def first_pool(spark, sf_dir):
    pooled = E.first_pool(X.vectors(spark, sf_dir), ["sample_id"], "repr", "event_idx")
    return pooled.select("sample_id", text_of(F.col("pooled")).alias("pooled"))


FALLBACK_SQL = TOP_SQL + ",\npooled AS " + mean_sql("top", "sample_id") + f""",
filled AS (
  SELECT s.sample_id, coalesce(p.pooled, {CONSTANT_SQL}) AS pooled
  FROM (SELECT DISTINCT sample_id FROM vectors) s LEFT JOIN pooled p ON s.sample_id = p.sample_id)"""


def filled(spark, sf_dir):
    samples = X.vectors(spark, sf_dir).select("sample_id").distinct()
    pooled = E.mean_pool(top(spark, sf_dir), ["sample_id"], "repr")
    return R.empty_retrieval_fallback(samples, pooled, "sample_id", CONSTANT)


@query(
    "empty_retrieval_fallback",
    "WITH " + FALLBACK_SQL + f" SELECT sample_id, {text_sql('pooled')} AS pooled FROM filled",
)
def empty_retrieval_fallback(spark, sf_dir):
    return filled(spark, sf_dir).select("sample_id", text_of(F.col("pooled")).alias("pooled"))


# --- small networks with weights given by a formula --------------------------------------


def formula_weights(rows: int, columns: int, phase: int) -> np.ndarray:
    i, j = np.meshgrid(np.arange(rows), np.arange(columns), indexing="ij")
    return np.sin(i * 7.0 + j * 13.0 + phase) / columns**0.5


def weights_sql(rows: int, columns: int, phase: int) -> str:
    return (
        f"list_transform(range({rows}), lambda i: list_transform(range({columns}), "
        f"lambda j: sin(i * 7.0::DOUBLE + j * 13.0::DOUBLE + {phase}) / sqrt({columns}::DOUBLE)))"
    )


def matmul_sql(weights: str, vector: str) -> str:
    return f"list_transform({weights}, lambda row: list_dot_product(row, {vector}))"


@query(
    "query_vector",
    "WITH " + X.VECTORS_SQL + ",\n" + f"""
start AS (SELECT {CONSTANT_SQL} AS v, {weights_sql(32, 64, 1)} AS w1, {weights_sql(64, 32, 2)} AS w2),
hidden AS (SELECT w2, list_transform({matmul_sql('w1', 'v')}, lambda x: tanh(x)) AS h FROM start),
q AS (SELECT {matmul_sql('w2', 'h')} AS v FROM hidden)
SELECT event_idx, round((list_cosine_similarity(repr, q.v) + 1) / 2, 6) AS score FROM vectors, q""",
)
def query_vector(spark, sf_dir):
    """Scores against a query that two layers make from a constant."""
    hidden = (formula_weights(32, 64, 1), np.zeros(32))
    output = (formula_weights(64, 32, 2), np.zeros(64))
    made = R.query_vector(CONSTANT, hidden, output)
    return R.cosine_scores(X.vectors(spark, sf_dir), made).select("event_idx", round6("score"))


def mlp_layers(dim: int, with_time: bool) -> list[R.Layer]:
    widths = [dim + with_time, dim // 2, dim // 4, dim // 8]
    layers = [
        R.Layer(formula_weights(b, a, phase), np.zeros(b), np.ones(b), np.zeros(b))
        for phase, (a, b) in enumerate(zip(widths, widths[1:]))
    ]
    return [*layers, R.Layer(formula_weights(1, widths[-1], 3), np.zeros(1))]


def mlp_sql(source: str, first: str, width: int) -> str:
    sizes = [width, 32, 16, 8]
    sql = f"x0 AS (SELECT event_idx, {first} AS x FROM {source})"
    for phase, (a, b) in enumerate(zip(sizes, sizes[1:])):
        n = phase + 1
        sql += f""",
w{n} AS (SELECT {weights_sql(b, a, phase)} AS w),
l{n} AS (SELECT event_idx, {matmul_sql('w', 'x')} AS x FROM x{phase}, w{n}),
c{n} AS (SELECT event_idx, x, list_avg(x) AS m FROM l{n}),
s{n} AS (SELECT event_idx, x, m, sqrt(list_avg(list_transform(x, lambda y: (y - m) * (y - m))) + 1e-5) AS s FROM c{n}),
x{n} AS (SELECT event_idx, list_transform(x, lambda z: greatest((z - m) / s, 0)) AS x FROM s{n})"""
    return sql + f""",
w4 AS (SELECT {weights_sql(1, 8, 3)} AS w)
SELECT event_idx, round(1 / (1 + exp(-list_dot_product(w[1], x))), 6) AS score FROM x3, w4"""


@query(
    "mlp_score",
    "WITH " + X.VECTORS_SQL + ",\n" + mlp_sql("vectors", "list_append(repr, CAST(time_min AS DOUBLE) / 2880)", 65),
)
def mlp_score(spark, sf_dir):
    rows = X.vectors(spark, sf_dir).withColumn("time_share", F.col("time_min") / 2880)
    scores = R.mlp_score(rows, mlp_layers(X.DIM, True), time="time_share")
    return scores.select("event_idx", round6("score"))


@query("mlp_score_untimed", "WITH " + X.VECTORS_SQL + ",\n" + mlp_sql("vectors", "repr", 64))
def mlp_score_untimed(spark, sf_dir):
    scores = R.mlp_score(X.vectors(spark, sf_dir), mlp_layers(X.DIM, False), time=None)
    return scores.select("event_idx", round6("score"))


def head(classes: int, phase: int):
    return [(row, 0.1 * i) for i, row in enumerate(formula_weights(classes, X.DIM, phase).tolist())]


@query(
    "linear_heads",
    "WITH " + FALLBACK_SQL + f""",
heads AS (SELECT {weights_sql(1, 64, 4)} AS b, {weights_sql(5, 64, 5)} AS m),
logits AS (
  SELECT sample_id, list_dot_product(b[1], pooled) AS b,
         list_transform(range(5), lambda c: exp(list_dot_product(m[c + 1], pooled) + 0.1 * c)) AS m
  FROM filled, heads)
SELECT sample_id, round(1 / (1 + exp(-b)), 6) AS mortality_1,
       {text_sql('list_transform(m, lambda y: y / list_sum(m))')} AS creatinine_1 FROM logits""",
)
def linear_heads(spark, sf_dir):
    heads = {"mortality_1": ("binary", head(1, 4)), "creatinine_1": ("multiclass", head(5, 5))}
    scored_heads = H.linear_heads(filled(spark, sf_dir), heads)
    return scored_heads.select(
        "sample_id",
        F.round(F.col("mortality_1")[0], 6).alias("mortality_1"),
        text_of(F.col("creatinine_1")).alias("creatinine_1"),
    )


# --- event vectors from tokens -----------------------------------------------------------


def embedding_tables(spark, sf_dir):
    """Token, type and place vectors, read from the given vectors by id."""
    table = X.table(spark, sf_dir, "embeddings")

    def by(name: str):
        return table.select(F.col("vec_id").cast("int").alias(name), "embedding")

    return by("token_id"), by("type_id"), by("dpe_id")


LOOKUP_SQL = TP.IDS_SQL + """,
looked AS (
  SELECT i.subject_id, i.event_id, i.pos, a.embedding AS a, b.embedding AS b, c.embedding AS c
  FROM ids i LEFT JOIN embeddings a ON a.vec_id = i.token_id AND i.token_id <> 0
  LEFT JOIN embeddings b ON b.vec_id = i.type_id AND i.type_id <> 0
  LEFT JOIN embeddings c ON c.vec_id = i.dpe_id AND i.dpe_id <> 0),
summed AS (
  SELECT subject_id, event_id, pos, list_transform(range(1, 65), lambda k:
    coalesce(CAST(a[k] AS DOUBLE), 0) + coalesce(CAST(b[k] AS DOUBLE), 0) + coalesce(CAST(c[k] AS DOUBLE), 0)) AS vector
  FROM looked)"""


@query(
    "token_embedding_lookup",
    "WITH " + LOOKUP_SQL + """
SELECT event_id, CAST(pos AS BIGINT) AS pos, round(list_sum(vector), 6) AS total,
       round(vector[1], 6) AS first, round(vector[64], 6) AS last
FROM summed""",
)
def token_embedding_lookup(spark, sf_dir):
    tables = embedding_tables(spark, sf_dir)
    rows = E.token_embedding_lookup(TP.event_token_ids(spark, sf_dir), *tables, X.DIM)
    vector = F.col("vector")
    return rows.select(
        "event_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(vector[0], 6).alias("first"),
        F.round(F.element_at(vector, -1), 6).alias("last"),
    )


def encoder(spark, sf_dir):
    """Events with tokens to events with vectors; the vocabulary is that of all events."""
    vocabulary = TP.K.build_vocabulary(TP.event_token_rows(spark, sf_dir))
    tables = embedding_tables(spark, sf_dir)
    return lambda events: E.event_vectors(events, vocabulary, *tables, X.DIM)


EVENT_VECTORS_SQL = LOOKUP_SQL + ",\nevent_vectors AS " + mean_sql("summed", "subject_id, event_id", "vector")


@query(
    "event_vectors",
    "WITH " + EVENT_VECTORS_SQL + """
SELECT event_id, round(list_sum(pooled), 6) AS total, round(pooled[1], 6) AS first, round(pooled[64], 6) AS last
FROM event_vectors""",
)
def event_vectors(spark, sf_dir):
    events = TP.tokenized(spark, sf_dir, TP.NOT_FIELDS_OR_IDS)
    encoded = encoder(spark, sf_dir)(events.select("event_id", "tokens"))
    vector = F.col("repr")
    return encoded.select(
        "event_id",
        F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(vector[0], 6).alias("first"),
        F.round(F.element_at(vector, -1), 6).alias("last"),
    )


@query(
    "event_vectors_blocked",
    "WITH " + EVENT_VECTORS_SQL + """
SELECT event_id, round(list_sum(pooled), 6) AS total, round(pooled[1], 6) AS first, round(pooled[64], 6) AS last
FROM event_vectors""",
)
def event_vectors_blocked(spark, sf_dir):
    """The same vectors with the token table in blocks of ids, as if it were too large to send."""
    events = TP.tokenized(spark, sf_dir, TP.NOT_FIELDS_OR_IDS).select("event_id", "tokens")
    vocabulary = materialise(TP.K.build_vocabulary(TP.event_token_rows(spark, sf_dir)), "vocabulary")
    sums = E.token_sums(events, "event_id", vocabulary, *embedding_tables(spark, sf_dir), X.DIM, block_bytes=64 * X.DIM * 4)
    vector = F.col("vector")
    return sums.select(
        "event_id",
        F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x) / F.col("n_tokens"), 6).alias("total"),
        F.round(vector[0] / F.col("n_tokens"), 6).alias("first"),
        F.round(F.element_at(vector, -1) / F.col("n_tokens"), 6).alias("last"),
    )


@query(
    "encode_with",
    "WITH " + X.KEPT_SQL + """
SELECT event_id, round(CAST(length(code) AS DOUBLE), 6) AS a, round(numeric_value / 7, 3) AS b FROM kept""",
)
def encode_with(spark, sf_dir):
    """A user encoder on Arrow batches, loaded once in each worker: here the length of the code and a share of the value."""

    def load():
        share = np.float64(7)  # what a real one would read its weights for

        def encode(batch):
            lengths = pc.utf8_length(batch.column("code")).to_numpy(zero_copy_only=False)
            return np.stack([lengths, batch.column("numeric_value").to_numpy(zero_copy_only=False) / share], axis=1)

        return encode

    coded = E.encode_with(X.kept(spark, sf_dir), ["event_id"], ["code", "numeric_value"], set_up=load)
    return coded.select(
        "event_id",
        F.col("repr")[0].cast("double").alias("a"),
        F.round(F.col("repr")[1].cast("double"), 3).alias("b"),
    )


# --- retrieval over histories and the way back to the cohort -----------------------------

HISTORY_TOP_SQL = X.JOINED_SQL + """,
ranked AS (
  SELECT sample_id, event_id, event_idx,
         row_number() OVER (PARTITION BY sample_id ORDER BY numeric_value DESC, event_idx) AS rank FROM joined)"""


@query(
    "history_topk",
    "WITH " + HISTORY_TOP_SQL + " SELECT sample_id, event_id, rank FROM ranked WHERE rank <= 5",
)
def history_topk(spark, sf_dir):
    """The five largest values in the history of each sample."""
    events, samples, hot = histories(spark, sf_dir)
    rows = events.select("subject_id", "event_idx", "event_id", F.col("numeric_value").alias("score"))
    best = R.history_topk(rows, samples, 5, hot=hot)
    return best.select("sample_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


PREDICT_SQL = TP.IDS_SQL.replace(X.KEPT_SQL, X.JOINED_SQL) + ",\n" + LOOKUP_SQL[len(TP.IDS_SQL) + 2 :] + ",\nevent_vectors AS " + mean_sql(
    "summed", "subject_id, event_id", "vector"
) + ",\n" + QUERY_SQL + f""",
event_scores AS (
  SELECT event_id, pooled AS vector, (list_cosine_similarity(pooled, q.v) + 1) / 2 AS score FROM event_vectors, q),
ranked AS (
  SELECT j.sample_id, j.event_idx, s.vector, s.score,
         row_number() OVER (PARTITION BY j.sample_id ORDER BY round(s.score, 9) DESC, j.event_idx) AS rank
  FROM joined j JOIN event_scores s ON j.event_id = s.event_id WHERE round(s.score, 9) > 0.6),
pooled AS """ + mean_sql("(SELECT * FROM ranked WHERE rank <= 16)", "sample_id", "vector") + f""",
filled AS (
  SELECT s.sample_id, s.endtime, s.label, coalesce(p.pooled, {CONSTANT_SQL}) AS pooled
  FROM (SELECT DISTINCT sample_id, endtime, label FROM joined) s LEFT JOIN pooled p ON s.sample_id = p.sample_id),
head AS (SELECT {weights_sql(1, 64, 4)} AS w)
SELECT CAST(split_part(sample_id, '_', 1) AS BIGINT) AS subject_id, strftime(endtime, '%Y-%m-%d %H:%M:%S.%f') AS endtime,
       label, round(1 / (1 + exp(-list_dot_product(w[1], pooled))), 6) AS boolean_prediction,
       CAST(1 / (1 + exp(-list_dot_product(w[1], pooled))) > 0.5 AS INTEGER) AS predicted_label
FROM filled, head"""


@query("predict_cohort", "WITH " + PREDICT_SQL)
def predict_cohort(spark, sf_dir):
    """Tokens to event vectors, scores, the 16 best of each history, pooled, scored, on the cohort.

    Vectors and scores are made once per event and only the scores are kept; the vectors of the
    events that won a place are made again, so that no vector is shuffled for the others.
    """
    events, samples, hot = histories(spark, sf_dir)
    fields = ["subject_id", "event_idx", "code", "numeric_value", "props"]
    tokens = TP.K.tokenize(events.select(*fields), ("subject_id", "event_idx"))
    tokens = tokens.select("subject_id", "event_idx", "tokens")
    encode = encoder(spark, sf_dir)
    seen = R.cosine_scores(R.mask_zero_vectors(encode(tokens)), X.first_vector(spark, sf_dir))
    seen = seen.select("subject_id", "event_idx", F.round("score", 9).alias("score"))
    best = materialise(R.history_topk(R.reject_below(seen, 0.6), samples, 16, hot=hot), "retrieved")
    won = best.select("subject_id", "event_idx").distinct()
    vectors = encode(tokens.join(won, ["subject_id", "event_idx"], "left_semi"))
    # An event that many samples of a subject want is a hot key, which adaptive execution splits.
    winners = best.join(vectors.select("subject_id", "event_idx", "repr"), ["subject_id", "event_idx"])
    pooled = E.mean_pool(winners, ["sample_id"], "repr")
    ready = R.empty_retrieval_fallback(samples.select("sample_id"), pooled, "sample_id", CONSTANT)
    predictions = H.linear_heads(ready, {"binary": ("binary", head(1, 4))}).select(
        "sample_id", F.col("binary")[0].alias("boolean_prediction")
    )
    cohort = samples.select("sample_id", "endtime", "label")
    result = P.predicted_label(
        P.restore_subject_id(P.attach_predictions(cohort, predictions))
    )
    return result.select(
        "subject_id",
        F.date_format("endtime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("endtime"),
        "label",
        round6("boolean_prediction"),
        "predicted_label",
    )


@query(
    "fit_head",
    "WITH " + X.VECTORS_SQL + """
SELECT DISTINCT CAST(unnest(range(-1, 64)) AS BIGINT) AS component, true AS at_minimum FROM vectors""",
)
def fit_head(spark, sf_dir):
    """A binary head on pooled vectors (does the sample hold more low than high classes): is the gradient of
    its loss 0 in every component?"""
    rows = X.vectors(spark, sf_dir)
    pooled = E.mean_pool(rows, ["sample_id"], "repr")
    label = (F.avg("label") < 4.5).cast("int").alias("label")
    train = materialise(pooled.join(rows.groupBy("sample_id").agg(label), "sample_id"), "train")
    gradient = H.head_gradient(H.fit_head(train, "pooled", "label"), train, "pooled", "label")
    return gradient.select(F.col("component").cast("bigint").alias("component"), (F.abs("gradient") < 1e-5).alias("at_minimum"))


#: A head of each kind; 17 classes are those of the diagnosis family.
TASKS = [L.Task("mortality_1", "binary", 1), L.Task("creatinine_1", "multiclass", 5), L.Task("diagnosis", "multilabel", 17)]


def labelled_vectors(spark, sf_dir):
    """All vectors with labels of three tasks made from their class and number; each task lacks some."""
    label, number = F.col("label"), F.col("event_idx")
    known = {"mortality_1": number % 7 != 0, "creatinine_1": number % 11 != 0, "diagnosis": number % 5 != 0}
    truth = {
        "mortality_1": A.binary_label(F.when(known["mortality_1"], (label < 5).cast("int"))),
        "creatinine_1": A.one_hot(F.when(known["creatinine_1"], label % 5), 5),
        "diagnosis": A.multi_hot(F.when(known["diagnosis"], F.array(label, (label * 3 + 1) % 17, 10 + number % 7)), 17),
    }
    return X.vectors(spark, sf_dir).select("event_idx", "repr", *[v.alias(k) for k, v in truth.items()])


@query(
    "fit_heads",
    """WITH classes AS (SELECT * FROM (VALUES ('mortality_1', 1), ('creatinine_1', 5), ('diagnosis', 17)) AS t(task, n)),
rows AS (SELECT task, unnest(range(n)) AS class FROM classes)
SELECT DISTINCT task, CAST(class AS INT) AS class, CAST(component AS INT) AS component, true AS at_minimum
FROM rows, (SELECT unnest(range(-1, len(embedding))) AS component FROM embeddings)""",
)
def fit_heads(spark, sf_dir):
    """Heads of three kinds with missing labels from the same passes: is the gradient 0 in every class and component?"""
    train = materialise(labelled_vectors(spark, sf_dir), "labelled")
    fitted = L.fit_heads(train, TASKS, "repr", penalty=1e-2)
    gradient = L.heads_gradient(fitted, train, TASKS, "repr", penalty=1e-2)
    return gradient.select("task", "class", "component", (F.abs("gradient") < 1e-5).alias("at_minimum"))


@query(
    "predict_head",
    "WITH " + X.VECTORS_SQL + f""",
heads AS (SELECT {weights_sql(10, 64, 5)} AS m),
logits AS (
  SELECT event_idx, label, list_transform(range(10), lambda c: exp(list_dot_product(m[c + 1], repr) + 0.1 * c)) AS e
  FROM vectors, heads)
SELECT event_idx, label, {text_sql('list_transform(e, lambda y: y / list_sum(e))')} AS probability,
       CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS predicted_label FROM logits""",
)
def predict_head(spark, sf_dir):
    """A ten-class head with given weights on single vectors."""
    scores = H.predict_head(("multiclass", head(10, 5)), X.vectors(spark, sf_dir), "repr")
    return scores.select("event_idx", "label", text_of(F.col("probability")).alias("probability"), "predicted_label")


# --- a scorer that sees how long before the end of the sample an event was ----------------


def timed_layers() -> list[R.Layer]:
    first = formula_weights(4, 3, 1)
    first[:, 2] /= 1440.0
    return [R.Layer(first, np.zeros(4), np.ones(4), np.zeros(4)), R.Layer(formula_weights(1, 4, 2), np.zeros(1))]


@query(
    "history_topk_timed",
    "WITH " + X.JOINED_SQL + f""",
aged AS (
  SELECT sample_id, event_id, event_idx, [numeric_value / 100, (event_idx % 7) / 7,
         (max(time_min) OVER (PARTITION BY sample_id) - time_min) / 1440.0::DOUBLE] AS x FROM joined),
w AS (SELECT {weights_sql(4, 3, 1)} AS a, {weights_sql(1, 4, 2)} AS b),
hidden AS (SELECT sample_id, event_id, event_idx, {matmul_sql('a', 'x')} AS h, b FROM aged, w),
centred AS (SELECT *, list_transform(h, lambda y: y - list_avg(h)) AS d FROM hidden),
scaled AS (
  SELECT *, list_transform(d, lambda y: greatest(y / sqrt(list_avg(list_transform(d, lambda z: z * z)) + 1e-5), 0)) AS r FROM centred),
scores AS (SELECT *, 1 / (1 + exp(-list_dot_product(b[1], r))) AS score FROM scaled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, event_idx) AS rank FROM scores WHERE score > 0.3)
SELECT sample_id, event_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 5""",
)
def history_topk_timed(spark, sf_dir):
    """The five events of each history that a small network over value, place and age likes best."""
    events, samples, _ = histories(spark, sf_dir)
    vector = F.array(F.col("numeric_value") / 100, (F.col("event_idx") % 7) / 7)
    rows = events.select("subject_id", "event_idx", "event_id", F.col("time_min").cast("bigint").alias("time_min"), vector.alias("repr"))
    best = M.history_topk_timed(rows, samples, timed_layers(), 5, 0.3)
    named = best.join(rows.select("subject_id", "event_idx", "event_id"), ["subject_id", "event_idx"])
    return named.select("sample_id", "event_id", F.col("rank").cast("bigint").alias("rank"), round6("score"))


@query(
    "history_topk_bounded",
    "WITH " + X.MEDS_SQL + """,
placed AS (SELECT event_id, numeric_value, row_number() OVER (ORDER BY event_id) - 1 AS event_idx,
       CAST((row_number() OVER (ORDER BY event_id) - 1) * 7 AS BIGINT) AS time_min FROM meds),
samples AS (SELECT event_idx // 25 AS sample_no, event_idx + 1 AS n_events FROM placed WHERE event_idx % 25 = 24),
aged AS (
  SELECT sample_no, event_id, event_idx, [numeric_value / 100, (event_idx % 7) / 7, (7 * (n_events - 1) - time_min) / 1440.0::DOUBLE] AS x
  FROM samples JOIN placed ON event_idx < n_events),
w AS (SELECT """ + f"""{weights_sql(4, 3, 1)} AS a, {weights_sql(1, 4, 2)} AS b),
hidden AS (SELECT sample_no, event_id, event_idx, {matmul_sql('a', 'x')} AS h, b FROM aged, w),
centred AS (SELECT *, list_transform(h, lambda y: y - list_avg(h)) AS d FROM hidden),
scaled AS (
  SELECT *, list_transform(d, lambda y: greatest(y / sqrt(list_avg(list_transform(d, lambda z: z * z)) + 1e-5), 0)) AS r FROM centred),
scores AS (SELECT *, 1 / (1 + exp(-list_dot_product(b[1], r))) AS score FROM scaled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_no ORDER BY round(score, 9) DESC, event_idx) AS rank FROM scores WHERE score > 0.3)
SELECT sample_no, event_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 5""",
)
def history_topk_bounded(spark, sf_dir):
    """All events as the history of one subject with a sample at every 25th: the best five of each, found by bounds."""
    events = running(X.meds(spark, sf_dir), [], ["event_id"], {"__place": ("sum", F.lit(1).cast("bigint"))})
    events = events.withColumns({"subject_id": F.lit(1).cast("bigint"), "event_idx": F.col("__place") - 1})
    vector = F.array(F.col("numeric_value") / 100, (F.col("event_idx") % 7) / 7)
    rows = events.select("subject_id", "event_idx", "event_id", (F.col("event_idx") * 7).alias("time_min"), vector.alias("repr"))
    rows = materialise(rows, "one subject")
    samples = rows.where("event_idx % 25 = 24").select(
        "subject_id",
        F.floor(F.col("event_idx") / 25).alias("sample_no"),
        F.concat(F.lit("1_"), F.floor(F.col("event_idx") / 25).cast("string")).alias("sample_id"),
        (F.col("event_idx") + 1).alias("n_events"),
    )
    best = M.history_topk_timed(rows, samples, timed_layers(), 5, 0.3, worth=0.1)
    named = best.join(rows.select("subject_id", "event_idx", "event_id"), ["subject_id", "event_idx"])
    number = F.split_part("sample_id", F.lit("_"), F.lit(2)).cast("bigint").alias("sample_no")
    return named.select(number, "event_id", F.col("rank").cast("bigint").alias("rank"), round6("score"))
