"""Losses, metrics, tasks and early stopping."""

from __future__ import annotations

from pyspark.sql import functions as F

from anamnesis.functions import arrays as A
from anamnesis.operators import metrics as M
from anamnesis.plans import fixtures as X
from anamnesis.registry import register_operator as query

METRIC_SQL = X.SCORES_SQL + """,
known AS (SELECT * FROM long_scores WHERE truth <> -1),
counts AS (
  SELECT task, score, sum(truth) AS pos, sum(1 - truth) AS neg FROM known GROUP BY task, score),
ranked AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM counts
  WINDOW w AS (PARTITION BY task ORDER BY score DESC)),
ranking AS (
  SELECT task, 1 - sum(pos * (fp - neg / 2.0)) / (sum(pos) * sum(neg)) AS auroc,
         sum(pos * tp / (tp + fp)) / sum(pos) AS auprc FROM ranked GROUP BY task),
losses AS (
  SELECT task, sum(CASE WHEN truth = -1 THEN 0 ELSE -(
      truth * CASE WHEN score > 0 THEN greatest(ln(score), -100) ELSE -100 END +
      (1 - truth) * CASE WHEN score < 1 THEN greatest(ln(1 - score), -100) ELSE -100 END) END) / count(*) AS loss
  FROM long_scores GROUP BY task),
hits AS (SELECT task, avg(CAST(round_even(score, 0) = truth AS INTEGER)) AS acc FROM known GROUP BY task)"""


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def known(spark, sf_dir):
    return X.long_scores(spark, sf_dir).where(F.col("truth") != -1)


@query("masked_bce_loss", "WITH " + METRIC_SQL + " SELECT task, round(loss, 6) AS loss FROM losses")
def masked_bce_loss(spark, sf_dir):
    rows = X.long_scores(spark, sf_dir)
    return rounded(M.masked_bce_loss(rows, ["task"], "truth", "score"), "loss")


def multilabel(spark, sf_dir):
    """Both document labels as one two-class row, missing where neither is set."""
    scores = X.scores(spark, sf_dir)
    present = F.filter(
        F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1)), lambda c: c.isNotNull()
    )
    return scores.select(
        "doc_id", A.multi_hot(present, 2).alias("truth"), F.array("p_quality", "p_toxic").alias("p")
    )


MULTILABEL_ROWS_SQL = """label_rows AS (
  SELECT CAST(greatest(quality, 0) AS DOUBLE) AS t0, CAST(greatest(toxic, 0) AS DOUBLE) AS t1,
         p_quality AS p0, p_toxic AS p1 FROM scores)"""

MULTILABEL_SQL = X.SCORES_SQL + """,
rows AS (SELECT CAST(greatest(quality, 0) AS DOUBLE) AS t0, CAST(greatest(toxic, 0) AS DOUBLE) AS t1,
                p_quality AS p0, p_toxic AS p1 FROM scores)"""


def clamp(p: str) -> str:
    return f"CASE WHEN {p} > 0 THEN greatest(ln({p}), -100) ELSE -100 END"


@query(
    "masked_multilabel_loss",
    "WITH " + MULTILABEL_SQL + f"""
SELECT round(sum(CASE WHEN t0 + t1 > 0 THEN
    -(t0 * {clamp('p0')} + (1 - t0) * {clamp('1 - p0')} + t1 * {clamp('p1')} + (1 - t1) * {clamp('1 - p1')}) / 2
    ELSE 0 END) / count(*), 6) AS loss FROM rows""",
)
def masked_multilabel_loss(spark, sf_dir):
    return rounded(M.masked_multilabel_loss(multilabel(spark, sf_dir), [], "truth", "p"), "loss")


def multiclass(spark, sf_dir):
    """Ten classes, each scored by every tenth component of the vector; class 3 is unknown."""
    rows = X.vectors(spark, sf_dir)

    def score(c):
        own = F.filter("repr", lambda x, i: i % 10 == c)
        return F.exp(F.aggregate(own, F.lit(0.0), lambda a, x: a + x.cast("double")))

    raised = F.transform(F.sequence(F.lit(0), F.lit(9)), score)
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "event_idx",
        A.one_hot(F.when(F.col("label") != 3, F.col("label")), 10).alias("truth"),
        F.transform(raised, lambda x: x / total).alias("p"),
    )


MULTICLASS_SQL = """raised AS (
  SELECT vec_id, label, list_transform(range(10), lambda c:
    exp(list_sum(list_filter(CAST(embedding AS DOUBLE[]), lambda x, i: (i - 1) % 10 = c)))) AS e FROM embeddings),
rows AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM raised)"""


@query(
    "masked_nll_loss",
    "WITH " + MULTICLASS_SQL + """
SELECT round(sum(CASE WHEN label = 3 THEN 0 ELSE -ln(p[label + 1] + 1e-10) END) / count(*), 6) AS loss FROM rows""",
)
def masked_nll_loss(spark, sf_dir):
    return rounded(M.masked_nll_loss(multiclass(spark, sf_dir), [], "truth", "p"), "loss")


@query("auroc", "WITH " + METRIC_SQL + " SELECT task, round(auroc, 6) AS auroc FROM ranking")
def auroc(spark, sf_dir):
    return rounded(M.auroc(known(spark, sf_dir), ["task"], "truth", "score"), "auroc")


@query("auprc", "WITH " + METRIC_SQL + " SELECT task, round(auprc, 6) AS auprc FROM ranking")
def auprc(spark, sf_dir):
    return rounded(M.auprc(known(spark, sf_dir), ["task"], "truth", "score"), "auprc")


@query(
    "micro_ranking",
    "WITH " + MULTICLASS_SQL + """,
pairs AS (SELECT unnest(range(10)) AS c, label, p FROM rows WHERE label <> 3),
counts AS (
  SELECT score, sum(t) AS pos, sum(1 - t) AS neg
  FROM (SELECT CAST(label = c AS INTEGER) AS t, p[c + 1] AS score FROM pairs) GROUP BY score),
ranked AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM counts WINDOW w AS (ORDER BY score DESC))
SELECT 'creatinine_1' AS task, round(1 - sum(pos * (fp - neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auroc,
       round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS auprc FROM ranked""",
)
def micro_ranking(spark, sf_dir):
    """Micro average over all (row, class) pairs."""
    rows = multiclass(spark, sf_dir).where(~F.array_contains("truth", -1.0))
    pairs = M.ravel(rows.withColumn("task", F.lit("creatinine_1")), ["task"], "truth", "p")
    return rounded(M.ranking_metrics(pairs, ["task"], "truth", "score"), "auroc", "auprc")


@query(
    "accuracy",
    "WITH " + METRIC_SQL + ",\n" + MULTICLASS_SQL.replace("rows AS", "class_rows AS") + """
SELECT task, round(acc, 6) AS acc FROM hits
UNION ALL
SELECT 'diagnosis', round(avg(CAST(round_even(p_quality, 0) = greatest(quality, 0)
                                   AND round_even(p_toxic, 0) = greatest(toxic, 0) AS INTEGER)), 6)
FROM scores WHERE greatest(quality, 0) + greatest(toxic, 0) > 0
UNION ALL
SELECT 'creatinine_1', round(avg(CAST(list_position(p, list_max(p)) - 1 = label AS INTEGER)), 6)
FROM class_rows WHERE label <> 3""",
)
def accuracy(spark, sf_dir):
    binary = M.binary_accuracy(known(spark, sf_dir), ["task"], "truth", "score")
    many = multilabel(spark, sf_dir).where(~F.array_contains("truth", -1.0))
    subset = M.subset_accuracy(many.withColumn("task", F.lit("diagnosis")), ["task"], "truth", "p")
    one = multiclass(spark, sf_dir).where(~F.array_contains("truth", -1.0))
    classes = M.multiclass_accuracy(one.withColumn("task", F.lit("creatinine_1")), ["task"], "truth", "p")
    return rounded(binary.unionByName(subset).unionByName(classes), "acc")


@query(
    "task_metrics",
    "WITH " + METRIC_SQL + ",\n" + MULTILABEL_ROWS_SQL + ",\n" + MULTICLASS_SQL.replace("rows AS", "class_rows AS") + f""",
pairs AS (
  SELECT 'diagnosis' AS task, t0 AS truth, p0 AS score FROM label_rows WHERE t0 + t1 > 0
  UNION ALL SELECT 'diagnosis', t1, p1 FROM label_rows WHERE t0 + t1 > 0
  UNION ALL SELECT 'creatinine_1', CAST(label = c AS DOUBLE), p[c + 1]
  FROM (SELECT *, unnest(range(10)) AS c FROM class_rows WHERE label <> 3)),
pair_counts AS (SELECT task, score, sum(truth) AS pos, sum(1 - truth) AS neg FROM pairs GROUP BY task, score),
pair_ranked AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM pair_counts WINDOW w AS (PARTITION BY task ORDER BY score DESC)),
pair_ranking AS (
  SELECT task, 1 - sum(pos * (fp - neg / 2.0)) / (sum(pos) * sum(neg)) AS auroc,
         sum(pos * tp / (tp + fp)) / sum(pos) AS auprc FROM pair_ranked GROUP BY task),
pair_losses AS (
  SELECT 'diagnosis' AS task, sum(CASE WHEN t0 + t1 > 0 THEN
      -(t0 * {clamp('p0')} + (1 - t0) * {clamp('1 - p0')} + t1 * {clamp('p1')} + (1 - t1) * {clamp('1 - p1')}) / 2
      ELSE 0 END) / count(*) AS loss FROM label_rows
  UNION ALL
  SELECT 'creatinine_1', sum(CASE WHEN label = 3 THEN 0 ELSE -ln(p[label + 1] + 1e-10) END) / count(*) FROM class_rows),
pair_hits AS (
  SELECT 'diagnosis' AS task, avg(CAST(round_even(p0, 0) = t0 AND round_even(p1, 0) = t1 AS INTEGER)) AS acc
  FROM label_rows WHERE t0 + t1 > 0
  UNION ALL
  SELECT 'creatinine_1', avg(CAST(list_position(p, list_max(p)) - 1 = label AS INTEGER)) FROM class_rows WHERE label <> 3),
per_task AS (
  SELECT l.task, loss, auprc, auroc, acc FROM losses l JOIN ranking r ON l.task = r.task JOIN hits h ON l.task = h.task
  UNION ALL
  SELECT l.task, loss, auprc, auroc, acc FROM pair_losses l JOIN pair_ranking r ON l.task = r.task JOIN pair_hits h ON l.task = h.task),
long AS (
  SELECT task, 'loss' AS metric, loss AS value FROM per_task UNION ALL SELECT task, 'auprc', auprc FROM per_task
  UNION ALL SELECT task, 'auroc', auroc FROM per_task UNION ALL SELECT task, 'acc', acc FROM per_task)
SELECT task, metric, round(value, 6) AS value FROM long
UNION ALL SELECT 'avg', metric, round(avg(value), 6) FROM long GROUP BY metric""",
)
def task_metrics(spark, sf_dir):
    """Tasks of all three kinds, and their mean."""
    many = multilabel(spark, sf_dir).withColumn("task", F.lit("diagnosis"))
    one = multiclass(spark, sf_dir).withColumn("task", F.lit("creatinine_1"))
    return rounded(M.evaluate(X.long_scores(spark, sf_dir), many, one), "value")


@query(
    "task_table",
    "WITH " + X.SCORES_SQL + """,
tasks AS (
  SELECT task, count(*) AS n FROM long_scores GROUP BY task
  UNION ALL SELECT 'hb_' || CAST(label AS VARCHAR), count(*) FROM embeddings GROUP BY label
  UNION ALL SELECT 'diagnosis', count(*) FROM labels)
SELECT task, n, CASE WHEN regexp_matches(task, 'mortality|readmission|los') THEN 'binary'
                     WHEN regexp_matches(task, 'diagnosis') THEN 'multilabel' ELSE 'multiclass' END AS kind,
       CASE WHEN regexp_matches(task, 'mortality|readmission|los') THEN 1
            WHEN regexp_matches(task, 'diagnosis') THEN 17 ELSE 4 END AS num_classes FROM tasks""",
)
def task_table(spark, sf_dir):
    """Kind and classes of every task that has scored rows."""
    binary = X.long_scores(spark, sf_dir).groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    classes = (
        X.vectors(spark, sf_dir)
        .groupBy(F.concat(F.lit("hb_"), F.col("label").cast("string")).alias("task"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    many = X.table(spark, sf_dir, "labels").agg(F.lit("diagnosis").alias("task"), F.count(F.lit(1)).alias("n"))
    return M.task_table(binary.unionByName(classes).unionByName(many.select("task", "n")))


@query(
    "task_filter",
    "WITH " + X.SCORES_SQL + " SELECT task, doc_id, round(score, 6) AS score FROM long_scores WHERE task = 'readmission'",
)
def task_filter(spark, sf_dir):
    present = spark.sql("SELECT * FROM VALUES ('readmission'), ('los_7') AS tasks(task)")
    rows = M.task_filter(X.long_scores(spark, sf_dir), present)
    return rows.select("task", "doc_id", F.round("score", 6).alias("score"))


# --- early stopping: per event type one run, a day is an epoch, the mean value its metric ---


def metric_history(spark, sf_dir):
    events = X.table(spark, sf_dir, "events")
    epoch = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    daily = events.groupBy(F.col("event_type").alias("run_id"), epoch.cast("bigint").alias("epoch")).agg(
        F.round(F.avg("value"), 1).alias("value")
    )
    return daily.where(F.col("epoch") % 3 != 1)  # some epochs were not evaluated


EARLY_STOP_SQL = """WITH history AS (
  SELECT event_type AS run_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS epoch, round(avg(value), 1) AS value
  FROM events GROUP BY 1, 2 HAVING epoch % 3 <> 1),
signed AS (SELECT *, {sign}value AS v FROM history),
best AS (
  SELECT *, coalesce(v >= max(v) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best
  FROM signed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS n FROM best),
counted AS (
  SELECT *, n - max(CASE WHEN is_best THEN n END) OVER (PARTITION BY run_id ORDER BY epoch) AS counter FROM numbered),
stops AS (SELECT run_id, min(epoch) AS stop FROM counted WHERE counter >= 3 GROUP BY run_id)
SELECT c.run_id, c.epoch, c.value, c.is_best, c.counter, c.counter >= 3 AS stopped
FROM counted c LEFT JOIN stops s ON c.run_id = s.run_id WHERE s.stop IS NULL OR c.epoch <= s.stop"""


@query("early_stop", EARLY_STOP_SQL.format(sign=""))
def early_stop(spark, sf_dir):
    return M.early_stop(metric_history(spark, sf_dir), patience=3)


@query("early_stop_loss", EARLY_STOP_SQL.format(sign="-"))
def early_stop_loss(spark, sf_dir):
    return M.early_stop(metric_history(spark, sf_dir), patience=3, metric="avg_loss")
