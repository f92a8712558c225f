"""The three jobs on files: process events, encode events, predict a cohort.

Each reads what the one before wrote:

``process_events``  ``out/index`` (one row per sample), ``out/events`` (placed events with
                    tokens), ``out/samples`` (nested chunks), ``out/manifest``, ``out/malformed``
``encode_events``   ``out/vocabulary`` and ``out/vectors`` (one vector per event)
``predict_cohort``  a cohort with a prediction per row

A subject is a subject of its split: one found in the folders of two splits has a history in
each, and they never mix. In the steps of a job split and subject are one key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis import settings as S
from anamnesis.operators import cohort as C
from anamnesis.operators import heads as H
from anamnesis.operators import predict as P
from anamnesis.operators import retrieval as R
from anamnesis.operators import sequence as Q
from anamnesis.operators import timed as M
from anamnesis.operators import tokens as K
from anamnesis.operators import vectors as E
from anamnesis.operators.skew import find_hot
from anamnesis.sources import events as SE
from anamnesis.sources import samples as SS
from anamnesis.sources.workspace import materialise
from anamnesis.streaming.ingest import read_ingested

NOT_FIELDS = ("subject_id", "time", "split", "source_row", SE.MALFORMED)
_APART = "\x1f"


def keyed(df: DataFrame) -> DataFrame:
    """Split and subject as the one key ``subject_id``; a table without splits has the empty one."""
    split = F.col("split") if "split" in df.columns else F.lit("")
    return df.withColumn("subject_id", F.concat(split, F.lit(_APART), F.col("subject_id").cast("string"))).drop("split")


def unkeyed(df: DataFrame) -> DataFrame:
    """Split and subject from the key; a sample id is again the subject's and its number."""
    parts = [F.split_part("subject_id", F.lit(_APART), F.lit(i)) for i in (1, 2)]
    out = df.withColumns({"split": parts[0], "subject_id": parts[1].cast("bigint")})
    if "sample_no" in df.columns:
        out = out.withColumn("sample_id", F.concat_ws("_", F.col("subject_id").cast("string"), F.col("sample_no").cast("string")))
    return out


def _in_splits(asked: DataFrame, subjects: DataFrame) -> DataFrame:
    """Predictions by key: in their own split if they have one, else in each split of their subject."""
    on = ["split", "subject_id"] if "split" in asked.columns else ["subject_id"]
    return keyed(asked.join(subjects, on))


def process_events(
    spark: SparkSession,
    root: str,
    cohort: str,
    out: str,
    codes: str | None = None,
    label: str = "boolean_value",
    rebase: bool = False,
    event_schema: str | None = SE.EVENT_SCHEMA,
    cohort_schema: str = SE.COHORT_SCHEMA,
    max_events: int | None = None,
    shards: int = 1,
    birth_code: str = S.BIRTH_CODE,
    hours: int = -1,
    max_tokens: int = S.MAX_EVENT_TOKENS,
) -> None:
    """Events and predictions on disk to samples, manifest and placed events on disk.

    Events at the same time keep the order of their rows in the files. All columns of the files beyond subject and time
    go into the events; CSV columns that ``event_schema`` doesn't name are text. CSV rows that don't fit their header or
    its types are no events; they are listed in ``out/malformed`` with their file. A cohort whose folders are named like
    splits of the events is paired with them; any other holds for all splits. ``hours`` leaves out
    events before that hour of a history, ``max_events`` keeps the last events of each history
    only. Samples and manifest have a folder for each split and shard.
    """
    origin = {"split": SE.split_from_path(root), "source_row": SE.source_order()}
    raw = SE.scan_events(spark, root, event_schema, origin, malformed=True)
    fits = F.col(SE.MALFORMED).isNull()
    kept = K.drop_empty_events(C.drop_birth_and_static(raw.where(fits), birth_code), NOT_FIELDS)
    if codes is not None:
        kept = C.describe_codes(kept, SE.scan_codes(spark, codes))
    kept = materialise(kept.drop(SE.MALFORMED), "kept")
    broken = raw.where(~fits).select("split", F.col("source_row.file").alias("file"), SE.MALFORMED)
    SE.write_new(broken, f"{out}/malformed", rebase)

    scanned = SE.scan_cohort(spark, cohort, cohort_schema, {"split": SE.split_from_path(cohort)})
    subjects = kept.select("split", "subject_id").distinct()
    unpaired = scanned.select("split").distinct().join(subjects.select("split").distinct(), "split", "left_anti")
    labelled = C.drop_unlabelled(scanned, label)
    asked = labelled.select("split", "subject_id", F.col(label).alias("label"), F.col("prediction_time").alias("endtime"))
    asked = (asked if unpaired.isEmpty() else asked.drop("split")).distinct()
    asked, events = _in_splits(asked, subjects), keyed(kept)

    hot = find_hot(C.history_marks(events, asked), ["subject_id"])
    index = unkeyed(C.sample_index(events, asked, hot))
    index = index.withColumn("shard_id", C.shard_of("subject_id", shards))
    SE.write_new(index, f"{out}/index", rebase)

    placed = C.order_events(events, ["source_row"], hot).drop("source_row")
    tokens = K.tokenize(placed, ("subject_id", "time", "event_idx", "time_min"), max_tokens)
    written = unkeyed(tokens.select("subject_id", "time", "event_idx", "time_min", "tokens"))
    SE.write_new(written, f"{out}/events", rebase)

    index, events = spark.read.parquet(f"{out}/index"), keyed(spark.read.parquet(f"{out}/events").drop("time"))
    by_split = index.withColumn("in_split", F.col("split"))
    samples = Q.window_start(keyed(by_split), events, hours)
    if max_events is not None:
        tail = C.tail_of(samples, max_events)
        samples = tail if hours < 0 else tail.withColumn("from_idx", F.greatest(tail["from_idx"], samples["from_idx"]))
    joined = C.join_history(events, samples)
    nested = C.assemble_samples(joined, ["time_min", "tokens"], ("sample_id", "label", "in_split", "shard_id"))
    SS.write_samples(nested.withColumnRenamed("in_split", "split"), f"{out}/samples", rebase)
    SS.write_manifest(
        SS.manifest(index, shards), f"{out}/manifest", "overwrite" if rebase else "errorifexists"
    )


def encode_events(
    spark: SparkSession,
    processed: str,
    out: str,
    token_table: DataFrame,
    type_table: DataFrame,
    place_table: DataFrame,
    dim: int,
    vocabulary: DataFrame | None = None,
    rebase: bool = False,
) -> None:
    """One FLOAT vector per event, for all samples that share it; builds a vocabulary if none is given.

    Events that arrived in batches (``ingest_shards``) are those of the latest batch of each subject.

    Vectors lie in the order of subject and event. The tokens are brought into that order before
    they are encoded, since they are smaller than vectors.
    """
    events = spark.read.parquet(f"{processed}/events")
    events = (read_ingested(spark, processed, "events") if "batch" in events.columns else events).drop("time")
    if vocabulary is None:
        vocabulary = K.build_vocabulary(events.select(F.explode_outer("tokens.token").alias("token")))
    SE.write_new(vocabulary, f"{out}/vocabulary", rebase)
    vocabulary = spark.read.parquet(f"{out}/vocabulary")
    ordered = events.repartitionByRange("subject_id", "event_idx").sortWithinPartitions("subject_id", "event_idx")
    vectors = E.event_vectors(ordered, vocabulary, token_table, type_table, place_table, dim)
    SE.write_new(vectors.withColumn("repr", F.col("repr").cast("array<float>")), f"{out}/vectors", rebase)


@dataclass(frozen=True)
class Model:
    """What prediction needs: how to score events, the heads, and the fallback vector.

    Events are scored by ``scorer`` (layers, with the minutes before the sample's last event if
    ``scorer_use_time``) or by their closeness to ``query``.
    """

    heads: Mapping[str, tuple[str, H.Weights]]
    constant: Sequence[float]
    query: Sequence[float] | None = None
    scorer: Sequence[R.Layer] = field(default_factory=tuple)
    scorer_use_time: bool = False
    rejection_cutoff: float = 0.0
    max_retrieve_len: int = S.MAX_RETRIEVE_LEN


def retrieve(vectors: DataFrame, samples: DataFrame, model: Model) -> DataFrame:
    """``(sample_id, event_idx, score, repr)`` of the retrieved events of each sample."""
    real = R.mask_zero_vectors(vectors)
    if model.scorer and model.scorer_use_time:
        # The sample's last event gives the time, also if its own vector is padding.
        ends = samples.select("subject_id", "sample_id", "sample_no", "n_events")
        best = M.history_topk_timed(vectors, ends, model.scorer, model.max_retrieve_len, model.rejection_cutoff, zeros=False)
    else:
        scored = R.mlp_score(real, model.scorer, time=None) if model.scorer else R.cosine_scores(real, model.query)
        narrow = R.reject_below(scored.select("subject_id", "event_idx", "score"), model.rejection_cutoff)
        hot = find_hot(vectors.select("subject_id"), ["subject_id"])
        best = R.history_topk(narrow, samples, model.max_retrieve_len, hot=hot)
    best = materialise(best, "retrieved")
    won = best.select("subject_id", "event_idx").distinct()
    chosen = vectors.join(won, ["subject_id", "event_idx"], "left_semi").select("subject_id", "event_idx", "time_min", "repr")
    return best.join(chosen, ["subject_id", "event_idx"])


def _scores(spark, encoded: str, samples: DataFrame, model: Model, task: str) -> DataFrame:
    """``(subject_id, sample_no, boolean_prediction)`` of samples that are keyed."""
    one = samples.withColumn("sample_id", F.concat_ws("_", "subject_id", F.col("sample_no").cast("string")))
    retrieved = retrieve(keyed(spark.read.parquet(f"{encoded}/vectors")), one, model)
    pooled = E.mean_pool(retrieved, ["sample_id"], "repr")
    ready = R.empty_retrieval_fallback(one.select("sample_id", "subject_id", "sample_no"), pooled, "sample_id", model.constant)
    return H.linear_heads(ready, model.heads).select(
        "subject_id", "sample_no", F.col(task)[0].alias("boolean_prediction")
    )


def predict_cohort(
    spark: SparkSession,
    processed: str,
    encoded: str,
    model: Model,
    out: str | None = None,
    split: str | None = None,
    task: str = S.SINGLE_TASK,
    rebase: bool = False,
    test_cohort: str | DataFrame | None = None,
    label: str = "boolean_value",
    check_ids: bool = True,
) -> DataFrame:
    """A cohort with ``boolean_prediction`` and ``predicted_label``.

    Without a ``test_cohort`` it is the samples of the split. A test cohort keeps all its rows: one with history
    has a prediction whether it is labelled or not, one without any event before its time has null. ``check_ids``
    makes it an error if its labelled rows with history are not just the samples of the split.
    """
    index = spark.read.parquet(f"{processed}/index")
    events = spark.read.parquet(f"{processed}/events")
    if split is not None:
        index, events = index.where(F.col("split") == split), events.where(F.col("split") == split)
    columns = ["subject_id", "prediction_time", "boolean_value", "boolean_prediction", "predicted_label"]
    if test_cohort is None:
        samples = keyed(index)
        scores = _scores(spark, encoded, samples, model, task)
        cohort = samples.select(
            "subject_id", "sample_no", F.col("endtime").alias("prediction_time"), F.col("label").alias("boolean_value")
        )
        result = unkeyed(cohort.join(scores, ["subject_id", "sample_no"], "left"))
    else:
        given = SE.scan_test_cohort(spark, test_cohort) if isinstance(test_cohort, str) else test_cohort
        given = given.withColumnRenamed(label, "boolean_value") if label != "boolean_value" else given
        given = given.withColumn("prediction_time", F.col("prediction_time").cast("timestamp_ntz"))
        kind = index.schema["label"].dataType
        asked = given.select("subject_id", F.col("prediction_time").alias("endtime")).distinct()
        asked = asked.withColumn("label", F.lit(None).cast(kind))
        history = keyed(events.select("split", "subject_id", "time"))
        asked = _in_splits(asked, events.select("split", "subject_id").distinct())
        samples = materialise(C.sample_index(history, asked), "index")
        if check_ids:
            _same_ids(index, given, unkeyed(samples))
        scores = unkeyed(samples.join(_scores(spark, encoded, samples, model, task), ["subject_id", "sample_no"]))
        scores = scores.select("subject_id", F.col("endtime").alias("prediction_time"), "boolean_prediction")
        result = given.join(scores, ["subject_id", "prediction_time"], "left")
    result = P.predicted_label(result).select(*columns)
    if out is not None:
        SS.write_predictions(result, out, rebase)
        return spark.read.parquet(out)
    return result


def _same_ids(index: DataFrame, given: DataFrame, samples: DataFrame) -> None:
    """The labelled rows of a cohort that have a history, against the samples."""
    stamp = lambda time: F.concat_ws("_", F.col("subject_id").cast("string"), F.col(time).cast("string")).alias("sample_id")
    labelled = given.where(F.col("boolean_value").isNotNull()).withColumnRenamed("prediction_time", "endtime")
    known = labelled.join(samples.select("subject_id", "endtime"), ["subject_id", "endtime"], "left_semi")
    differ = P.check_id_sets(index.select(stamp("endtime")), known.select(stamp("endtime")))
    found = differ.groupBy("found_in").agg(F.count(F.lit(1)).alias("n")).collect()
    if found:
        text = ", ".join(f"{r['n']} only in the {r['found_in']}" for r in found)
        raise ValueError(f"the cohort and the processed samples differ: {text}")
