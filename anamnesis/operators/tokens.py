"""Token tables and the vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis import settings as S
from anamnesis.functions.text import event_fields, event_text, event_tokens
from anamnesis.operators.skew import HotGroups, attach, find_hot, hot_rows, running


def textify(events: DataFrame, not_fields: Sequence[str] = ("subject_id", "time"), **options) -> DataFrame:
    """Add the text of each event; events whose fields are all null are dropped."""
    fields = event_fields(events.schema, not_fields, **options)
    return events.withColumn("text", event_text(fields)).where(F.col("text").isNotNull())


def drop_empty_events(events: DataFrame, not_fields: Sequence[str] = ("subject_id", "time")) -> DataFrame:
    """Drop events whose fields are all null, before they are numbered."""
    return events.dropna(how="all", subset=[c for c in events.columns if c not in not_fields])


def tokenize(
    events: DataFrame,
    not_fields: Sequence[str] = ("subject_id", "time"),
    max_tokens: int = S.MAX_EVENT_TOKENS,
    **options,
) -> DataFrame:
    """Add ``tokens``: typed tokens of the event between CLS and SEP."""
    fields = event_fields(events.schema, not_fields, **options)
    return events.withColumn("tokens", event_tokens(fields, max_tokens))


def token_rows(events: DataFrame, keys: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """Long token table ``(keys, pos, token, type_id, dpe_id)``.

    An event has CLS and SEP at least, so the outer form adds no row; the inner form would
    make Spark tokenise each event once more, to filter on the number of tokens.
    """
    return events.select(*keys, F.posexplode_outer(tokens).alias("pos", "__t")).select(
        *keys, "pos", "__t.token", "__t.type_id", "__t.dpe_id"
    )



def build_vocabulary(rows: DataFrame, size: int | None = None) -> DataFrame:
    """All distinct tokens with their ids, the most frequent first; ids below ``FIRST_WORD_ID`` are reserved.

    With ``size`` only the ids below it, for a vocabulary of a given size.

    The rank over all distinct tokens is a running count over range-ordered segments.
    """
    counted = (
        rows.where(~F.col("token").isin(*S.SPECIAL_TOKEN_IDS))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running(
        counted, [], [F.desc("n"), "token"], {"__rank": ("sum", F.lit(1).cast("bigint"), False)}
    )
    words = ranked.withColumn("token_id", (F.col("__rank") + S.FIRST_WORD_ID).cast("int"))
    words = words if size is None else words.where(F.col("token_id") < size)
    return words.select("token", "n", "token_id")


def token_ids(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add ``token_id``: reserved ids, vocabulary ids, and the unknown id for the rest.

    Frequent tokens are hot keys of the join. Where the vocabulary has their counts ``n``, they are known
    without counting the rows; their entries are few and broadcast, the rest is an ordinary join.
    """
    words = vocabulary.select("token", F.col("token_id").alias("__word_id"))
    reserved = F.lit(None).cast("int")
    for token, token_id in S.SPECIAL_TOKEN_IDS.items():
        reserved = F.when(F.col("token") == token, F.lit(token_id)).otherwise(reserved)
    if "n" in vocabulary.columns:
        frequent = vocabulary.where(F.col("n") > hot_rows(rows.sparkSession))
        hot = HotGroups(frequent.select("token", F.col("n").alias("__n")), ["token"])
    else:
        hot = find_hot(rows, ["token"])
    unknown = F.lit(S.SPECIAL_TOKEN_IDS[S.TOKEN_UNK])
    found = attach(rows, words, ["token"], "left", hot)
    return found.withColumn("token_id", F.coalesce(reserved, F.col("__word_id"), unknown)).drop("__word_id")
