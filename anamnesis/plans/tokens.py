"""Text and token queries on events, documents and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from anamnesis.functions import text as T
from anamnesis.operators import tokens as K
from anamnesis.plans import fixtures as X
from anamnesis.registry import register_operator as query
from anamnesis.sources.workspace import spread

NOT_FIELDS = ("subject_id", "time")
NOT_FIELDS_OR_IDS = (*NOT_FIELDS, "event_id")


def document_text(spark, sf_dir):
    return spread(X.table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenized(spark, sf_dir, not_fields=NOT_FIELDS):
    return K.tokenize(spread(X.kept(spark, sf_dir)), not_fields)


# --- SQL building blocks -----------------------------------------------------------------

WORD = T.WORD
NUMBER = T.NUMBER
PIECE = T.PIECE


def words_sql(text: str, type_id: int) -> str:
    return (
        f"list_transform(regexp_extract_all({text}, '{WORD}'), "
        f"lambda t: {{'token': t, 'type_id': {type_id}, 'dpe_id': 0}})"
    )


def place_sql(number: str, index: str) -> str:
    return (
        f"CASE WHEN regexp_matches({number}, '^\\.{{2,}}$') THEN 0 "
        f"ELSE CAST((CASE WHEN instr({number}, '.') > 0 THEN instr({number}, '.') - 1 "
        f"ELSE length({number}) END) + 5 - {index} AS INTEGER) END"
    )


def value_sql(text: str) -> str:
    digits = (
        "list_transform(range(length(p)), lambda i: "
        f"{{'token': p[i + 1], 'type_id': 3, 'dpe_id': {place_sql('p', 'i')}}})"
    )
    return (
        f"flatten(list_transform(regexp_extract_all({text}, '{PIECE}'), lambda p: "
        f"CASE WHEN regexp_matches(p, '^[0-9.]') THEN {digits} ELSE {words_sql('p', 3)} END))"
    )


def field_sql(name: str, text: str, verbatim: bool = False) -> str:
    value = words_sql(text, 3) if verbatim else value_sql(text)
    body = f"list_concat({words_sql(chr(39) + name + chr(39), 2)}, {value})"
    return f"CASE WHEN {text} IS NULL THEN [] ELSE {body} END"


def spaced_sql(text: str) -> str:
    return f"regexp_replace({text}, '([0-9.])', ' \\1 ', 'g')"


VALUE_TEXT = "CAST(round(numeric_value, 4) AS VARCHAR)"


def tokens_sql(with_id: bool) -> str:
    fields = [
        field_sql("code", "code", verbatim=True),
        field_sql("numeric_value", VALUE_TEXT),
        field_sql("props", "props"),
    ]
    if with_id:
        fields.append(field_sql("event_id", "CAST(event_id AS VARCHAR)", verbatim=True))
    body = fields[0]
    for field in fields[1:]:
        body = f"list_concat({body}, {field})"
    return X.KEPT_SQL + f""",
tokenized AS (
  SELECT *, list_concat(list_concat(
    [{{'token': '[CLS]', 'type_id': 5, 'dpe_id': 0}}],
    list_slice({body}, 1, 126)),
    [{{'token': '[SEP]', 'type_id': 6, 'dpe_id': 0}}]) AS tokens
  FROM kept)"""


ROWS_SQL = tokens_sql(False) + """,
token_rows AS (
  SELECT subject_id, event_id, pos - 1 AS pos, tokens[pos].token AS token,
         tokens[pos].type_id AS type_id, tokens[pos].dpe_id AS dpe_id
  FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS pos FROM tokenized))"""

VOCABULARY_SQL = """vocabulary AS (
  SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 103 AS token_id
  FROM (SELECT token, count(*) AS n FROM token_rows
        WHERE token NOT IN ('[PAD]', '[UNK]', '[CLS]', '[SEP]')
        GROUP BY token))"""

IDS_SQL = ROWS_SQL + ",\n" + VOCABULARY_SQL + """,
ids AS (
  SELECT r.*, coalesce(CASE r.token WHEN '[PAD]' THEN 0 WHEN '[UNK]' THEN 100 WHEN '[CLS]' THEN 101
                       WHEN '[SEP]' THEN 102 END, v.token_id, 100) AS token_id
  FROM token_rows r LEFT JOIN vocabulary v ON r.token = v.token)"""


def joined_text(tokens: str, field: str):
    return F.array_join(F.transform(F.col(tokens), lambda t: t[field].cast("string")), " ")


def joined_text_sql(field: str) -> str:
    return f"array_to_string(list_transform(tokens, lambda t: CAST(t.{field} AS VARCHAR)), ' ')"


def event_token_rows(spark, sf_dir):
    """Token rows of the events (without their id column)."""
    return K.token_rows(tokenized(spark, sf_dir, NOT_FIELDS_OR_IDS), ["subject_id", "event_id"])


def event_token_ids(spark, sf_dir):
    rows = event_token_rows(spark, sf_dir)
    return K.token_ids(rows, K.build_vocabulary(rows))


# --- queries -----------------------------------------------------------------------------


@query(
    "event_text",
    "WITH " + X.KEPT_SQL + f"""
SELECT event_id, concat_ws(' ', 'code ' || code, 'numeric_value ' || {spaced_sql(VALUE_TEXT)},
  'props ' || {spaced_sql('props')}, 'event_id ' || CAST(event_id AS VARCHAR)) AS text FROM kept""",
)
def event_text(spark, sf_dir):
    return K.textify(X.kept(spark, sf_dir), NOT_FIELDS).select("event_id", "text")


ROUNDED_SQL = r"""array_to_string(list_transform(
  list_zip(string_split_regex(text, '\d*\.\d+'),
           list_concat(list_transform(regexp_extract_all(text, '\d*\.\d+'),
             lambda n: CAST(round(CAST(n AS DOUBLE), 4) AS VARCHAR)), [''])),
  lambda z: z[1] || z[2]), '')"""


@query("round_decimals_in_text", f"SELECT doc_id, {ROUNDED_SQL} AS text FROM documents")
def round_decimals_in_text(spark, sf_dir):
    return document_text(spark, sf_dir).select("doc_id", T.round_decimals(F.col("text")).alias("text"))


@query("space_digits", f"SELECT doc_id, {spaced_sql('text')} AS text FROM documents")
def space_digits(spark, sf_dir):
    return document_text(spark, sf_dir).select("doc_id", T.space_digits(F.col("text")).alias("text"))


@query(
    "id_columns_verbatim",
    "WITH " + X.KEPT_SQL + f"""
SELECT CAST(event_id AS VARCHAR) AS verbatim, {spaced_sql('CAST(event_id AS VARCHAR)')} AS spaced FROM kept""",
)
def id_columns_verbatim(spark, sf_dir):
    """The id column as the rule on names leaves it, and as an own list of names would treat it."""
    events = X.kept(spark, sf_dir).select("event_id")
    by_name = T.event_fields(events.schema)[0]
    spaced = T.event_fields(events.schema, verbatim=lambda name: False)[0]
    return events.select(by_name.text.alias("verbatim"), spaced.text.alias("spaced"))


@query(
    "number_spans",
    f"""SELECT doc_id, pos - 1 AS pos, spans[pos] AS number
FROM (SELECT doc_id, spans, unnest(range(1, len(spans) + 1)) AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, '{NUMBER}') AS spans FROM documents))""",
)
def number_spans(spark, sf_dir):
    spans = T.number_spans(F.col("text"))
    rows = document_text(spark, sf_dir).select("doc_id", F.posexplode_outer(spans).alias("pos", "number"))
    return rows.where(F.col("pos").isNotNull()).withColumn("pos", F.col("pos").cast("bigint"))


PRICES_SQL = """prices AS (
  SELECT o_orderkey AS key, 0 AS line, CAST(o_totalprice AS VARCHAR) AS price FROM orders
  UNION ALL SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS VARCHAR) FROM lineitem)"""


@query(
    "digit_place_ids",
    "WITH " + PRICES_SQL + f"""
SELECT key, line, price, array_to_string(list_transform(range(length(price)),
  lambda i: CAST({place_sql('price', 'i')} AS VARCHAR)), ',') AS places FROM prices""",
)
def digit_place_ids(spark, sf_dir):
    orders = X.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.lit(0).alias("line"), F.col("o_totalprice").alias("price")
    )
    items = X.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price")
    )
    prices = spread(orders.unionByName(items)).withColumn("price", T.decimal_text(F.col("price")))
    places = F.array_join(T.digit_place_ids(F.col("price")).cast("array<string>"), ",")
    return prices.withColumn("places", places)


@query(
    "token_type_ids",
    "WITH " + tokens_sql(True) + f"""
SELECT event_id, {joined_text_sql('type_id')} AS type_ids, {joined_text_sql('dpe_id')} AS dpe_ids FROM tokenized""",
)
def token_type_ids(spark, sf_dir):
    events = tokenized(spark, sf_dir)
    return events.select(
        "event_id",
        joined_text("tokens", "type_id").alias("type_ids"),
        joined_text("tokens", "dpe_id").alias("dpe_ids"),
    )


@query(
    "tokenize_events",
    "WITH " + tokens_sql(True) + f" SELECT event_id, {joined_text_sql('token')} AS tokens FROM tokenized",
)
def tokenize_events(spark, sf_dir):
    events = tokenized(spark, sf_dir)
    return events.select("event_id", joined_text("tokens", "token").alias("tokens"))


@query(
    "build_vocabulary",
    f"""WITH token_rows AS (
  SELECT unnest(regexp_extract_all(text, '{WORD}')) AS token FROM documents),
""" + VOCABULARY_SQL + " SELECT token, n, token_id FROM vocabulary",
)
def build_vocabulary(spark, sf_dir):
    rows = document_text(spark, sf_dir).select(F.explode_outer(T.words(F.col("text"))).alias("token"))
    return K.build_vocabulary(rows).withColumn("token_id", F.col("token_id").cast("bigint"))


@query(
    "token_ids",
    "WITH " + IDS_SQL + " SELECT event_id, pos, token, CAST(token_id AS BIGINT) AS token_id FROM ids",
)
def token_ids(spark, sf_dir):
    return event_token_ids(spark, sf_dir).select(
        "event_id", F.col("pos").cast("bigint").alias("pos"), "token", F.col("token_id").cast("bigint").alias("token_id")
    )


@query(
    "pad_events",
    "WITH " + tokens_sql(True) + f"""
SELECT event_id, CAST(128 AS BIGINT) AS n,
       {joined_text_sql('token')} || repeat(' [PAD]', 128 - CAST(len(tokens) AS INTEGER)) AS tokens FROM tokenized""",
)
def pad_events(spark, sf_dir):
    events = tokenized(spark, sf_dir)
    padded = events.withColumn("tokens", T.pad_event(F.col("tokens")))
    return padded.select(
        "event_id", F.size("tokens").cast("bigint").alias("n"), joined_text("tokens", "token").alias("tokens")
    )


@query(
    "truncate_tokens",
    f"""WITH cut AS (
  SELECT doc_id, list_concat(list_concat(['[CLS]'],
    list_slice(list_concat(['text'], regexp_extract_all({spaced_sql(ROUNDED_SQL)}, '{WORD}')), 1, 126)), ['[SEP]']) AS tokens
  FROM documents)
SELECT doc_id, len(tokens) AS n, array_to_string(tokens, ' ') AS tokens FROM cut""",
)
def truncate_tokens(spark, sf_dir):
    documents = K.tokenize(document_text(spark, sf_dir), ("doc_id",))
    return documents.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n"), joined_text("tokens", "token").alias("tokens")
    )


@query(
    "event_token_count",
    "WITH " + tokens_sql(True) + """
SELECT code, count(*) AS n_events, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens FROM tokenized GROUP BY code""",
)
def event_token_count(spark, sf_dir):
    events = tokenized(spark, sf_dir)
    return events.groupBy("code").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.size("tokens")).alias("n_tokens")
    )
