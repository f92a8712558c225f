"""Text, tokens and vocabulary on hand-made values."""

from pyspark.sql import functions as F

from anamnesis import settings as S
from anamnesis.functions import text as T
from anamnesis.operators import tokens as K


def values(spark, items, expression, dtype="STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i INT, v {dtype}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_digit_places(spark):
    got = values(spark, ["12345.6789", "12345", "7.5", "...", ".", "5."], T.digit_place_ids)
    assert got == [
        [10, 9, 8, 7, 6, 5, 4, 3, 2, 1],
        [10, 9, 8, 7, 6],
        [6, 5, 4],
        [0, 0, 0],
        [5],
        [6, 5],
    ]


def test_number_spans(spark):
    got = values(spark, ["a1.25 b...c 1.2.3", "none"], T.number_spans)
    assert got == [["1.25", "...", "1.2", ".", "3"], []]


def test_spaced_digits(spark):
    assert values(spark, ["a1.25"], T.space_digits) == ["a 1  .  2  5 "]


def test_decimals_in_text_are_rounded(spark):
    got = values(spark, ["x1.23456y.5 10.0", "12", "192.168.1.1"], T.round_decimals)
    assert got == ["x1.2346y0.5 10.0", "12", "192.1680.10.1"]


def test_plain_decimal_text(spark):
    got = values(spark, [10.0, 6.55, 12345678.9, 1e-7, -3.14159, 0.0], T.decimal_text, "DOUBLE")
    assert got == ["10.0", "6.55", "12345678.9", "0.0", "-3.1416", "0.0"]
    assert values(spark, [None, float("nan")], T.decimal_text, "DOUBLE") == [None, "nan"]


ROW = "subject_id BIGINT, time STRING, code STRING, numeric_value DOUBLE, note STRING, width STRING, flag BOOLEAN"


def event(spark, *row):
    return spark.createDataFrame([(1, "t", *row)], ROW)


def test_event_text_skips_nulls_and_leaves_ids_alone(spark):
    df = event(spark, "HR2", 71.5, None, "3.14159", True)
    text = K.textify(df).first().text
    assert text == "code HR2 numeric_value  7  1  .  5  width 3.14159 flag True"
    assert K.textify(event(spark, None, None, None, None, None)).isEmpty()


def test_tokens_types_and_places(spark):
    tokens = K.tokenize(event(spark, "HR", 71.5, None, "3.1", None)).first().tokens
    assert [(t.token, t.type_id, t.dpe_id) for t in tokens] == [
        ("[CLS]", 5, 0),
        ("code", 2, 0),
        ("HR", 3, 0),
        ("numeric", 2, 0),
        ("_", 2, 0),
        ("value", 2, 0),
        ("7", 3, 7),
        ("1", 3, 6),
        (".", 3, 5),
        ("5", 3, 4),
        ("width", 2, 0),
        ("3", 3, 0),
        (".", 3, 0),
        ("1", 3, 0),
        ("[SEP]", 6, 0),
    ]


def test_tokens_equal_the_words_of_the_text(spark):
    df = event(spark, "a-b", 0.25, "dose 12.5mg x...3, é5", None, False)
    tokens = K.tokenize(df).first().tokens
    words = K.textify(df).select(T.words(F.col("text")).alias("w")).first().w
    assert [t.token for t in tokens][1:-1] == words


def test_long_events_are_cut_with_the_separator_last(spark):
    df = event(spark, "x", None, "9" * 200, None, None)
    tokens = K.tokenize(df).first().tokens
    assert len(tokens) == 128
    assert tokens[0].token == "[CLS]" and tokens[-1].token == "[SEP]"
    assert tokens[126].token == "9" and tokens[126].dpe_id > 0


def test_padding_fills_with_zeros(spark):
    df = K.tokenize(event(spark, "x", None, None, None, None))
    padded = df.select(T.pad_event(F.col("tokens")).alias("p")).first().p
    assert len(padded) == 128
    assert {(t.token, t.type_id, t.dpe_id) for t in padded[4:]} == {("[PAD]", 0, 0)}


def test_vocabulary_ranks_by_count_and_the_rest_is_unknown(spark):
    words = ["b"] * 3 + ["a"] * 3 + ["c"] * 5 + ["d"] + ["[CLS]"] * 9
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "token STRING, pos INT")
    vocabulary = K.build_vocabulary(rows, size=S.FIRST_WORD_ID + 3)
    assert {(r.token, r.n, r.token_id) for r in vocabulary.collect()} == {
        ("c", 5, 104),
        ("a", 3, 105),
        ("b", 3, 106),
    }
    ids = {r.token: r.token_id for r in K.token_ids(rows, vocabulary).collect()}
    assert ids == {"c": 104, "a": 105, "b": 106, "d": 100, "[CLS]": 101}
