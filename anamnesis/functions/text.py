"""Event text: plain decimal numbers, digit spacing, digit places, word tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

from anamnesis import settings as S

# Patterns that decide the text and its tokens.
DECIMAL = r"\d*\.\d+"
NUMBER = r"[0-9]+(?:[.][0-9]*)?|\.+"
PIECE = r"[0-9]+(?:[.][0-9]*)?|\.+|[^0-9.]+"
WORD = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def decimal_text(number: Column) -> Column:
    """A DOUBLE rounded to 4 places as plain decimal text with at least one decimal."""
    rounded = F.round(number, 4)
    plain = rounded.try_cast("decimal(38,4)").cast("string")
    short = F.regexp_replace(plain, r"0{1,3}$", "")
    return (
        F.when(F.isnan(number), F.lit("nan"))
        .otherwise(F.coalesce(short, rounded.cast("string")))
    )


def round_decimals(text: Column) -> Column:
    """Round every decimal number inside a text to 4 places."""
    between = F.split(text, DECIMAL, -1)
    numbers = F.transform(
        F.regexp_extract_all(text, F.lit(DECIMAL), F.lit(0)),
        lambda n: decimal_text(n.cast("double")),
    )
    numbers = F.concat(numbers, F.array(F.lit("")))
    rounded = F.array_join(F.zip_with(between, numbers, lambda b, n: F.concat(b, n)), "")
    return F.when(text.rlike(DECIMAL), rounded).otherwise(text)


def space_digits(text: Column) -> Column:
    """Put a space on both sides of each digit and point."""
    return F.regexp_replace(text, r"([0-9.])", " $1 ")


def number_spans(text: Column) -> Column:
    """The numbers (and runs of points) of a text, in order."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def _place(number: Column, index: Column) -> Column:
    """Place id of the 0-based character: 6 for units, 7 for tens, 5 for the point, 4 for tenths.

    A place that the place table has no id for (below 1, 100 and above) is 0, which has no vector.
    """
    point = F.instr(number, ".")
    whole = F.when(point > 0, point - 1).otherwise(F.length(number))
    place = whole + S.POINT_PLACE - index
    known = ~number.rlike(r"^\.{2,}$") & place.between(1, S.NUM_PLACES - 1)
    return F.when(known, place).otherwise(F.lit(0))


def digit_place_ids(number: Column) -> Column:
    """Place ids of all characters of one number."""
    return F.transform(F.split(number, ""), lambda c, i: _place(number, i).cast("int"))


def words(text: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _tagged(tokens: Column, type_id: int) -> Column:
    return F.transform(tokens, lambda t: _token(t, F.lit(type_id), F.lit(0)))


def _token(token: Column, type_id: Column, place: Column) -> Column:
    return F.struct(
        token.alias("token"), type_id.cast("int").alias("type_id"), place.cast("int").alias("dpe_id")
    )


def name_tokens(name: str) -> Column:
    """Tokens of a field name, a constant of the plan."""
    found = re.findall(r"[^\W_]+|[^\w\s]|_", name)
    return F.array(*[_token(F.lit(t), F.lit(S.TYPE_NAME), F.lit(0)) for t in found])


def value_tokens(text: Column) -> Column:
    """Tokens of a value; each digit or point is a token with its place id."""

    def piece_tokens(piece: Column) -> Column:
        digits = F.transform(
            F.split(piece, ""),
            lambda c, i: _token(c, F.lit(S.TYPE_VALUE), _place(piece, i)),
        )
        return F.when(piece.rlike(r"^[0-9.]"), digits).otherwise(_tagged(words(piece), S.TYPE_VALUE))

    return F.flatten(
        F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), piece_tokens)
    )


def plain_text(name: str, dtype: T.DataType) -> Column:
    """The text form of a column before any digit treatment."""
    column = F.col(f"`{name}`")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return decimal_text(column.cast("double"))
    if isinstance(dtype, T.BooleanType):
        return F.initcap(column.cast("string"))
    return column.cast("string")


#: Types whose text holds no decimal number, or has been rounded already.
_WHOLE = (T.IntegralType, T.BooleanType, T.DateType, T.DoubleType, T.FloatType)


class EventField:
    """One field of an event, its name and how its value is written and tokenised."""

    def __init__(self, name: str, dtype: T.DataType, verbatim: bool) -> None:
        self.name = name
        self.present = F.col(f"`{name}`").isNotNull()
        text = plain_text(name, dtype)
        if not verbatim and not isinstance(dtype, _WHOLE):
            text = round_decimals(text)
        self.text = text if verbatim else space_digits(text)
        self.tokens = _tagged(words(text), S.TYPE_VALUE) if verbatim else value_tokens(text)


def has_id_in_name(name: str) -> bool:
    return "id" in name


def event_fields(
    schema: T.StructType,
    not_fields: Sequence[str] = ("subject_id", "time"),
    verbatim: Callable[[str], bool] = has_id_in_name,
) -> list[EventField]:
    """Fields in text order: the code, its number, then the other columns as they come."""
    first = [c for c in ("code", "numeric_value") if c in schema.names]
    rest = [c for c in schema.names if c not in (*first, *not_fields)]
    return [
        EventField(name, schema[name].dataType, name == "code" or verbatim(name))
        for name in first + rest
    ]


def event_text(fields: Sequence[EventField]) -> Column:
    """``name value`` of every field that is not null, joined by one space; null if all are."""
    text = F.concat_ws(
        " ", *[F.when(f.present, F.concat(F.lit(f.name + " "), f.text)) for f in fields]
    )
    return F.nullif(text, F.lit(""))


def event_tokens(fields: Sequence[EventField], max_tokens: int = S.MAX_EVENT_TOKENS) -> Column:
    """Typed tokens of an event: CLS, at most ``max_tokens - 2`` field tokens, SEP."""
    no_tokens = F.array().cast("array<struct<token:string,type_id:int,dpe_id:int>>")
    body = F.concat(
        *[
            F.coalesce(
                F.when(
                    f.present,
                    F.concat(name_tokens(f.name), f.tokens),
                ),
                no_tokens,
            )
            for f in fields
        ]
    )
    return F.concat(
        F.array(_token(F.lit(S.TOKEN_CLS), F.lit(S.TYPE_CLS), F.lit(0))),
        F.slice(body, 1, max_tokens - 2),
        F.array(_token(F.lit(S.TOKEN_SEP), F.lit(S.TYPE_SEP), F.lit(0))),
    )


def pad_event(tokens: Column, max_tokens: int = S.MAX_EVENT_TOKENS) -> Column:
    """Fill the tokens of an event up to the fixed length."""
    empty = _token(F.lit(S.TOKEN_PAD), F.lit(S.TYPE_PAD), F.lit(0))
    return F.concat(tokens, F.array_repeat(empty, F.lit(max_tokens) - F.size(tokens)))
