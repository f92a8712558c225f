"""Event vectors: embedding lookup, pooling, and the plug-in encoder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anamnesis import settings as S
from anamnesis.functions.arrays import all_zero
from anamnesis.operators.skew import attach
from anamnesis.operators.tokens import token_ids, token_rows
from anamnesis.sources.workspace import materialise, send_code


#: Bytes of all tables together that ``event_vectors`` sends to the executors; larger ones go in blocks of ids.
MAX_TABLE_BYTES = 512 << 20
#: Bytes of a block of ids, and of the vectors of the most frequent tokens.
BLOCK_BYTES = 64 << 20
#: (event, token) rows that meet a copy of a block at once.
BLOCK_ROWS = 2_000_000


def _known_ids(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """An embedding table; id 0 is padding and adds nothing."""
    known = table.where(F.col(id_column) > 0)
    return known.select(id_column, F.col("embedding").cast("array<double>").alias(vector))


def _add_known(left: Column, right: Column) -> Column:
    return F.coalesce(F.zip_with(left, right, lambda a, b: a + b), left, right)


def token_embedding_lookup(
    tokens: DataFrame,
    token_table: DataFrame,
    type_table: DataFrame,
    place_table: DataFrame,
    dim: int,
) -> DataFrame:
    """Add ``vector``: the sum of token, type and digit-place vectors.

    Type and place vectors are added up once per pair of ids; that table has a fixed size and is broadcast. The result
    has a vector per token; ``token_sums`` adds them up per event without making them.
    """
    ids = tokens.sparkSession.range(S.NUM_TYPES * S.NUM_PLACES)
    pairs = (
        ids.select(
            F.floor(F.col("id") / S.NUM_PLACES).cast("int").alias("type_id"),
            (F.col("id") % S.NUM_PLACES).cast("int").alias("dpe_id"),
        )
        .join(_known_ids(type_table, "type_id", "__b"), "type_id", "left")
        .join(_known_ids(place_table, "dpe_id", "__c"), "dpe_id", "left")
        .select("type_id", "dpe_id", _add_known(F.col("__b"), F.col("__c")).alias("__pair"))
    )
    words = _known_ids(token_table, "token_id", "__word")
    # Frequent tokens are hot keys, which meet their vectors on a route of their own.
    joined = attach(tokens, words, ["token_id"], "left").join(F.broadcast(pairs), ["type_id", "dpe_id"], "left")
    nothing = F.array_repeat(F.lit(0.0), dim)
    total = F.coalesce(_add_known(F.col("__word"), F.col("__pair")), nothing)
    return joined.withColumn("vector", total).drop("__word", "__pair")


def mean_pool(df: DataFrame, keys: Sequence[str], vector: str, skip_zero: bool = True) -> DataFrame:
    """Element-wise mean per group; rows are combined into one buffer before the shuffle."""
    rows = df.where(~all_zero(F.col(vector))) if skip_zero else df
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return rows.groupBy(*keys).agg(mean.alias("__mean")).select(
        *keys, vector_to_array("__mean").alias("pooled")
    )


def first_pool(df: DataFrame, keys: Sequence[str], vector: str, order: str) -> DataFrame:
    """The vector of the first row per group."""
    return df.groupBy(*keys).agg(F.min_by(vector, order).alias("pooled"))


def _table_bytes(table: DataFrame, id_column: str, dim: int) -> int:
    largest = table.where(F.col(id_column) > 0).agg(F.max(id_column)).first()[0] or 0
    return (largest + 1) * dim * 4


def _vocabulary_bytes(vocabulary: DataFrame) -> int:
    return vocabulary.agg(F.sum(F.octet_length("token") + 12)).first()[0] or 0


def _matrix(table: DataFrame, id_column: str, dim: int) -> np.ndarray:
    """An embedding table as a matrix by id, with zeros for ids it lacks."""
    known = table.where(F.col(id_column) > 0).select(id_column, "embedding")
    rows = known.toArrow()
    largest = pc.max(rows.column(id_column)).as_py() or 0
    matrix = np.zeros((largest + 1, dim), dtype=np.float32)
    if rows.num_rows:
        matrix[rows.column(id_column).to_numpy()] = _stacked(rows.column("embedding"), dim)
    return matrix


def _stacked(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dim)


def _rows(matrix: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Vectors by id; an id that the table lacks has none, as in a left join."""
    return matrix[np.where((ids >= 0) & (ids < len(matrix)), ids, 0)]


def _word_ids(vocabulary: DataFrame) -> tuple[pa.Array, np.ndarray]:
    rows = vocabulary.select("token", "token_id").toArrow()
    words = list(S.SPECIAL_TOKEN_IDS) + rows.column("token").to_pylist()
    ids = list(S.SPECIAL_TOKEN_IDS.values()) + rows.column("token_id").to_pylist()
    return pa.array(words, pa.string()), np.array(ids)


def _sums(groups: np.ndarray, vectors: np.ndarray, count: int) -> np.ndarray:
    """Sums of the rows of ``vectors`` by ``groups``, which ascend."""
    out = np.zeros((count, vectors.shape[1]))
    if len(groups):
        starts = np.flatnonzero(np.append(True, np.diff(groups) != 0))
        out[groups[starts]] = np.add.reduceat(vectors, starts, axis=0)
    return out


def token_sums(
    events: DataFrame,
    key: str,
    vocabulary: DataFrame,
    token_table: DataFrame,
    type_table: DataFrame,
    place_table: DataFrame,
    dim: int,
    tokens_column: str = "tokens",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(key, vector, n_tokens)``: the sum of the token, type and digit-place vectors of each event, for tables of any size.

    It is the product of a sparse matrix (event, token, times) with the token table, in blocks. The vectors of the most
    frequent tokens (``block_bytes`` of them) and of types and places are broadcast and added up in one pass over the events.
    The other tokens are counted per event and meet the table in blocks of ids of ``block_bytes``; a block with many rows has
    several copies, for ``BLOCK_ROWS`` rows each. What leaves is one sum per event and block, never a vector per token.
    ``key`` tells events apart.
    """
    spark = events.sparkSession
    send_code(spark)
    rows = token_ids(token_rows(events, [key], tokens_column), vocabulary)
    listed = F.collect_list(F.struct("token_id", "type_id", "dpe_id")).alias("ids")
    nested = materialise(rows.groupBy(key).agg(listed), "ids")
    token = F.explode("ids.token_id").alias("token_id")
    known = token_table.where(F.col("token_id") > 0).select("token_id", "embedding")
    per_block = max(1, block_bytes // (dim * 4))
    counts = nested.select(token).where("token_id > 0").groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "token_id").limit(per_block).join(known, "token_id").orderBy("token_id").toArrow()
    frequent = top.column("token_id").to_numpy(), _stacked(top.column("embedding"), dim)
    fixed = _matrix(type_table, "type_id", dim), _matrix(place_table, "dpe_id", dim)
    shared = spark.sparkContext.broadcast((frequent, fixed))
    kind = events.schema[key].dataType.simpleString()

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, vectors), (by_type, by_place) = shared.value
        step = max(1, VALUES_AT_ONCE // (dim * S.MAX_EVENT_TOKENS))
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                lists = batch.column(1)
                flat = lists.flatten()
                ids, types, places = (flat.field(c).to_numpy() for c in ("token_id", "type_id", "dpe_id"))
                values = _rows(by_type, types).astype(np.float64) + _rows(by_place, places)
                at = np.minimum(np.searchsorted(names, ids), max(len(names) - 1, 0))
                hit = names[at] == ids if len(names) else np.zeros(len(ids), dtype=bool)
                values[hit] += vectors[at[hit]]
                lengths = pc.list_value_length(lists).to_numpy()
                sums = _sums(np.repeat(np.arange(len(lengths)), lengths), values, len(lengths))
                yield pa.record_batch([batch.column(0), _listed(sums), pa.array(lengths.astype(np.int64))], names=[key, "vector", "n_tokens"])

    base = nested.mapInArrow(near, f"`{key}` {kind}, vector array<double>, n_tokens long")
    often = F.broadcast(spark.createDataFrame([(int(i),) for i in frequent[0]], "token_id int"))
    rare = nested.select(key, token).where("token_id > 0").join(often, "token_id", "left_anti")
    rare = rare.groupBy(key, "token_id").agg(F.count(F.lit(1)).alias("times"))
    rare = materialise(rare.withColumn("block", F.floor(F.col("token_id") / per_block)), "rare")
    sizes = rare.groupBy("block").agg((F.floor(F.count(F.lit(1)) / BLOCK_ROWS) + 1).cast("int").alias("parts"))
    sizes = materialise(sizes, "blocks")
    if sizes.isEmpty():
        return base
    placed = rare.join(sizes, "block").select(key, "token_id", "times", "block", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"))
    copies = sizes.select(F.col("block").alias("__block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("__part"))
    table = known.join(copies, F.floor(F.col("token_id") / per_block) == F.col("__block"))
    table = table.select("token_id", "embedding", "__block", "__part")

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("token_id").to_numpy())
        names = right.column("token_id").to_numpy()[order]
        vectors = _stacked(right.column("embedding"), dim)[order] if len(names) else np.zeros((0, dim))
        ids = left.column("token_id").to_numpy()
        at = np.minimum(np.searchsorted(names, ids), max(len(names) - 1, 0))
        hit = np.flatnonzero(names[at] == ids) if len(names) else np.zeros(0, dtype=np.int64)
        events = left.column(key).combine_chunks().take(pa.array(hit)).dictionary_encode()
        group = events.indices.to_numpy()
        order = np.argsort(group, kind="stable")
        times = left.column("times").to_numpy()[hit[order]][:, None]
        sums = np.zeros((len(events.dictionary), dim))
        step = max(1, VALUES_AT_ONCE // dim)
        for low in range(0, len(order), step):
            own = order[low : low + step]
            values = vectors[at[hit[own]]] * times[low : low + step]
            starts = np.flatnonzero(np.append(True, np.diff(group[own]) != 0))
            sums[group[own[starts]]] += np.add.reduceat(values, starts, axis=0)
        return pa.table({key: events.dictionary, "vector": _listed(sums), "n_tokens": pa.array(np.zeros(len(sums), dtype=np.int64))})

    far = placed.groupBy("block", "part").cogroup(table.groupBy("__block", "__part"))
    far = far.applyInArrow(multiply, f"`{key}` {kind}, vector array<double>, n_tokens long")
    total = Summarizer.sum(array_to_vector("vector"))
    added = base.union(far).groupBy(key).agg(total.alias("__sum"), F.sum("n_tokens").alias("n_tokens"))
    return added.select(key, vector_to_array("__sum").alias("vector"), "n_tokens")


def _listed(matrix: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    offsets = pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).reshape(-1)))


VALUES_AT_ONCE = 4_000_000


def event_vectors(
    events: DataFrame,
    vocabulary: DataFrame,
    token_table: DataFrame,
    type_table: DataFrame,
    place_table: DataFrame,
    dim: int,
    tokens_column: str = "tokens",
) -> DataFrame:
    """Turn the ``tokens`` of each event into ``repr``: the mean of the vectors of its tokens.

    Tables and vocabulary of up to ``MAX_TABLE_BYTES`` together are sent to the executors once; tokens stay nested, so
    neither tokens nor vectors are shuffled. Larger ones go by ``token_sums``, with the same result.
    """
    send_code(events.sparkSession)
    sizes = [_table_bytes(*t, dim) for t in ((token_table, "token_id"), (type_table, "type_id"), (place_table, "dpe_id"))]
    if sum(sizes) + _vocabulary_bytes(vocabulary) > MAX_TABLE_BYTES:
        numbered = materialise(events.withColumn("__event", F.monotonically_increasing_id()), "events")
        sums = token_sums(numbered, "__event", vocabulary, token_table, type_table, place_table, dim, tokens_column)
        mean = F.transform("vector", lambda x: x / F.col("n_tokens")).alias("repr")
        return numbered.drop(tokens_column).join(sums.select("__event", mean), "__event").drop("__event")
    words, ids = _word_ids(vocabulary)
    unknown, most = S.SPECIAL_TOKEN_IDS[S.TOKEN_UNK], S.MAX_EVENT_TOKENS
    shared = events.sparkSession.sparkContext.broadcast(
        (
            words,
            ids,
            _matrix(token_table, "token_id", dim),
            _matrix(type_table, "type_id", dim),
            _matrix(place_table, "dpe_id", dim),
        )
    )

    def means(tokens: pa.ListArray) -> np.ndarray:
        words, ids, by_token, by_type, by_place = shared.value
        flat = tokens.flatten()
        found = pc.fill_null(pc.index_in(flat.field("token"), value_set=words), -1).to_numpy()
        token_ids = np.where(found >= 0, ids[found], unknown)
        vectors = _rows(by_token, token_ids).astype(np.float64)
        vectors += _rows(by_type, flat.field("type_id").to_numpy())
        vectors += _rows(by_place, flat.field("dpe_id").to_numpy())
        lengths = pc.list_value_length(tokens).to_numpy()
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.add.reduceat(vectors, starts, axis=0) / lengths[:, None]

    kept = [c for c in events.columns if c != tokens_column]
    schema = T.StructType(
        [events.schema[c] for c in kept] + [T.StructField("repr", T.ArrayType(T.DoubleType()))]
    )

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, VALUES_AT_ONCE // (dim * most))
        for batch in batches:
            tokens = batch.column(tokens_column)
            parts = [means(tokens.slice(i, step)) for i in range(0, len(tokens), step)]
            flat = np.concatenate(parts).reshape(-1) if parts else np.zeros(0)
            offsets = pa.array(np.arange(len(tokens) + 1) * dim, pa.int32())
            vectors = pa.ListArray.from_arrays(offsets, pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), vectors], names=[*kept, "repr"]
            )

    return events.mapInArrow(encode, schema)


#: What ``encode_with`` has set up in this Python worker, by the number of the call.
_ready: dict[str, Callable] = {}


def encode_with(
    events: DataFrame,
    keys: Sequence[str],
    inputs: Sequence[str],
    encode: Callable[[pa.RecordBatch], np.ndarray] | None = None,
    set_up: Callable[[], Callable[[pa.RecordBatch], np.ndarray]] | None = None,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """One vector per event from a user function on Arrow batches of the ``inputs``.

    ``encode`` takes a batch and gives a matrix with a row for each event. A function that has to be loaded first, such as
    a network with its weights, comes from ``set_up``, which runs once in each Python worker, however many tasks the worker
    runs. ``profile`` asks for resources of the tasks that encode (a stage of its own), such as a GPU for each.
    """
    if (encode is None) == (set_up is None):
        raise ValueError("encode_with takes either encode or set_up")
    send_code(events.sparkSession)
    call = uuid.uuid4().hex

    def function() -> Callable[[pa.RecordBatch], np.ndarray]:
        if set_up is None:
            return encode
        # The module of the worker keeps it; a function that is sent has no place of its own.
        from anamnesis.operators import vectors

        if call not in vectors._ready:
            vectors._ready[call] = set_up()
        return vectors._ready[call]

    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = function()
        for batch in rows:
            made = np.asarray(own(batch.select(list(inputs))), dtype=np.float32)
            if made.ndim != 2 or len(made) != batch.num_rows:
                raise ValueError(f"{len(made)} vectors came back for {batch.num_rows} events")
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), _listed(made)], names=[*keys, "repr"])

    columns = [*keys, *[c for c in inputs if c not in keys]]
    key_schema = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    return events.select(*columns).mapInArrow(batches, f"{key_schema}, repr array<float>", profile=profile)
