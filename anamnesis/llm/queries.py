"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm import toxic_crf
from anamnesis.llm.bilinear_lm import score_texts
from anamnesis.llm.circulant_minhash import minhash_components
from anamnesis.llm.common import crc, load, materialise
from anamnesis.llm.decontaminate import contaminated, find_passages
from anamnesis.llm.hybrid_search import search
from anamnesis.llm.jaccard_join import jaccard_components
from anamnesis.llm.kd_shards import kd_shards
from anamnesis.llm.lyndon_runs import find_runs, with_periods
from anamnesis.llm.pieces import encode_texts
from anamnesis.llm.privacy import KINDS, find_private
from anamnesis.llm.quality_rules import COUNTS, base_failed, count_text, kept, learn
from anamnesis.llm.tag_paths import extract
from anamnesis.llm.warc_salvage import archived, page_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(load(spark, sf_dir, "documents"), n=3, share=90)
    return found.select(
        F.col("doc").alias("doc_id"), F.col("n_ngrams").alias("n_shingles"), F.col("component").alias("component_id")
    )


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), n=13)
    items = F.array_sort("items")
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    counted = materialise(count_text(docs).select("doc_id", "counts"), "counts")
    rules = learn(counted, load(spark, sf_dir, "labels"))
    counts = F.col("counts")
    return counted.select(
        "doc_id", *[counts[c].alias(c) for c in COUNTS], base_failed(counts).alias("base_failed"), kept(rules, counts).alias("kept")
    )


@query
def op4_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(load(spark, sf_dir, "documents"))
    spans = F.col("spans")
    write = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("key").alias("doc_id"),
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.concat_ws(",", F.transform(base, write)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(spans, write)).alias("spans"),
    )


#: The vocabulary file that the queries encode with.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_texts(load(spark, sf_dir, "documents"), PIECES)
    return found.select(F.col("key").alias("doc_id"), "ids", "n_pieces", F.col("same").alias("round_trip"))


@query
def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archived(load(spark, sf_dir, "pages"))
    return records.select(
        page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )


ORACLE["op1_warc_salvage"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(x, CAST((i // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '')
    AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""


@query
def op2_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc(F.col("doc_id")) % 5 == 0
    field = toxic_crf.learn(docs, load(spark, sf_dir, "labels").where(~held))
    found = toxic_crf.tag_toxic(docs, field)
    return found.select(
        F.col("key").alias("doc_id"),
        F.coalesce(crc(F.col("key")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kd_shards(load(spark, sf_dir, "documents"), shards=40)
    return found.select(
        F.col("doc").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op6_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc(F.col("doc_id")) % 7 == 2, F.lit(False))
    found = score_texts(docs, ~held)
    return found.select(
        F.col("key").alias("doc_id"),
        F.coalesce(crc(F.col("key")) % 7 == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@query
def op11_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_components(load(spark, sf_dir, "documents"), n=2, share=80)
    return found.select(
        F.col("doc").alias("doc_id"),
        F.col("n_ngrams").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("doc").eqNullSafe(F.col("component")).alias("kept"),
    )


ORACLE["op11_circulant_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 1 THEN words
  ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM links
  UNION SELECT r.doc_id, l.b FROM reach AS r JOIN links AS l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(component_id, s.doc_id) AS kept
FROM s LEFT JOIN least ON s.doc_id = least.doc_id
"""


@query
def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", with_periods(F.col("text"), crc(F.col("doc_id"))).alias("text")))
    early = lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"], r["start"].alias("start"), r["period"].alias("period"))
    found = found.withColumn("best", F.array_max(F.transform("runs", early)))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    length, period = F.col("best.length"), F.col("best.period")
    return found.select(
        F.col("key").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), k=10)
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


ORACLE["op12_hybrid_search"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
tfs AS (SELECT doc_id, n, term, count(*) AS tf FROM tf GROUP BY doc_id, n, term),
size AS (SELECT count(*) AS docs, sum(len(terms)) AS total FROM d WHERE len(terms) > 0),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
df AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM tfs, size GROUP BY term),
scores AS (SELECT item_id, doc_id,
  CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + CAST((90 * n * docs) // total AS BIGINT))))) AS BIGINT) AS score
  FROM items JOIN df USING (term) JOIN tfs USING (term), size GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
