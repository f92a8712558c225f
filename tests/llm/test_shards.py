"""Shards of near equal bytes with gapless slots."""

import random
import zlib

from anamnesis.llm.kd_shards import kd_shards


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def check(spark, rows, shards, slack):
    found = kd_shards(documents(spark, rows), shards=shards).collect()
    sizes = sorted(len((t or "").encode()) + 16 for _, t, *_ in rows)
    assert sorted(r["size"] for r in found) == sizes
    texts = {i: t for i, t, *_ in rows}
    assert all(r["crc"] == zlib.crc32((texts[r["doc"]] or "").encode()) for r in found)
    slots, total = {}, {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if rows and slack is not None:
        assert set(total) == set(range(shards))
        mean = sum(sizes) / shards
        assert max(abs(b - mean) for b in total.values()) <= slack * mean + max(sizes)
    return found


def test_near_equal_bytes(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        text = "é" * rng.choice([0, 5, 40, 40, 40, 300])
        rows.append((i, text, rng.choice(["en", "de"]), f"s{int(rng.random() ** 3 * 9)}", len(text)))
    check(spark, rows, 7, 0.02)


def test_one_source_one_text_and_nulls(spark):
    # All values but the id are equal; a third of the ids are null.
    rows = [(None if i % 3 == 0 else i, "same text", None, None, None) for i in range(900)]
    found = kd_shards(documents(spark, rows), shards=5).collect()
    count = {}
    for r in found:
        count[r["shard"]] = count.get(r["shard"], 0) + 1
    assert sorted(count) == list(range(5)) and max(count.values()) - min(count.values()) <= 8


def test_small_and_empty_tables(spark):
    assert kd_shards(documents(spark, []), shards=4).count() == 0
    check(spark, [(1, None, "en", "s", 0)], 4, None)
    check(spark, [(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (2, "b" * 1000, "en", "s", 1)], 3, None)


def test_target_bytes_and_clashing_columns(spark):
    docs = documents(spark, [(i, "x" * 84, "en", "s", 84) for i in range(100)]).selectExpr("*", "1 as size", "2 as row", "3 as k_0", "4 as shard")
    found = kd_shards(docs, target_bytes=1000).collect()
    assert len({r["shard"] for r in found}) == 10
