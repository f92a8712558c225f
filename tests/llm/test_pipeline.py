"""The pipeline's near-duplicate stage against its definition."""

import corpus_pipeline


def near(spark, docs):
    return sorted((tuple(r)[:2] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=lambda r: (r[0], str(r[1])))


def test_near_copies_by_five_word_shingles(spark, table):
    words = ["w%d" % i for i in range(104)]  # 100 shingles of five words, 102 of three
    added = words + ["x%d" % i for i in range(22)]  # 100 of 122 and 102 of 124 are shared: 0.82 in both
    spaced = ["v%d" % i for i in range(124)]
    edited = list(spaced)
    for k in (10, 40, 70, 90):  # 100 of 140 five-word shingles are shared: 0.71, and 110 of 134 of three: 0.82
        edited[k] = "y%d" % k
    kept = near(spark, table([" ".join(w) for w in (words, added, spaced, edited)]))
    assert [i for i, _ in kept] == [0, 2, 3]


def test_pairs_below_the_share_stay(spark, table):
    words = ["w%d" % i for i in range(104)]
    edited = list(words)
    edited[20] = edited[60] = "x"  # 90 of 110 shared by five words, 96 of 108 by three
    more = list(edited)
    more[40] = "y"  # 85 of 115 shared with the first: 0.74; three words: 93 of 111
    assert [i for i, _ in near(spark, table([" ".join(words), " ".join(more)]))] == [0, 1]
    assert [i for i, _ in near(spark, table([" ".join(words), " ".join(edited)]))] == [0]


def test_rows_of_one_id_are_told_apart(spark, table):
    text = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (5, None), (7, text("b") + " end"), (8, text("c")), (8, text("d")), (9, text("d")), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], table([]).schema)
    want = [rows[k] for k in (0, 2, 3, 5, 6, 8)]
    assert near(spark, docs) == sorted(want, key=lambda r: (r[0], str(r[1])))
