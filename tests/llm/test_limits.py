"""Cases at the limits of the operators: crowded groups, long lines, hot passages."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from offerloom.llm import exact_dedup, line_dedup, packing, suffix_dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def vary(rng, line, most=4):
    out = bytearray(line)
    for _ in range(rng.randint(0, most)):
        at = rng.randint(0, len(out))
        out[at : at + rng.randint(0, 1)] = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 1)))
    return bytes(out)


def test_long_lines_meet_the_plain_distance():
    rng = random.Random(1)
    lines = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    pairs = [(x, vary(rng, x)) for x in lines] + list(zip(lines, lines[1:]))
    for most in (1, 2, 3):
        assert [line_dedup._within_long(x, y, most) for x, y in pairs] == [edits(x, y) <= most for x, y in pairs]


def test_one_long_line_among_short_ones():
    rng = random.Random(2)
    long_ = bytes(rng.choice(b"abcdef") for _ in range(1_000_000))
    near = long_[:10] + b"Z" + long_[10:600_000] + long_[600_001:]
    far = near[:300_000] + b"Q" + near[300_001:]
    short = [(b"line number %d of many" % i, b"line number %d of manz" % i) for i in range(600)]
    got = line_dedup.within([long_, long_, *[x for x, _ in short]], [near, far, *[y for _, y in short]])
    assert got.tolist() == [True, False] + [True] * 600


def test_packing_deals_evenly(spark):
    found = spark.range(6000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") % 97 + 1).alias("length"), F.col("id").alias("ids_crc32"))
    rows = packing.pack(found, group=500).collect()
    size = Counter(r.sequence_id >> 40 for r in rows)
    assert len(rows) == 6000 and len(size) == 12 and max(size.values()) <= 1.2 * 500


def test_pairs_beyond_the_first_items_are_found():
    sizes = [3] * 40 + [7, 8, 5]
    bins = packing.Bins(sizes, 150)
    bins.items, bins.fill = [[*range(40), 40, 41], [42]], [135, 5]
    bins.local_search()
    assert sorted(i for b in bins.items for i in b) == list(range(43)) and sum(1 for b in bins.items if b) == 1
    many = [1025 + i % 900 for i in range(20_000)]  # no two share a bin: nothing to gain, and soon known
    assert len(packing.place(many)) == 20_000


def test_hot_files_agree_with_the_others(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    passage = word(30)
    rows = [(i, f"{word(20)} {passage} {word(20)}") for i in range(60)] + [(60 + i, word(50)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = {tuple(r) for r in suffix_dedup.dedup(df).drop("runs").collect()}
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 200)
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", 10)
    assert len(suffix_dedup.hot_files(df, 1, 400))
    assert {tuple(r) for r in suffix_dedup.dedup(df).drop("runs").collect()} == plain


def test_rows_numbered_once(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i % 7}", i, i) for i in range(200)], "doc_id long, text string, __row int, __kept int")
    shuffled = docs.repartition(8, F.rand())  # another order at each reading
    kept = exact_dedup.keep_first(shuffled, exact_dedup.fresh_index(spark))
    got = kept.collect()
    assert kept.columns == docs.columns and len(got) == 7 and len({r.text for r in got}) == 7
    assert {r.doc_id for r in got} == {0}


def test_numpy_is_not_given_negative_groups(spark):
    assert exact_dedup.keep_first(spark.createDataFrame([], "doc_id long, text string"), exact_dedup.fresh_index(spark)).count() == 0
    assert np.all([len(b) for b in packing.place([1])])
