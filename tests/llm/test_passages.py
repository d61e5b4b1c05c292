"""Planted passages of little over 50 words, held against the text that is left."""

import random

from offerloom.llm import chunk_dedup


def test_short_passages_go_whole(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvwé") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    planted = [text(51 + i % 30) for i in range(60)]
    planted += ["ab" * 160, "to be or not " * 30, "-" * 330]
    before, rows = {}, []
    for i, p in enumerate(planted):
        for j in range(3):  # three unlike contexts
            before[i + 100 * j] = left, right = f"{text(40)} | ", f" | {text(40)}"
            rows.append((i + 100 * j, left + p + right))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in chunk_dedup.dedup(docs, grow=True).collect()}
    for i, p in enumerate(planted):
        for j in range(3):
            left, right = before[i + 100 * j]
            # A byte of the context may agree by chance beside the marks that enclose a passage.
            want = left + p + right if j == 0 else left[:-3] + right[3:]
            slack = 0 if j == 0 else 12
            assert abs(len(got[i + 100 * j]) - len(want)) <= slack, (i, j, p[:20])
            assert got[i + 100 * j][:100] == left[:100]
