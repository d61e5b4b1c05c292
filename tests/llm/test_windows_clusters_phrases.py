"""Decontamination, clustering and collocations against plain versions, with every odd case."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from offerloom.llm import clustering, collocations, decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, row string, found string, contamination string, n int, part string"


def sentence(rng, n, alphabet="abcdé漢9"):
    return rng.choice([" ", ", ", "\n", "  "]).join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(n))


# -- decontamination ---------------------------------------------------------------------------------


def items_and_docs():
    rng = random.Random(3)
    items = [sentence(rng, k) for k in (25, 10, 9, 3, 1, 0, 40, 11)] + [None, "...", "Exactly The Same words of an item that is repeated here twice ok"]
    bench = list(enumerate(items)) + [(10, items[0]), (11, items[10]), (None, items[6]), (2, items[7])]
    texts = [sentence(rng, rng.randint(0, 60)) for _ in range(30)]
    for t in items:
        if t:
            texts += [sentence(rng, 12) + " " + t.upper() + "; " + sentence(rng, 5), t, " ".join(WORD.findall(t.lower())[:-1]), t.replace(" ", "-") + " " + t]
    texts += [None, "", " ", "ab" * 5000, sentence(rng, 3000) + " " + items[0] + " " + sentence(rng, 3000), items[10][:40] + "x" + items[10][40:]]
    rows = [(i, t, "en", "r", "f", "c", 1, "p") for i, t in enumerate(texts)]
    return bench, [*rows, rows[3], rows[3], (None, items[0], None, None, None, None, None, None)]


def plain_hits(bench, text, width=10):
    words = [(m.group(), m.start(), m.end()) for m in WORD.finditer((text or "").translate(LOWER))]
    only = [w[0] for w in words]
    hit, items = set(), set()
    for item, t in bench:
        mine = WORD.findall((t or "").translate(LOWER))
        size = min(width, len(mine))
        for k in range(len(mine) - size + 1 if mine else 0):
            for at in range(len(only) - size + 1):
                if only[at : at + size] == mine[k : k + size]:
                    hit |= set(range(at, at + size))
                    items.add(item)
    return words, hit, sorted(str(x) for x in items - {None})


def plain_cut(text, words, hit):
    out, last = "", 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out += text[last : words[i][1]]
        last = words[i][2]
    return out + (text or "")[last:]


@pytest.mark.parametrize("case", ["one block", "many blocks"])
def test_decontamination(spark, monkeypatch, case):
    if case == "many blocks":
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
        monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    bench, rows = items_and_docs()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    benchmark = spark.createDataFrame(bench, "item_id long, text string").repartition(2)
    if case == "many blocks":
        assert decontaminate.blocks(benchmark).select("block").distinct().count() > 5
    want = [(r[0], r[1], *plain_hits(bench, r[1])) for r in rows]
    marked = decontaminate.mark(docs, benchmark, "report")
    assert marked.columns == [*docs.columns, "report"]
    got = [(r.doc_id, r.text, r.report.n_words, r.report.n_hit, list(r.report["items"])) for r in marked.collect()]
    assert sorted(got, key=repr) == sorted(((i, t, len(w), len(h), x) for i, t, w, h, x in want), key=repr)
    cut = decontaminate.decontaminate(docs, benchmark)
    assert cut.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr) == sorted(((i, t if t is None else plain_cut(t, w, h)) for i, t, w, h, _ in want), key=repr)
    kept = decontaminate.decontaminate(docs, benchmark, remove="documents")
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(i) for i, _, _, h, _ in want if not h)


def test_windows_with_equal_hashes(monkeypatch):
    """Three hashes for all windows: only the bytes can tell them apart. Run on the driver, since workers
    keep the class they have seen."""
    monkeypatch.setattr(decontaminate, "mix", lambda x: x % np.uint64(3))
    bench, rows = items_and_docs()
    words = [" ".join(WORD.findall((t or "").translate(LOWER))).encode() for _, t in bench]
    windows = decontaminate.Windows([None if i is None else str(i) for i, _ in bench], pa.array(words, pa.binary()))
    for (_, text, *_), got in zip(rows, windows.report(pa.array([r[1] for r in rows], pa.string()))):
        plain, hit, items = plain_hits(bench, text)
        assert (got["n_words"], got["n_hit"], got["items"]) == (len(plain), len(hit), items)


def test_decontamination_of_empty_tables(spark):
    bench, rows = items_and_docs()
    docs, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "item_id long, text string")
    assert {r.c.n_hit for r in decontaminate.mark(docs, none, "c").collect()} == {0}
    assert decontaminate.mark(docs.limit(0), spark.createDataFrame(bench, "item_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, none, remove="words")


# -- clustering --------------------------------------------------------------------------------------


def plain_clusters(rows, clusters, rounds, size):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centres = [[sum(x) // len(own[k]) for x in zip(*own[k])] if own[k] else c for k, c in enumerate(centres)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), centres


@pytest.mark.parametrize("kind", ["clusters", "copies", "ties", "huge", "few"])
def test_clusters(spark, monkeypatch, kind):
    monkeypatch.setattr(clustering, "SHARD", 50)
    monkeypatch.setattr(clustering, "LEAF", 4)
    rng = np.random.default_rng(7)
    n, size = (3 if kind == "few" else 240), 4
    v = rng.normal(size=(n, size)) * 0.05 + rng.normal(size=(6, size))[rng.integers(0, 6, n)]
    if kind == "copies":
        v[: n // 2] = 0.25
    if kind == "ties":
        v = rng.integers(-1, 2, (n, size)).astype(float) / 1024
    if kind == "huge":
        v[::3] *= 1e30
        v[5] = 3e38
    rows = [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]
    rows += [rows[0], rows[1], rows[1], (None, rows[2][1]), (900, None), (901, [1.0, None, 0.0, 0.0]), (902, [math.nan, 0.0, 0.0, 0.0]), (903, [math.inf] * 4), (904, [0.5] * 3), (905, [])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, v string").repartition(3)
    found, centres = clustering.cluster(clustering.quantised(df, size), 5, 4)
    want, plain = plain_clusters(rows, 5, 4, size)
    assert centres == plain
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((i, k, min(d, clustering.LONG)) for i, k, d in want), key=repr)


def test_balls_are_assigned_whole():
    """Far clusters: nearly all balls have one owner, and counts and sums of the nodes are exact."""
    rng = np.random.default_rng(2)
    middle = rng.integers(-4000, 4000, (8, 16)).astype(float)
    v = middle[rng.integers(0, 8, 4000)] + rng.integers(-20, 20, (4000, 16))
    tree = clustering.BallTree(list(range(4000)), v)
    found = list(tree.assign(middle.astype(int).tolist()))
    whole = sum(tree.stop[k] - start for k, start, owner in found if owner is not None)
    assert whole > 3500 and len(found) < 40
    assert tree.sums[0] == v.sum(axis=0).astype(int).tolist()
    count, total = tree.partial(middle.astype(int).tolist())
    assert sum(count) == 4000 and [sum(x) for x in zip(*total)] == tree.sums[0]


def test_clusters_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found, centres = clustering.cluster(clustering.quantised(df))
    assert found.count() == 0 and centres == []


# -- collocations ------------------------------------------------------------------------------------


def plain_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for k in range(len(words) - m + 1):
                    f[lang][tuple(words[k : k + m])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in cand.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    inside[p[k : k + m]] = max(inside[p[k : k + m]], a)
        scored = []
        for p, a in cand.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrases_corpus():
    rng = random.Random(11)
    words = ["The", "of", "a", "naïve", "x\x00y", "x", "x\x01", "漢字", "end\x1f", "　", "long" * 30, "und"]
    weights = [12, 8, 6, 3, 3, 3, 3, 2, 2, 2, 1, 1]
    rows = []
    for lang in ("en", None, "und", "a b", "a%20b", "t\tab", "", "de"):
        for _ in range(25):
            rows.append((rng.choice([" ", "  ", "\t"]).join(w + rng.choice(["", "", "", ",", ".", "\n", "?", "\r"]) for w in rng.choices(words, weights, k=rng.randint(0, 40))), lang))
    rows += [(None, "en"), ("", "en"), (" ,. ", "new"), ("solo", "one"), ("the of " * 2000, "en"), (rows[3][0], "en"), (rows[3][0], "en")]
    return rows


@pytest.mark.parametrize("case", ["plain", "hot prefixes", "spelled words", "small batches"])
def test_collocations(spark, monkeypatch, case):
    if case == "hot prefixes":
        monkeypatch.setattr(collocations, "HOT_SHARE", 3)
    if case == "spelled words":
        monkeypatch.setattr(collocations.Code, "SIZE", 4)
    if case == "small batches":
        monkeypatch.setattr(collocations, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3"))
    rows = phrases_corpus()
    docs = spark.createDataFrame([(i, t, lang, "r", "f", "c", 1, "p") for i, (t, lang) in enumerate(rows)], DOCS).repartition(3)
    got = collocations.mine(docs, least=5, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_phrases(rows, 5, 40)
    assert len(want) > 60 and sorted(map(tuple, got.collect())) == want


def test_hot_prefixes_are_dealt_by_more_words(spark):
    """A third of all suffixes starts with one word, and all of those with one pair."""
    docs = spark.createDataFrame([(f"the of a{i % 7}", "en") for i in range(500)], "text string, lang string").select("lang", "text")
    code, hot = collocations._sample(docs, 4, 5)
    assert [len(hot[k]) for k in (1, 2, 3)] == [2, 1, 0]
    make = collocations._suffix_maker(4, hot)
    batch = pa.record_batch([pa.array(["en"] * 7), pa.array([f"the of a{i}" for i in range(7)])], names=["lang", "text"])
    depth = {code.read(s): p & 3 for out in make(code, [batch]) for p, s, _ in zip(*(c.to_pylist() for c in out.columns))}
    assert {depth[f"en the of a{i}"] for i in range(7)} == {2} and {depth[f"en a{i}"] for i in range(7)} == {0}


def test_collocations_of_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert collocations.mine(docs).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")).count() == 0
