import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from topicweave.llm import leakage, neardup
from topicweave.llm.leakage import leaked_items
from topicweave.llm.neardup import duplicate_classes, near_duplicates, similar_pairs
from topicweave.llm.words import shingles, words

WORDS = [f"word{i}" for i in range(40)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1 .é­Z"), max_size=30), min_size=1, max_size=8))
def test_words_are_those_of_the_pattern(texts):
    low = [t.lower() for t in texts]
    row, h = words(pa.array(low))
    want = [(i, w) for i, t in enumerate(low) for w in re.findall("[a-z0-9]+", t)]
    assert row.tolist() == [i for i, _ in want]
    known = {}
    for (_, w), x in zip(want, h.tolist()):
        assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)
    assert len(shingles(row, h, 2)[0]) == sum(max(0, len(re.findall("[a-z0-9]+", t)) - 1) for t in low)


def test_very_long_word():
    row, h = words(pa.array(["a" * 100_000 + " b", "a" * 100_000]))
    assert row.tolist() == [0, 0, 1] and h[0] == h[2] != h[1]


def made_texts(seed=1):
    r = random.Random(seed)
    base = [[r.choice(WORDS) for _ in range(r.randint(5, 40))] for _ in range(60)]
    texts = []
    for b in base:
        for _ in range(r.randint(1, 4)):
            t = list(b)
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(t))
                t[k : k + r.randint(0, 1)] = [r.choice(WORDS)]
            texts.append(" ".join(t))
    texts += texts[:10] + ["", None, "one two", "one two", "UPPER case text here now ok", "upper CASE text, here now ok!"] + ["same old words in every place of this text"] * 30
    return list(enumerate(texts))


def sets_of(texts, width):
    out = {}
    for i, t in texts:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    return out


@pytest.mark.parametrize("width,least,list_size,ceiling,bits", [(3, 0.5, 8192, 65535, 25), (5, 0.8, 8192, 65535, 25), (2, 0.6, 6, 65535, 25), (2, 0.6, 2, 4, 25), (3, 0.5, 8192, 65535, 16)])
def test_all_similar_pairs(spark, rows, monkeypatch, width, least, list_size, ceiling, bits):
    for name, value in (("_LIST", list_size), ("_CEILING", ceiling), ("_MOST_BITS", bits)):
        monkeypatch.setattr(neardup, name, value)
    texts = made_texts()
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in texts] + [(None, "x", 1, "z")], "id long, text string, doc int, class string")
    members, links = near_duplicates(df, "id", "text", width, least)
    s = sets_of(texts, width)
    want = {(a, b) for a, b in itertools.combinations(sorted(s), 2) if s[a] and s[b] and len(s[a] & s[b]) >= least * len(s[a] | s[b]) - 1e-12}
    got = rows(similar_pairs(members, links))
    assert set(got) == want and len(got) == len(want)
    classes = {r.doc: (r["class"], r.links) for r in duplicate_classes(members, links).collect()}
    assert classes.keys() == s.keys()
    for a, b in itertools.combinations(sorted(s), 2):
        assert (classes[a][0] == classes[b][0]) == bool(s[a] and s[a] == s[b])


def test_sizes_keep_their_bounds():
    x = np.r_[np.arange(5000), 10 ** np.arange(4, 9), 2**31 - 1]
    up, down = neardup._large(neardup._small(x, True)), neardup._large(neardup._small(x, False))
    assert (down <= x).all() and (x <= up).all() and (up - down <= np.maximum(0, x // 500)).all()
    least = neardup._least_of(neardup._small(x, True))
    assert (least <= x).all() and (x - least <= x // 500).all()


def test_counts_beyond_the_ceiling_stay_exact(monkeypatch):
    monkeypatch.setattr(neardup, "_CEILING", 100)
    counts = np.zeros(neardup._SLICE, np.uint32)
    counts[[3, 7, 9]] = 99, 100, 3_000_000
    sketch = neardup.Sketch(16)
    sketch.add(0, neardup._pack(counts))
    slot = np.arange(12, dtype=np.uint64) << np.uint64(48)
    assert sketch.close().of(slot).tolist() == [0, 0, 0, 99, 0, 0, 0, 100, 0, 3_000_000, 0, 0]
    # a list of 3,000,000 is in groups of _LIST, every two of which meet in one cell
    post = np.zeros(50, neardup.POSTING)
    post["text"] = np.arange(50)
    monkeypatch.setattr(neardup, "_LIST", 500_000)
    cells = neardup._spread(post, np.full(50, 3_000_000))
    of = {t: set(cells["token"][cells["text"] == t].tolist()) for t in range(50)}
    assert len(cells) == 300 and all(len(x) == 6 for x in of.values()) and all(of[a] & of[b] for a in of for b in of)


def test_no_texts(spark):
    df = spark.createDataFrame([], "id long, text string")
    members, links = near_duplicates(df, "id", "text")
    assert members.count() == links.count() == similar_pairs(members, links).count() == 0


def leak_case():
    r = random.Random(2)
    line = lambda n: [r.choice(WORDS) for _ in range(n)]
    items = [(k, " ".join(line(n))) for k, n in enumerate([12, 13, 30, 64, 11, 5])] + [(6, "la " * 14), (7, "go on " * 9 + "stop here now"), (8, None), (9, ""), (None, "x")]
    docs = []
    for k in range(150):
        t = line(r.choice([0, 5, 40, 300]))
        if k % 3 == 0:
            source = items[r.randrange(6)][1].split()
            a = r.randrange(max(1, len(source) - 10))
            at = r.randrange(len(t) + 1)
            t[at:at] = source[a : a + r.choice([11, 12, 13, 40])]
        docs.append((k, (" , " if k % 2 else "\n").join(t).title()))
    docs += [(400, "say " + "la " * 12), (401, "la " * 11), (402, " ".join(line(50)) + " go on" * 8), (403, " ".join(line(7)) + " On go" * 6)]
    return docs + [(500, None), (501, ""), (None, "x"), (502, " ".join(line(30_000) + items[2][1].split()))], items


@pytest.mark.parametrize("bits", [32, 1])
def test_leaks(spark, monkeypatch, bits):
    monkeypatch.setattr(leakage, "_BITS", bits)  # a bitmap too small lets more through, not less
    docs, items = leak_case()
    runs = lambda t: {tuple(w[k : k + 12]) for w in [re.findall("[a-z0-9]+", (t or "").lower())] for k in range(len(w) - 11)}
    want = {(d, i): (len(runs(t) & runs(x)), len(runs(x))) for d, t in docs for i, x in items if d is not None and i is not None and runs(t) & runs(x)}
    got = leaked_items(spark.createDataFrame(docs, "doc long, text string"), "doc", "text", spark.createDataFrame(items, "item long, text string"), "item", "text").collect()
    assert {(r.doc, r.item): (r.shared, r.total) for r in got} == want and len(got) == len(want)


def test_partitions_by_size():
    need = leakage.partitions(8, 20, 1.0, 1e-9)
    assert (need[:8] == 0).all() and need[8] == 1 and (np.diff(need[8:]) >= 0).all()
    for size in range(9, 21):  # the chance that none of the hash functions agrees
        assert (1 - 8 / size) ** need[size] <= 1e-9


def test_leaks_of_nothing(spark):
    empty = spark.createDataFrame([], "doc long, text string")
    full = spark.createDataFrame([(1, " ".join(WORDS))], "doc long, text string")
    for a, b in ((empty, full), (full, empty)):
        assert leaked_items(a, "doc", "text", b, "doc", "text").count() == 0
