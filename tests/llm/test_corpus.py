import os
import random

import numpy as np
import pyarrow as pa
import pytest

from topicweave.llm import mixture, toxicity
from topicweave.llm.mixture import mix_sources, normal_source, plan_mixture

TARGET = "recipe string, source string, weight double, max_repeat int, budget_share double"


def most(patterns, quota, layers, repeat):
    """The largest flow, by trying all cuts."""
    names = list(quota)
    best = None
    for k in range(2 ** len(names)):
        inside = {s for i, s in enumerate(names) if k >> i & 1}
        cut = sum(q for s, q in quota.items() if s not in inside) + sum(t * min(layers, *(repeat[s] for s in m)) for m, t in patterns if inside & set(m))
        best = cut if best is None else min(best, cut)
    return best


def test_flow_is_the_largest_of_least_cost():
    r = random.Random(5)
    for _ in range(300):
        names = "abcd"[: r.randint(1, 4)]
        quota, repeat = {s: r.randint(0, 40) for s in names}, {s: r.randint(0, 3) for s in names}
        subsets = {tuple(sorted(r.sample(names, r.randint(1, len(names))))) for _ in range(r.randint(0, 6))}
        patterns = [(m, r.randint(0, 20)) for m in sorted(subsets)]
        ranges, reached = plan_mixture(patterns, quota, repeat)
        assert sum(reached.values()) == most(patterns, quota, 3, repeat)
        assert all(reached[s] == sum(b - a for _, t, a, b in ranges if t == s) <= quota[s] for s in names)
        uses = [np.zeros(t, int) for _, t in patterns]
        for p, s, a, b in ranges:
            assert s in patterns[p][0] and 0 <= a < b
            uses[p][a:b] += 1
        assert all(u.max(initial=0) <= min(repeat[s] for s in m) for u, (m, _) in zip(uses, patterns))
        for layer in (1, 2, 3):  # what the first layers can give they do give
            assert sum(np.minimum(u, layer).sum() for u in uses) == most(patterns, quota, layer, repeat)


def test_overlapping_sources_share_documents():
    ranges, reached = plan_mixture([(("a",), 100), (("a", "b"), 100), (("b",), 10)], {"a": 100, "b": 100}, {"a": 1, "b": 1})
    assert reached == {"a": 100, "b": 100}
    assert sum(b - a for p, s, a, b in ranges if (p, s) == (1, "b")) >= 90


def test_many_patterns_are_planned():
    names = [f"s{i:02}" for i in range(14)]
    patterns = [(tuple(n for i, n in enumerate(names) if k >> i & 1), 5) for k in range(1, 2**14)]
    ranges, reached = plan_mixture(patterns, dict.fromkeys(names, 6000), dict.fromkeys(names, 2))
    assert set(reached.values()) == {6000} and sum(b - a for _, _, a, b in ranges) == 84_000


def test_copies_belong_to_all_their_sources(spark):
    rows = [(i, 10, s, d) for i, (s, d) in enumerate([("a", "x"), ("B ", "x"), ("a", "x"), ("a", "y"), ("b", "z"), (None, "w")])] + [(90, 10, "a", None), (91, 10, "b", None)]
    sized = mixture.merged_copies(spark.createDataFrame(rows, "doc long, tokens long, source string, digest string"))
    assert sorted((r.doc, sorted(r.sources)) for r in sized.collect()) == [(0, ["a", "b"]), (3, ["a"]), (4, ["b"]), (5, []), (90, ["a"]), (91, ["b"])]
    targets = [("r", "a", 0.5, 1, 5 / 6), ("r", "b", 0.5, 1, 5 / 6)]
    selection, report = mix_sources(sized, spark.createDataFrame(targets, TARGET), buckets=4)
    assert sorted((r.source, r.target_tokens, r.available_tokens) for r in report.collect()) == [("a", 25, 25), ("b", 25, 25)]
    assert {r.doc for r in selection.collect()} <= {0, 3, 4, 90, 91}


def test_selection_and_report(spark):
    r = random.Random(1)
    docs = [(i, r.randint(1, 40), [r.choice([" A", "a ", "B", "c"])]) for i in range(3000)] + [(9000, 50, None), (9001, None, ["a"]), (9002, 10, [None]), (None, 5, ["a"])]
    df = spark.createDataFrame(docs, "doc long, tokens long, sources array<string>")
    from pyspark.sql import functions as F

    sized = df.withColumn("sources", F.transform("sources", normal_source))
    size = {s: sum(t for d, t, x in docs if d is not None and t and x and x[0] and x[0].strip().lower() == s) for s in "abc"}
    total = sum(t for d, t, _ in docs if d is not None and t)
    targets = [("r", "A", 0.5, 1, 0.9), ("r", " b", 0.3, 3, 0.9), ("r", "C", 0.1, 1, 0.9), ("r", "none", 0.1, 2, 0.9), ("q", "b", 1.0, 2, 2.0), (None, "a", 1.0, 1, 1.0), ("z", "a", None, None, None)]
    selection, report = mix_sources(sized, spark.createDataFrame(targets, TARGET), buckets=16)
    short = {(x.recipe, x.source) for x in report.filter("short").collect()}
    assert short == {(q, s) for q, s, w, m, b in targets if q and w and size.get(s.strip().lower(), 0) * m < w * b * total}
    wanted = {(x.recipe, x.source): x.target_tokens for x in report.collect()}
    taken = selection.toPandas()
    assert not taken.duplicated(["recipe", "source", "doc"]).any()
    limit = {(q, s): m for q, s, _, m, _ in targets}
    for (q, s), part in taken.groupby(["recipe", "source"]):
        assert part["uses"].max() <= limit[q, s]
        reach = min(wanted[q, s], size[s.strip().lower()] * limit[q, s])
        assert abs((part["tokens"] * part["uses"]).sum() - reach) <= 80
        if part["uses"].max() > 1:  # none comes again before all have come
            assert part["tokens"].sum() == size[s.strip().lower()]
    again, _ = mix_sources(sized.repartition(7), spark.createDataFrame(targets, TARGET), buckets=16)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, selection.collect()))


@pytest.mark.skipif(not os.path.exists(mixture.VOCABULARY), reason="no vocabulary file")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", "s"), (2, "", "s"), (3, None, None), (4, "x" * 50_000, "s"), (5, "<|endoftext|>", "s")], "doc long, text string, source string")
    got = {r.doc: r.tokens for r in mixture.token_counts(df, "doc", "text", "source").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000 and got[5] > 1


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc long, tokens long, sources array<string>")
    selection, report = mix_sources(empty, spark.createDataFrame([("r", "a", 1.0, 1, 1.0)], TARGET))
    assert selection.count() == 0 and [tuple(r) for r in report.collect()] == [("r", "a", 0, 0, False)]


BAD = ["You utter moron, go away and stay away", "Shut it, you l0ser, before I hurt you", "u r a c r e t i n", "Those immigrants are vermin and must be chased off", "naked girls want hardcore sex with you tonight"]
FINE = ["The damn printer is out of paper once more", "Parasites of freshwater fish are listed in table two", "The survey on sex education ended in May", "We measured loans in five libraries", "The ledger was read twice", "The word moron once was a medical term"]


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        y = r.random() < 0.3
        parts = [r.choice(FINE) for _ in range(r.randint(1, 5))]
        if y:
            parts.insert(r.randrange(len(parts) + 1), r.choice(BAD))
        out.append((i, ". ".join(parts), r.choice([" A", "a", None]), int(y)))
    return out


def test_scores_on_held_out_texts(spark):
    docs = corpus(600, 1)
    r = random.Random(2)
    labels = [(i, y if r.random() > 0.03 else 1 - y) for i, _, _, y in docs[:300]] + [(0, None), (1, 1), (1, 0), (None, 1), (99999, 1)]
    df = spark.createDataFrame([(*d[:3], 0.1) for d in docs] + [(7000, None, None, 0.1), (7001, "", "a", 0.1), (7002, "word " * 50_000, "a", 0.1)], "doc_id long, text string, source string, score double")
    scores = toxicity.toxicity_scores(df, spark.createDataFrame(labels, "doc_id long, toxic int"), keep=("source",))
    got = {x.doc: x for x in scores.collect()}
    assert len(got) == 603 and not got[7000].flagged and not got[7001].flagged
    held = [(got[i].flagged, bool(y)) for i, _, _, y in docs[300:]]
    assert np.mean([a == b for a, b in held]) > 0.97
    rates = {x.source: x.documents for x in toxicity.source_rates(scores).collect()}
    assert set(rates) == {"a", None} and sum(rates.values()) == 603


def test_nothing_to_fit(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    got = toxicity.toxicity_scores(df, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")).collect()
    assert [tuple(r) for r in got] == [(1, None, False)]
    assert toxicity.toxicity_scores(df.limit(0), spark.createDataFrame([(1, 0)], "doc_id long, toxic int")).count() == 0


def test_calibration_is_monotone():
    r = np.random.default_rng(0)
    raw = r.normal(size=400)
    y = (r.random(400) < 1 / (1 + np.exp(-raw))).astype(float)
    t = toxicity.Trees().calibrate(raw, y, np.ones(400))
    assert (np.diff(t.values) >= -1e-12).all() and abs(np.interp(raw, t.points, t.values).mean() - y.mean()) < 0.02


@pytest.mark.parametrize("text,word", [("m0r0n", "moron"), ("l***r", "loser"), ("paaaarasite", "parasite"), ("c r e t i n", "cretin"), ("dumb@ss", "dumbass"), ("IMBÉCIL", "imbécil"), ("sh!t", "shit"), ("mo\u00adron", "moron"), ("i<b>di</b>ot", "idiot"), ("\u201cidiot\u201d", "idiot")])
def test_disguised_words(text, word):
    lexicon = toxicity.Lexicon({})
    t = toxicity.Tokens(pa.array([f"so {text} said"]))
    found = [int(x) if x >= 0 else lexicon.solve(t.text(i)) for i, x in enumerate(lexicon.find(t.hash)) if not t.skip[i]]
    assert int(lexicon.find(toxicity._hashes([word]))[0]) in found


def test_features_of_a_batch_are_those_of_each_text():
    texts = [t for _, t, _, _ in corpus(60, 4)] + ["", "12 34", "A!!! B", "word " * 3000, "ünï\nx. Y z?"]
    lexicon = toxicity.Lexicon({int(toxicity._hash_of("loans")): -1.0, int(toxicity._hash_of("rock")): 2.0})
    whole = toxicity.features(pa.array(texts), lexicon)
    for i, t in enumerate(texts):
        assert np.allclose(toxicity.features(pa.array([t]), lexicon)[0], whole[i]), t
    assert whole[-5].max() == 0 and np.isfinite(whole).all()


def test_nearness_of_the_second_person():
    lexicon = toxicity.Lexicon({})
    near = toxicity.features(pa.array(["you moron", "you are such a moron", "You came. He is a moron", "moron"]), lexicon)[:, 6]
    assert near.tolist() == [1 / 2, 1 / 5, 0, 0]
