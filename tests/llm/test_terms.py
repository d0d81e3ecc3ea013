import collections
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from topicweave.llm import enrichment
from topicweave.llm.enrichment import distinctive_terms, log_gamma, log_upper_tail
from topicweave.llm.frequency import term_frequency
from topicweave.llm.pairs import item_pairs

SCHEMA = "id long, terms array<string>, term string, n long, record long"


def made(spark, records):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in records], SCHEMA)


@pytest.fixture(scope="module")
def records():
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    out = [(i, [words[min(59, int(r.expovariate(0.08)))] for _ in range(r.randint(0, 25))]) for i in range(300)]
    return out + [(900, None), (901, []), (902, [None, "w1", "w1"]), (None, ["w1"])]


def clean(records):
    return {i: [t for t in ts or [] if t is not None] for i, ts in records if i is not None}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.data())
def test_tail_is_the_exact_sum(total, data):
    marked, drawn = data.draw(st.integers(1, total)), data.draw(st.integers(1, total))
    k = data.draw(st.integers(max(1, drawn + marked - total), min(marked, drawn)))
    want = sum(math.comb(marked, x) * math.comb(total - marked, drawn - x) for x in range(k, min(marked, drawn) + 1)) / math.comb(total, drawn)
    got = math.exp(log_upper_tail(np.array([k]), total, np.array([marked]), np.array([drawn]))[0])
    assert got == pytest.approx(want, rel=1e-7)


def test_log_gamma():
    x = np.array([0.5, 1, 2, 7.3, 100, 1e6])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-10)


@pytest.mark.parametrize("local,hot", [(1_000_000, 50_000), (0, 50_000), (0, 5), (0, 0)])
def test_distinctive_terms(spark, records, local, hot):
    docs = {i: collections.Counter(t) for i, t in clean(records).items() if t}
    total, n, df = sum(sum(c.values()) for c in docs.values()), collections.Counter(), collections.Counter()
    for c in docs.values():
        n.update(c), df.update(c.keys())
    want = {}
    for i, c in docs.items():
        size, ps = sum(c.values()), {}
        for t, k in c.items():
            ps[t] = sum(math.comb(n[t], x) * math.comb(total - n[t], size - x) for x in range(k, min(size, n[t]) + 1)) / math.comb(total, size)
        order = sorted(ps, key=lambda t: ps[t])
        q = 1.0
        for rank in range(len(order), 0, -1):
            q = min(q, ps[order[rank - 1]] * len(order) / rank)
            want[i, order[rank - 1]] = -math.log(q)
    got = distinctive_terms(made(spark, records), "id", "terms", max_local_terms=local, hot_terms=hot).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.score == pytest.approx(want[r.record, r.term], abs=1e-7)
        assert (r.n, r.records, r.n_in_record) == (n[r.term], df[r.term], docs[r.record][r.term])


def test_limits_only_choose_rows(spark, records):
    df = made(spark, records)
    every = {(r.record, r.term): r.score for r in distinctive_terms(df, "id", "terms").filter("n_in_record >= 2 and records between 2 and 30").collect()}
    some = {(r.record, r.term): r.score for r in distinctive_terms(df, "id", "terms", min_count=2, min_records=2, max_records=30).collect()}
    assert every == some


def test_early_flush_of_partial_counts(records, monkeypatch):
    import pyarrow as pa

    rows = [t for t in clean(records).values() if t]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], ["record", "tokens"])]
    out = pa.Table.from_batches(list(enrichment._partial(iter(batches)))).to_pydict()
    assert sum(out["n"]) == sum(map(len, rows))


@pytest.mark.parametrize("heavy,block", [(4, 512), (4, 3), (200, 5), (1, 2)])
def test_pairs_by_all_three_ways(spark, records, heavy, block):
    sets = {i: set(t) for i, t in clean(records).items() if t}
    n, both = collections.Counter(), collections.Counter()
    for s in sets.values():
        n.update(s), both.update(itertools.combinations(sorted(s), 2))
    want = {p: (c, n[p[0]], n[p[1]], len(sets)) for p, c in both.items() if c >= 2}
    got = item_pairs(made(spark, records), "id", "terms", min_count=2, heavy=heavy, block=block).collect()
    assert {(r.term_a, r.term_b): (r.n, r.n_a, r.n_b, r.n_records) for r in got} == want and len(got) == len(want)
    assert all(r.lift == pytest.approx(r.n * r.n_records / r.n_a / r.n_b) for r in got)


def test_one_record_with_many_items(spark):
    items = [f"i{k:04}" for k in range(90)]
    df = made(spark, [(1, items), (2, items[:50]), (3, items[40:])])
    got = {(r.term_a, r.term_b): r.n for r in item_pairs(df, "id", "terms", min_count=1, heavy=8, block=10).collect()}
    sets = [set(items), set(items[:50]), set(items[40:])]
    assert got == {(a, b): sum({a, b} <= s for s in sets) for a, b in itertools.combinations(items, 2)}


def test_frequency(spark, records):
    n, df = collections.Counter(), collections.Counter()
    for t in clean(records).values():
        n.update(t), df.update(set(t))
    total = sum(bool(t) for t in clean(records).values())
    mark = lambda k: "rare" if k < 3 else "common" if k > 0.05 * total else "useful"
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = term_frequency(made(spark, records + [(5, ["w1", "again"])]), "id", "terms").collect()
        ours = {r.term: (r.n, r.records, r.mark) for r in got}
        extra = "w1" not in clean(records)[5]
        assert ours.pop("again") == (1, 1, "rare")
        assert ours == {t: (n[t] + (t == "w1"), df[t] + (t == "w1" and extra), mark(df[t] + (t == "w1" and extra))) for t in n}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_term_in_most_rows_and_long_terms(spark):
    df = made(spark, [(i, ["hot", "x" * 20_000 if i == 7 else f"t{i % 5}"]) for i in range(2000)])
    got = {r.term[:5]: (r.n, r.records) for r in term_frequency(df, "id", "terms").collect()}
    assert got["hot"] == (2000, 2000) and got["xxxxx"] == (1, 1)


def test_empty_tables(spark):
    empty = made(spark, [(1, ["a"])]).limit(0)
    assert distinctive_terms(empty, "id", "terms").count() == item_pairs(empty, "id", "terms").count() == term_frequency(empty, "id", "terms").count() == 0
