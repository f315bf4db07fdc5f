import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from cellweave.llm import crossentropy


def brute(docs, good, prior):
    pairs = lambda t: list(zip([" ", *t.split()], t.split()))
    v, models = len({w for _, t in docs for w in (t or "").split()}), []
    for chosen in (lambda d: d in good, lambda d: True):
        n = Counter(p for d, t in docs if chosen(d) for p in pairs(t or ""))
        c, w = Counter(), Counter()
        for (a, b), k in n.items():
            c[a] += k
            w[b] += k
        models.append(lambda a, b, n=n, c=c, w=w, all_=n.total(): -math.log((n[a, b] + prior * (w[b] + 1) / (all_ + v)) / (c[a] + prior)))
    out = []
    for d, t in docs:
        p = pairs(t or "")
        a, b = [sum(m(*x) for x in p) / len(p) if p else None for m in models]
        out.append((d, len(p), a, b, a - b if p else None))
    return out


def same(got, want, digits):
    near = lambda x, y: x is y is None or abs(x - y) < digits
    key = lambda r: (repr(r[:2]), *(r[2:] if r[2] is not None else ()))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(near(x, y) for a, b in zip(got, want) for x, y in zip(a[2:], b[2:]))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    some = lambda n: " ".join(f"w{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(n))
    out = [(1, "a b a b c"), (2, "a c"), (3, None), (4, ""), (5, "z y x a"), (5, "z y x a"), (None, "a b"), (6, "é é a\nb\tc  d"), (7, " \n "), (8, "the same " * 4000), (9, some(30_000))]
    return out + [(10 + i, some(rng.choice([1, 2, 40]))) for i in range(60)] + [(None, out[0][1])]


@pytest.mark.parametrize("hot", [100_000, 40, 1])
def test_matches_brute_force(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(crossentropy, "HOT", hot)  # all words and pairs, some, and none travel to the tasks
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in docs], "doc_id long, text string, good int, k string").repartition(3)
    target = spark.createDataFrame([(1,), (6,), (6,), (None,), (99,), (12,), (13,), (14,)], "doc_id long")
    want = brute(docs, {1, 6, 12, 13, 14}, 2.0)
    same(crossentropy.scored(df, target, 2.0).collect(), want, 1e-9)


def test_slices_send_rows_by_range_not_by_pair(spark, docs, monkeypatch):
    monkeypatch.setattr(crossentropy, "SLICE", 50_000)
    monkeypatch.setattr(crossentropy, "RANGE", 4_000)
    sent, answers = [], crossentropy.answers
    monkeypatch.setattr(crossentropy, "answers", lambda rows, hot, ranges: sent.append((answers(rows, hot, ranges), ranges)) or sent[-1][0])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(1,), (6,), (12,), (9,)], "doc_id long")
    same(crossentropy.scored(df, target, 2.0).collect(), brute(docs, {1, 6, 12, 9}, 2.0), 1e-9)
    rows, ranges = sent[0]
    n_slices = rows.select("slice").distinct().count()
    assert n_slices > 2 and ranges > 32
    assert rows.count() <= n_slices * ranges < len({p for _, t in docs for p in zip((t or "").split(), (t or "").split()[1:])})


def test_sql_agrees(docs):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar); create table labels (doc_id bigint, quality int, toxic int)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.execute("insert into labels values (1, 1, 0), (6, 1, null), (6, 1, 0), (2, 1, 1), (3, 0, 0), (12, 1, 0)")
    same(con.sql(crossentropy.SQL.format(prior=2.0)).fetchall(), brute(docs, {1, 6, 12}, 2.0), 2e-6)


def test_rare_words_alone_tell_a_document_apart(spark):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(3000)]  # each far more frequent than the words that matter
    docs = [(i, " ".join(rng.choice(common) for _ in range(400))) for i in range(200)]
    like, unlike = [f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)]
    mix = lambda rare: " ".join(f"{rng.choice(common)} {rng.choice(rare)}" for _ in range(40))
    docs += [(1000 + i, mix(like)) for i in range(4)] + [(2000 + i, mix(unlike)) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in crossentropy.scored(df, spark.createDataFrame([(1000,), (1001,), (0,), (1,)], "doc_id long")).collect()}
    assert max(got[1002], got[1003]) < min(got[k] for k in range(2000, 2004)) - 0.5


def test_keys_differ():
    a = np.arange(100_000, dtype=np.int64) - 50_000
    sides = (np.ones_like(a), -np.ones_like(a), a, a[::-1])
    pairs = {p for b in sides for p in zip(a.tolist(), b.tolist())}
    assert len(np.unique(np.concatenate([crossentropy.mixed(a, b) for b in sides]))) == len(pairs)


def test_no_target_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert crossentropy.scored(df, none).first().n_words == 2
    assert crossentropy.scored(df.where("false"), none).collect() == []
    assert crossentropy.scored(spark.createDataFrame([(1, None)], "doc_id long, text string"), none).first().score is None
