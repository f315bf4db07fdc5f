import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from cellweave.llm import resampling

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, runs):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))
    return [" ".join(w[i : i + n]).encode() for n in range(1, runs + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, runs=1, percent=10):
    bucket = lambda x: zlib.crc32(x) % 10000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text, runs)[0]))
    for text in target:
        t.update(map(bucket, features(text, runs)[0]))
    sa, ta = s.total(), t.total()
    out = []
    for d, text in docs:
        f, n = features(text, runs)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (sa + 10000) / ((s[b] + 1) * (ta + 10000)))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    words = ["The", "the", "THE", "é", "Zoë", "x" * 300, "it's", "a-b", "中文"] + [f"w{i}" for i in range(3000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(d, some(rng.choice([0, 5, 19, 20, 21, 60, 200]))) for d in range(400)]
    docs += [(500, None), (501, ""), (502, " .- "), (503, some(30_000)), (504, "same word " * 5000), (None, some(50)), (None, docs[1][1]), (7, docs[7][1]), (7, docs[7][1])]
    target = [some(40) for _ in range(10)] + ["w1 w2 w3 " * 50, None, ""]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in docs], "doc_id long, text string, score int, late string").repartition(7)
    return docs, target, df, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")


@pytest.mark.parametrize("runs, percent", [(1, 10), (2, 35), (3, 100)])
def test_draw_matches_brute_force(tables, runs, percent):
    docs, target, df, bench = tables
    got = [tuple(r) for r in resampling.resampled(df, bench, percent, runs).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs, target, runs, percent), key=repr)


def test_sql_agrees(tables):
    docs, target, df, bench = tables
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.execute("create table benchmark(text varchar)")
    con.executemany("insert into benchmark values (?)", [(t,) for t in target])
    got = [tuple(r) for r in resampling.resampled(df, bench).collect()]
    assert sorted(con.sql(resampling.SQL).fetchall(), key=repr) == sorted(got, key=repr)


def test_table_probes_past_equal_slots_and_equal_keys():
    texts = [f"t{i}".encode() for i in range(200)] * 3
    for keys in (np.zeros(600, np.uint64), np.tile(np.arange(200, dtype=np.uint64) % 7, 3), None):
        table = resampling.FeatureTable(600)
        slot = table.slots(texts, keys)
        assert [table.text[s] for s in slot] == texts
        assert table.used.sum() == 200 and table.count[table.used].tolist() == [3] * 200
        assert all(table.bucket[s] == zlib.crc32(x) % 10000 for s, x in zip(slot, texts))
    assert resampling.FeatureTable(0).slots([]).tolist() == []


def test_empty_tables(tables):
    docs, target, df, bench = tables
    assert resampling.resampled(df.where("false"), bench).collect() == []
    got = [tuple(r) for r in resampling.resampled(df, bench.where("false")).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs, []), key=repr)
