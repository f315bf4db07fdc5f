import math
import random
import re
from collections import Counter

import pytest
import xxhash

from cellweave.llm import quality

M = 1 << 64


def long_hash(x, seed=42):
    return xxhash.xxh64_intdigest((x % M).to_bytes(8, "little"), seed)


def brute(docs, trusted, least, buckets):
    signed = lambda h: h - M if h >> 63 else h
    words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    feats, raw, good = [], Counter(), Counter()
    for d, t in docs:
        w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in words_of(t)]
        f = [signed(h) % buckets for h in w] + [signed(long_hash(b, long_hash(a))) % buckets for a, b in zip(w, w[1:])]
        feats.append(f)
        raw.update(f)
        if d in trusted and d is not None:
            good.update(f)
    tt, rr = sum(good.values()), sum(raw.values())
    weight = lambda k: math.log((good[k] + 1) / (tt + buckets)) - math.log((raw[k] + 1) / (rr + buckets))
    out = []
    for (d, t), f in zip(docs, feats):
        w = words_of(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times, cover = Counter(grams), set()
        for i, g in enumerate(grams):
            if times[g] > 1:
                cover.update(range(i, i + 5))
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        score = sum(map(weight, f)) / max(1, len(f))
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), round(score, 9), failed, not failed and score >= least))
    return out


@pytest.mark.parametrize("buckets, least", [(1 << 14, -0.5), (37, -0.02)])
def test_scores_match_brute_force(spark, buckets, least):
    rng = random.Random(5)
    words = ["an", "é", "#tag", "$5", "the", "the", "Zoë", "x" * 40] + [f"w{i}" for i in range(60)]
    docs = []
    for d in range(150):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 8))]
        lines += rng.choices(lines, k=rng.choice([0, 0, 1, 5])) if lines else []
        docs.append((d, "\n".join(lines)))
    docs += [(200, None), (201, ""), (202, " \n\t\n "), (203, "a a a a a"), (204, "a a a a a a"), (205, "a b c d e f a b c d e"), (206, "one\n\none\n one\nx\x0bone"), (None, "no id at all | here"), (3, docs[3][1]), (207, "loop " * 3000)]
    trusted = set(range(0, 150, 3))
    df = spark.createDataFrame([(d, t, 1, "w") for d, t in docs], "doc_id long, text string, weights int, w string").repartition(5)
    good = spark.createDataFrame([(d,) for d in trusted] + [(3,), (None,)], "doc_id long")
    got = quality.scored(df, good, least, buckets).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept").collect()
    want = brute(docs, trusted, least, buckets)
    assert sorted(((*r[:6], round(r[6], 9), *r[7:]) for r in got), key=repr) == sorted(want, key=repr)
    assert len({r.kept for r in got}) == 2


def test_no_trusted_documents_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert quality.scored(df, none).count() == 1
    assert quality.scored(df.where("false"), none).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    plan = quality.scored(df, df.select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
