import random
import re

import duckdb
import pytest

from cellweave.llm import licenses

LETTERS = str.maketrans(licenses.UPPER, licenses.LOWER)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))


def brute(doc_id, text, least):
    w, g = words_of(text), licenses.GRAM
    base = [(p, k) for phrase, k in licenses.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
    best, found = 0.0, set()
    for label, notice in licenses.TEMPLATES:
        t = words_of(notice)
        diagonals = sorted({p - q for p in range(len(w) - g + 1) for q in range(len(t) - g + 1) if w[p : p + g] == t[q : q + g]})
        bands = []
        for d in diagonals:
            if bands and d - bands[-1][-1] <= licenses.SLACK:
                bands[-1].append(d)
            else:
                bands.append([d])
        for band in bands:
            share = len({q for d in band for q in range(len(t)) if 0 <= d + q < len(w) and w[d + q] == t[q]}) / len(t)
            best = max(best, share)
            if share >= least:
                found.add(label)
    labels = {k for _, k in base}
    places = [p for p, _ in base]
    return (doc_id, len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found)), best)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)] + ["the", "license", "by", "under", "Zoë", "ÀB"]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [None, "", " .,- ", "MIT License", "gnu GENERAL-public, license CC BY cc by-nc mit license apache License", "permit license mit licenses", "cc by " * 3000, "éMIT License", "MIT Licenseé"]
    for _, notice in licenses.TEMPLATES:
        parts = notice.split()
        out += [f"{filler(5)} {notice} {filler(9)}", notice.upper(), f"{notice}\n\n{filler(3)} {notice}", " ".join(parts[: len(parts) // 2])]
        for _ in range(3):  # words changed, left out and put in
            some = list(parts)
            for _ in range(max(1, len(some) // 12)):
                at = rng.randrange(len(some))
                some[at : at + rng.choice([0, 1, 2])] = rng.choice([[], ["new"], ["quite", "new"]])
            out.append(f"{filler(rng.randrange(30))} {' '.join(some)} {filler(4)}")
    return out + [filler(20_000) + " " + licenses.TEMPLATES[1][1] + " " + filler(2000)] + [filler(rng.randrange(200)) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(None, texts[4], "x", 1, "y"), (None, None, None, None, None), (3, texts[3], "a", 1, "b"), (3, texts[3], "a", 1, "b"), (3, "other text of this id under cc by", "a", 1, "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, w string, diagonal int, template string").repartition(5)


def test_scan_matches_brute_force(docs):
    key = lambda r: repr((*r[:7], round(r[7], 9)))
    got = sorted(map(key, map(tuple, licenses.scanned(docs).collect())))
    want = sorted(map(key, [brute(r.doc_id, r.text, 0.75) for r in docs.collect()]))
    assert got == want
    assert len({r.split("'")[3] for r in got}) > 8


def test_sql_agrees(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    key = lambda r: repr((*r[:7], round(r[7], 9)))
    got = sorted(key((r.doc_id, *tuple(r)[1:])) for r in licenses.scanned(docs).collect())
    rows = con.sql(licenses.SQL.format(least=0.75)).fetchall()
    want = sorted(key((None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:])) for r in rows)
    assert got == want


def test_notices_do_not_claim_each_other():
    for label, notice in licenses.TEMPLATES:
        extra = set(brute(0, notice, 0.75)[6].split(",")) - {label, *licenses.PHRASES.values()}
        assert not extra, (label, extra)


def test_empty_table_and_native_plan(docs):
    assert licenses.scanned(docs.where("false")).collect() == []
    plan = licenses.scanned(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan.replace("ExistingRDD", ""))
