import random

import pytest
import xxhash

from cellweave.llm import simhash


def fingerprint(text):
    words = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in (text or "")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


TEXTS = ["", None, " \t\n", "One", "one two", "ONE TWO", "a b c d", "Ärger über ÄÖ x y", "x\x1fy z w", "a  b\tc\n\nd e"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == fingerprint(text)


def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows, d = [], 100
    for t in TEXTS:
        rows.append((d, t))
        d -= 1
    for _ in range(40):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(rng.choice([1, 1, 4, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 + len(rows), " ".join(copy)))
    rows += [(1000, rows[12][1]), (rows[12][0], rows[12][1]), (None, rows[13][1]), (None, "all alone in here with no id")]
    return rows


@pytest.mark.parametrize("chunk, blocks", [(4096, 5), (3, 5), (4096, 4), (4096, 6)])
def test_components_match_all_pairs(spark, monkeypatch, chunk, blocks):
    monkeypatch.setattr(simhash.links, "__defaults__", (3, 5, chunk))
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string").repartition(6)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, blocks=blocks).collect()), key=repr)
    fp = {i: fingerprint(t) for i, (_, t) in enumerate(rows)}
    root = components(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[fp[i]]] = min(d, least.get(root[fp[i]], d))
    assert got == sorted(((d, f"{fp[i]:016x}", least.get(root[fp[i]])) for i, (d, _) in enumerate(rows)), key=repr)
    assert len(least) < len(set(fp.values()))


def test_keep_first_keeps_one_of_each_component(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, first string")
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    groups = simhash.near_duplicates(df).select("component_id").distinct().collect()
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == sorted(r.component_id for r in groups if r.component_id is not None)
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["all alone in here with no id"]


def test_long_text_and_empty_table(spark):
    text = "word " * 200_000 + "end"
    assert simhash.fingerprint(text.encode()) == simhash.fingerprint(("word " * 100_000).encode())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_first(empty).collect() == []


def test_keep_first_keeps_columns_of_any_name(spark):
    names = ["__t", "__once", "row", "t", "once", "first", "fp", "a.b"]
    rows = [(i, text, *(f"{n}{i}" for n in names)) for i, text in enumerate(["one two three four five six"] * 3 + ["quite another text of some words", None])] + [(None, "no id", *names)]
    df = spark.createDataFrame(rows + [rows[3]], ["doc_id", "text", *names])
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[3], rows[4], rows[5]], key=repr)
