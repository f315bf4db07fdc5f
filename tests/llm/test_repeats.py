import hashlib
import random

import pytest

from cellweave.llm import repeats

LEAST = repeats.LEAST


def brute(docs):
    """(id, bytes, removed, spans, sha) by looking at every 100-byte string."""
    seen, out = {}, []
    for d, t in sorted(docs):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - LEAST + 1):
            w = b[i : i + LEAST]
            if w in seen:
                mark[i : i + LEAST] = b"\1" * LEAST
            else:
                seen[w] = (d, i)
        spans = sum(1 for i in range(len(b)) if mark[i] and not (i and mark[i - 1]))
        out.append((d, len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randint(10, 120))) for _ in range(8)]
    docs = []
    for d in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 80))))
            if rng.random() < 0.3:
                cut = rng.choice(shared)
                a = rng.randrange(len(cut))
                parts.append(cut[a : a + rng.randint(90, 200)])
        docs.append((d, rng.choice(["", " ", "x"]).join(parts)))
    docs += [(n, "a" * 500), (n + 1, "ab" * 300 + "c" + "ab" * 300), (n + 2, "a" * 99), (n + 3, "a" * 100), (n + 4, ""), (n + 5, None), (n + 6, docs[3][1])]
    return docs


def got(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("hot, batch_hot", [(4096, 256), (2, 1), (3, 100), (100, 2)])
def test_removed_is_what_every_string_says(spark, hot, batch_hot):
    docs = corpus(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(repeats.removed(df, hot, batch_hot)) == brute(docs)


def test_long_documents_cross_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 256)
    data = [t.encode() for _, t in corpus(2, 20) if t]
    joined = b"".join(data)
    import numpy as np

    ends = np.cumsum([len(x) for x in data])
    small = repeats.anchors(np.frombuffer(joined, np.uint8), ends - [len(x) for x in data], ends)
    monkeypatch.setattr(repeats, "CHUNK", 1 << 20)
    large = repeats.anchors(np.frombuffer(joined, np.uint8), ends - [len(x) for x in data], ends)
    for a, b in zip(small, large):
        assert (a == b).all()


def test_null_and_repeated_ids(spark):
    p = " ".join(f"word{i}" for i in range(40))
    rows = [(1, p), (1, p), (None, p), (None, None), (2, "short"), (2, p + " more")]
    out = {}
    for r in repeats.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out.setdefault((r.doc_id, r.n_bytes), []).append(r.n_removed)
    n = len(p)
    assert out[(1, n)] == [0, 0]  # one document, twice
    assert out[(None, n)] == [n] and out[(None, 0)] == [0] and out[(2, 5)] == [0]
    assert out[(2, n + 5)] == [n]


def test_groups_hold_all_occurrences(spark):
    docs = [(d, t) for d, t in corpus(3, 25) if t]
    df = repeats.numbered(spark.createDataFrame(docs, "doc_id long, text string"))
    text = {d: t.encode() for d, t in docs}
    groups = {}
    for r in repeats.repeat_groups(df).collect():
        groups.setdefault(r.repeat, set()).add((r.dk, r.start, r.length))
    assert groups
    for members in groups.values():
        strings = {text[d][s : s + n] for d, s, n in members}
        assert len(strings) == 1 and len(members) > 1 and len(strings.pop()) >= LEAST


@pytest.mark.parametrize("hot", [4096, 3, 0])
def test_groups_miss_no_repeated_passage(spark, hot):
    twin = " ".join(f"twin{i}" for i in range(60))
    line = " ".join(f"line{i}" for i in range(18))
    docs = [(d, t) for d, t in corpus(4, 12) if t]
    docs += [(200, twin), (201, twin), (202, twin)]  # equal documents: one context only
    docs += [(300 + i, f"{i * i} before {line} after {i * 7}") for i in range(6)]  # one line in many contexts
    places = {}
    for d, t in docs:
        b = t.encode()
        for i in range(len(b) - LEAST + 1):
            places.setdefault(b[i : i + LEAST], set()).add((d, i))
    df = repeats.numbered(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    text, groups = {d: t.encode() for d, t in docs}, {}
    rows = repeats.repeat_groups(df, hot).collect()
    for r in rows:
        groups.setdefault((r.repeat, r.length), set()).add((r.dk, r.start))
    assert len(rows) == sum(map(len, groups.values()))
    listed = set()
    for (_, n), members in groups.items():
        (whole,) = {text[d][s : s + n] for d, s in members}
        # all occurrences of the group's string, and with it of the passages inside that occur nowhere else
        assert members == {(d, s) for d, s in places[whole[:LEAST]] if text[d][s : s + n] == whole}
        for i in range(n - LEAST + 1):
            if places[whole[i : i + LEAST]] == {(d, s + i) for d, s in members}:
                listed.add(whole[i : i + LEAST])
    assert listed == {w for w, p in places.items() if len(p) > 1}


def test_stage_keeps_columns_and_whole_characters(spark):
    p = "é" * 80
    rows = [(1, p, "dk of its own", 5), (2, "x" + p + "tail", None, 6)]
    out = repeats.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, dk string, spans int"))
    assert out.columns == ["doc_id", "text", "dk", "spans"]
    found = {r.doc_id: r for r in out.collect()}
    assert found[1].text.startswith("é") and found[2].text == "xtail" and found[1].dk == "dk of its own" and found[2].spans == 6


def test_empty_table(spark):
    assert got(repeats.removed(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_columns_of_any_name_are_kept_when_ids_repeat(spark):
    long = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(400))
    names = ["__t", "t", "row", "dk", "spans", "no_id"]
    rows = [(1, long, *(f"{n}1" for n in names)), (1, "other " + long[:150], *(f"{n}2" for n in names)), (None, long, *names)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = repeats.deduplicated(df)
    assert out.columns == df.columns
    assert {tuple(r)[2:] for r in out.collect()} == {r[2:] for r in rows}


def test_partitions_follow_the_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * 1000) for i in range(100)] + [(100, None)], "doc_id long, text string")
    assert repeats.partitions_for(df) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(repeats, "PART_BYTES", 4000)
    assert repeats.partitions_for(df) == 25 and repeats.partitions_for(df.where("false")) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert repeats.removed(df).where("n_removed = 0").count() == 1  # the null text; the others repeat themselves
