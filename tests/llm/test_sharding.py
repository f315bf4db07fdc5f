import math
import random
import zlib
from collections import Counter

from cellweave.llm import sharding


def test_hypergeometric_follows_its_law():
    rng, good, bad, draws = random.Random(1), 7, 12, 6
    seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(20_000))
    for k in range(0, 7):
        p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
        assert abs(seen[k] / 20_000 - p) < 5 * math.sqrt(p * (1 - p) / 20_000) + 1e-4
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3
    big = [sharding.hypergeometric(rng, 10**11, 10**11, 10**6) for _ in range(200)]
    assert abs(sum(big) / 200 - 500_000) < 5 * 500 / math.sqrt(200)


def test_matrix_has_both_margins():
    m = sharding.communication_matrix([5, 0, 17, 30], [18, 17, 17], 3)
    assert [sum(r) for r in m] == [5, 0, 17, 30] and [sum(c) for c in zip(*m)] == [18, 17, 17]


def frame(spark, n=1003):
    rows = [(d, "same text" if d % 3 == 0 else f"text é {d}" * (d % 4), "extra", d) for d in range(n)]
    rows += [(None, None, None, None), (None, None, None, None), (1, "text é 1", "x", 0), (1, "text é 1", "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, slot string, part long").repartition(5)


def test_shards_are_exact_and_gapless(spark):
    df = frame(spark)
    rows = sharding.shuffled(df, partition_rows=64).collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards[s]) for s in range(8)]
    assert sum(sizes) == df.count() and max(sizes) - min(sizes) <= 1
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect()), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=repr) == want


def test_reruns_agree(spark):
    df = frame(spark)
    assert sorted(sharding.shuffled(df).collect(), key=repr) == sorted(sharding.shuffled(df.repartition(3, "text")).collect(), key=repr)


def test_shuffle_looks_uniform(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    shard, pair, early = Counter(), Counter(), Counter()
    for seed in range(3):
        rows = {r.doc_id: r for r in sharding.shuffled(df, shards=4, seed=seed).collect()}
        for d in range(0, 4000, 2):
            shard[rows[d].shard] += 1
            pair[rows[d].shard == rows[d + 1].shard] += 1
            early[rows[d].slot < rows[d + 1].slot] += 1
    assert all(abs(n - 1500) < 5 * math.sqrt(6000 * 0.25 * 0.75) for n in shard.values())
    assert abs(pair[True] - 1500) < 5 * math.sqrt(6000 * 0.25 * 0.75)
    assert abs(early[True] - 3000) < 5 * math.sqrt(6000 * 0.25)


def test_few_rows_and_empty_table(spark):
    df = frame(spark).limit(3)
    assert sharding.shuffled(df).count() == 3
    assert sharding.shuffled(df.where("false")).collect() == []


def test_shuffle_matches_brute_force_on_the_same_draws(spark):
    """The whole shuffle again in plain Python: partitions, permutation, runs of the drawn matrix, second permutation."""
    import xxhash

    def spark_hash(values, seed=42):
        h = seed
        for v in values:
            if v is None:
                continue
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
        return h

    rng = random.Random(1)
    texts = [None, "", *("".join(rng.choice("ab é") for _ in range(rng.randint(0, 30))) for _ in range(300))]
    rows = [(d, t) for d, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seed, shards, parts = 11, 8, sharding.LEAST_PARTITIONS
    as_int = lambda s: int(s).to_bytes(4, "little", signed=True)
    first = lambda s: xxhash.xxh64_intdigest(as_int(s), 42)  # noqa: E731  Spark hashes an int literal as four bytes
    docs = []
    for d, t in rows:
        body = (t or "").encode()
        values = (d, len(body) + 1, zlib.crc32(body))
        h = [spark_hash(values, first(seed + k)) for k in range(3)]
        signed = h[0] - (1 << 64) if h[0] >> 63 else h[0]
        docs.append((d, values[1], values[2], signed % parts, h[1] >> 1, h[2] >> 1))
    by = {}
    for r in docs:
        by.setdefault(r[3], []).append(r)
    total = len(docs)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = sharding.communication_matrix([len(by[p]) for p in sorted(by)], sizes, seed)
    placed = {s: [] for s in range(shards)}
    for p, runs in zip(sorted(by), matrix):
        mine = sorted(by[p], key=lambda r: (r[4], r[0]))
        at = 0
        for s, n in enumerate(runs):
            placed[s] += mine[at : at + n]
            at += n
    want = {r[0]: (s, k) for s, some in placed.items() for k, r in enumerate(sorted(some, key=lambda r: (r[5], r[0])))}
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffled(df).collect()}
    assert got == want
