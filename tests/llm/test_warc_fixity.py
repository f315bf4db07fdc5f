import hashlib

from pyspark.sql import functions as F

from cellweave.llm import warc_fixity as W


def pages(spark, n=700):
    rows = [(i, f"http://site/{i}", f"<p>é {'x' * (i * 37 % 900)}</p>", "extra", i) for i in range(n)]
    rows += [(None, None, None, None, None), (5, "http://site/5", None, "extra", 1), (5, "http://site/5", "", "extra", 1), (3, "http://site/3", rows[3][2], "e", 0), (900, "u", "z" * 300_000, "e", 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, bytes string, offset long").repartition(4)


def stored(df):
    index = W.archived(df)
    rec = W.record(F.col("page_id"), F.col("url"), F.col("html"))
    content = df.select(F.sha2(rec, 256).alias("order"), rec.alias("bytes")).dropDuplicates(["order"])
    return index.join(content, "order").select("offset", "bytes")


def test_archive_is_gapless(spark):
    rows = sorted(W.archived(pages(spark)).collect(), key=lambda r: r.offset)
    at = 0
    for r in rows:
        assert r.offset == at
        at += r.length
    assert len(rows) == 705


def test_record_is_warc(spark):
    one = spark.createDataFrame([(1, "http://a/é", "<b>é</b>")], "page_id long, url string, html string")
    raw = bytes(one.select(W.record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).first().r).decode()
    head, block = raw.split("\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
    assert head.startswith("WARC/1.1\r\n") and fields["WARC-Type"] == "response" and fields["WARC-Target-URI"] == "http://a/é"
    assert fields["WARC-Date"].endswith("Z") and fields["Content-Type"] == "application/http; msgtype=response" and fields["WARC-Record-ID"].startswith("<urn:uuid:")
    http = block.removesuffix("\r\n\r\n")
    assert len(http.encode()) == int(fields["Content-Length"])
    status, body = http.split("\r\n\r\n", 1)
    assert status.startswith("HTTP/1.1 200 OK\r\n") and "Content-Length: 9" in status and body == "<b>é</b>"


def test_a_very_long_page_is_one_record(spark):
    df = spark.createDataFrame([(1, "u", "x" * 3_000_000), (2, "v", "y")], "page_id long, url string, html string")
    bad = W.fixity(df, stored(df).where("offset > 0").select("offset", "bytes")).collect()
    assert [(r.page_id, r.status, r.length > 3_000_000) for r in bad] == [(1, "missing", True)]


def test_equal_replicas_have_no_damage(spark):
    df = pages(spark)
    assert W.fixity(df, stored(df)).collect() == []


def test_changed_missing_and_extra_records_are_found(spark):
    df = pages(spark)
    good = stored(df)
    rows = sorted(((r.offset, bytes(r.bytes)) for r in good.collect()))
    changed, gone, extra = {rows[0][0], rows[333][0], rows[-1][0]}, {rows[10][0], rows[11][0]}, 10**9
    bad = [(o, b + b"!" if o in changed else b) for o, b in rows if o not in gone] + [(extra, b"what")]
    found = W.fixity(df, spark.createDataFrame(bad, "offset long, bytes binary")).collect()
    assert {(r.offset, r.status) for r in found} == {*((o, "changed") for o in changed), *((o, "missing") for o in gone), (extra, "extra")}
    text = dict(rows)
    for r in found:
        if r.offset in changed:
            assert r.expected == hashlib.sha256(text[r.offset]).hexdigest() and r.found == hashlib.sha256(text[r.offset] + b"!").hexdigest()


def test_only_differing_branches_are_read(spark):
    df = pages(spark)
    leaves = W.archived(df).select("offset", F.col("order").alias("digest"))
    end = leaves.agg(F.max("offset")).first()[0]
    one, two = (W.tree(leaves.withColumn("digest", d), W.levels_of(end)) for d in (F.col("digest"), F.when(F.col("offset") == 0, "x").otherwise(F.col("digest"))))
    assert one[-1].count() == 1 and len(one) > 2
    differ = [{r.node for r in W.differing(a, b).collect()} for a, b in zip(one, two)]
    assert all(d == {0} for d in differ)


def test_empty_archives(spark):
    df = pages(spark)
    none = df.where("false")
    empty = spark.createDataFrame([], "offset long, bytes binary")
    assert W.fixity(none, empty).collect() == []
    assert {r.status for r in W.fixity(df, empty).collect()} == {"missing"} and W.fixity(df, empty).count() == 705
    assert [r.status for r in W.fixity(none, spark.createDataFrame([(0, b"x")], "offset long, bytes binary")).collect()] == ["extra"]
