"""Merkle fixity audit of WARC replicas.

An archive is a sequence of records at known offsets. Leaves are the SHA-256 digests of the records. A node of the first level
covers a range of ``RANGE`` bytes of offsets and hashes, in offset order, the records that start in it; a node of every further
level covers ``FAN`` nodes of the level before. Records never get longer in a range than they are, so a node has a bounded
number of children. Two replicas with equal roots are equal. Otherwise the audit goes down level by level and looks only at
the children of nodes that differ, until it has the records that are changed, missing or extra.

Defined results: null url or html is empty; null ids come first; records of one id are ordered by url and content, and equal
records are archived as often as they occur; an empty archive has no root, and a replica of it has only extra records; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import materialize
from cellweave.scale import running_totals, sized

RANGE = 1 << 16
FAN = 16


#: The pages carry no time of retrieval; a record must have one.
DATE = "1970-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record, as binary, of a page: header, then the HTTP response as its block."""
    key = F.md5(F.concat_ws("|", page_id.cast("string"), url))
    uuid = F.concat_ws("-", *[F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    body = F.coalesce(html, F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, http, body, F.lit("\r\n\r\n")).cast("binary")


def archived(pages: DataFrame) -> DataFrame:
    """The index of an archive of all pages in id order: page_id, url, position (from 1), offset, length."""
    rec = record(F.col("page_id"), F.col("url"), F.col("html"))
    sizes = pages.select("page_id", "url", F.octet_length(rec).cast("long").alias("length"), F.sha2(rec, 256).alias("order"), F.lit(1).cast("long").alias("one"))
    ends = running_totals(sizes, [], ["page_id", "url", "order"], {"end": "length", "position": "one"})
    return materialize(ends.select("page_id", "url", "order", "position", (F.col("end") - F.col("length")).alias("offset"), "length"))


def levels_of(index_end: int) -> int:
    """Levels above the records until one node covers all offsets."""
    levels, span = 1, RANGE
    while span < index_end:
        levels, span = levels + 1, span * FAN
    return levels


def tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """[records, first level, ..., root] as (node, digest, parent) from leaves (offset, digest); several records may share an offset."""
    out = [materialize(leaves.select(F.col("offset").alias("node"), "digest", F.expr(f"offset div {RANGE}").alias("parent")))]
    for _ in range(levels):
        inner = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat_ws(":", x["node"].cast("string"), x["digest"]))
        nodes = out[-1].groupBy("parent").agg(F.sha2(F.array_join(inner, "\n"), 256).alias("digest"))
        out.append(materialize(nodes.select(F.col("parent").alias("node"), "digest", F.expr(f"parent div {FAN}").alias("parent"))))
    return out


def differing(one: DataFrame, two: DataFrame) -> DataFrame:
    """(node, digest, found) where two sets of nodes differ; a missing side is null."""
    a = one.select("node", "digest")
    b = two.select("node", F.col("digest").alias("found"))
    return a.join(b, "node", "full").where("not (digest <=> found)")


def audit(one: list[DataFrame], two: list[DataFrame]) -> DataFrame:
    """(offset, digest, found) of the records that differ, reached through differing nodes only."""
    wrong = materialize(differing(one[-1], two[-1]))
    for a, b in zip(one[-2::-1], two[-2::-1]):
        above = sized(wrong.select(F.col("node").alias("parent")).distinct())
        wrong = materialize(differing(a.join(above, "parent", "left_semi"), b.join(above, "parent", "left_semi")))
    return wrong.select(F.col("node").alias("offset"), "digest", "found")


def fixity(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """Where a replica of the pages' archive is damaged: offset, length, page_id, url, status, expected and found SHA-256.

    ``replica`` has (offset, bytes), what is stored at the offsets of the archive's index, or (offset, digest), the SHA-256 of
    that, taken where the replica is read.
    """
    index = archived(pages)
    size = index.agg(F.max(F.col("offset") + F.col("length"))).first()[0] or 0
    levels = levels_of(max(size, replica.agg(F.max("offset")).first()[0] or 0))
    first = tree(index.select("offset", F.col("order").alias("digest")), levels)
    digest = F.col("digest") if "digest" in replica.columns else F.sha2("bytes", 256)
    second = tree(replica.select("offset", digest.alias("digest")), levels)
    bad = audit(first, second).withColumnRenamed("digest", "expected")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed")
    return bad.join(index.select("offset", "length", "page_id", "url"), "offset", "left").select("offset", "length", "page_id", "url", status.alias("status"), "expected", "found")


def damaged_copy(pages: DataFrame) -> DataFrame:
    """(offset, digest) of a copy of the archive in which one record in 32, told by a hash, has a byte more and one in 32 is gone.

    The copy's records are hashed where they are read, so that only digests move.
    """
    index = archived(pages)
    fate = F.substring(F.md5(F.concat_ws("|", F.col("page_id").cast("string"), F.col("url"))), 1, 2)
    rec = record(F.col("page_id"), F.col("url"), F.col("html"))
    copy = F.when(fate < "08", F.concat(rec, F.lit("\n").cast("binary"))).otherwise(rec)
    stored = pages.select("page_id", "url", F.sha2(rec, 256).alias("order"), F.sha2(copy, 256).alias("digest"), fate.alias("fate"))
    # equal records are told apart by nothing and have equal copies: one of them stands for all
    stored = stored.where("not fate between '08' and '0f'").dropDuplicates(["page_id", "url", "order"])
    keys = [index[k].eqNullSafe(stored[k]) for k in ("page_id", "url", "order")]
    return index.join(stored, keys[0] & keys[1] & keys[2]).select("offset", "digest")


#: The damage found, in SQL, for pages as a view.
SQL = r"""
WITH nl AS (SELECT chr(13) || chr(10) AS nl),
keyed AS (SELECT page_id, url, coalesce(html, '') AS body, md5(concat_ws('|', page_id, url)) AS k, nl FROM pages, nl),
blocks AS (SELECT *, 'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || CAST(strlen(body) AS VARCHAR) || nl || nl || body AS block FROM keyed),
records AS (SELECT page_id, url, k, 'WARC/1.1' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <urn:uuid:'
    || concat_ws('-', k[1:8], k[9:12], k[13:16], k[17:20], k[21:32]) || '>' || nl || 'WARC-Date: {date}' || nl || 'WARC-Target-URI: ' || coalesce(url, '')
    || nl || 'Content-Type: application/http; msgtype=response' || nl || 'Content-Length: ' || CAST(strlen(block) AS VARCHAR)
    || nl || nl || block || nl || nl AS rec FROM blocks),
placed AS (SELECT *, strlen(rec) AS length, sha256(rec) AS expected,
    sum(strlen(rec)) OVER (ORDER BY page_id NULLS FIRST, url NULLS FIRST, sha256(rec) ROWS UNBOUNDED PRECEDING) - strlen(rec) AS "offset" FROM records)
SELECT CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, page_id, url,
  CASE WHEN k[1:2] < '08' THEN 'changed' ELSE 'missing' END AS status, expected,
  CASE WHEN k[1:2] < '08' THEN sha256(rec || chr(10)) END AS found
FROM placed WHERE k[1:2] <= '0f'
""".replace("{date}", DATE)
