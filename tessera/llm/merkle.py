"""Merkle fixity audit of WARC replicas.

Records are grouped into archives by ranges of their ids and follow each other by id, so each has a
place in its archive's tree, a byte offset and a length. A leaf hashes its record's digest; a node
hashes its children in order. Besides this content hash every node has a placed hash, which also
covers the offsets of the records below, so a node vouches for an ordered range of offsets.

An audit compares the roots of two replicas and descends only below nodes whose content differs, one
join per level. At the bottom it finds the damaged records: ``changed`` (other bytes), ``missing``
and ``extra``. Where a node's content agrees but its placed hash does not, its records are sound and
merely lie elsewhere, behind a record that changed its length: the node is reported once as
``moved``, as a range, and not entered. Sound archives cost one comparison each, and the report
grows with the damage, not with what lies behind it.

A node has at most ``FANOUT`` children and an archive at most ``ARCHIVE`` ids; what shares a leaf is
summed before it is dealt, so no group is larger than that, whatever hosts or copies the pages have.
Every level is stored once, with the replicas side by side, and only below nodes that differ.

Defined results: records without an id get archives and places by their digest; null urls and bodies
count as empty, very long bodies are hashed whole; records that share an id share a leaf, whose content
is their number and the sums of their digests' parts, and ``copies`` tells which of them differ; empty
tables have no archives; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

FANOUT = 8
ARCHIVE = 512


#: The date that records carry where the table has none.
DATE = "1970-01-01T00:00:00Z"


def record_id(key: Column) -> Column:
    """A URN in the form of a UUID, made from the record's id."""
    h = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record_bytes(key: Column, url: Column, body: Column, date: str = DATE) -> Column:
    """A resource record in the form of WARC 1.1, with the headers that it demands."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: "), record_id(key), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", per_archive: int = ARCHIVE) -> DataFrame:
    """archive, place, id, bytes and digest of every record."""
    record = record_bytes(F.col(key), F.col(url), F.col(body))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.octet_length(record).cast("long").alias("bytes"), F.sha2(record, 256).alias("digest"))
    number = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")  # stands in for a missing id
    archive = F.when(F.col("id").isNull(), F.concat(F.lit("none-"), F.substring("digest", 16, 4))).otherwise(F.floor(F.col("id") / per_archive).cast("string"))
    return rows.withColumn("archive", archive).withColumn("place", F.pmod(F.coalesce("id", number), F.lit(per_archive)))


def manifest(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", per_archive: int = ARCHIVE) -> DataFrame:
    """The leaves: archive, place, id, n (records), content, placed, low (offset) and length.

    Records that share a leaf meet as sums of the quarters of their digests, which are added up before
    they are dealt, so an id that a third of all records have is no group that a task must hold.
    """
    quarters = [F.sum(F.conv(F.substring("digest", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"q{i}") for i in range(4)]
    rows = records(pages, key, url, body, per_archive)
    leaves = rows.groupBy("archive", "place").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.sum("bytes").alias("length"), F.min("digest").alias("one"), *quarters)
    shared = F.sha2(F.concat_ws(":", "n", *[F.col(f"q{i}").cast("string") for i in range(4)]), 256)
    leaves = leaves.withColumn("content", F.when(F.col("n") == 1, F.col("one")).otherwise(shared)).drop("one", *[f"q{i}" for i in range(4)])
    before = W.partitionBy("archive").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    low = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return leaves.withColumn("low", low).withColumn("placed", F.sha2(F.concat_ws(":", "low", "length", "content"), 256))


def copies(first: DataFrame, second: DataFrame, found: DataFrame) -> DataFrame:
    """Which of the records (``records`` of either replica) below damaged leaves of ``found`` differ.

    archive, place, id, digest, copies_a and copies_b, where these are not equal: the last step of the
    descent, for leaves that several records share.
    """
    below = found.where("level = 0 AND status = 'changed' AND n > 1").select("archive", "place").distinct()
    both = first.withColumn("side", F.lit("a")).unionByName(second.withColumn("side", F.lit("b"))).join(below, ["archive", "place"], "left_semi")
    counts = [F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(f"copies_{s}") for s in "ab"]
    return both.groupBy("archive", "place", "id", "digest").agg(*counts).where("copies_a <> copies_b")


def _hash_of(children: Column, field: str) -> Column:
    shown = F.transform(children, lambda x: F.concat(x["place"].cast("string"), F.lit(":"), x[field]))
    return F.sha2(F.array_join(shown, ","), 256).alias(field)


def tree(leaves: DataFrame, per_archive: int = ARCHIVE, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves to the roots, each stored: side, archive, place, n, content, placed, low and length of the range below."""
    levels = [leaves.select("side", "archive", "place", "n", "content", "placed", "low", "length")]
    width = per_archive
    while width > 1:
        children = F.array_sort(F.collect_list(F.struct("place", "content", "placed")))
        joined = {c: _hash_of(children, c) for c in ("content", "placed")}
        above = levels[-1].groupBy("side", "archive", F.floor(F.col("place") / fanout).alias("place"))
        levels.append(common.cut(above.agg(F.sum("n").alias("n"), *joined.values(), F.min("low").alias("low"), F.sum("length").alias("length")), "level"))
        width = -(-width // fanout)
    return levels


@common.tidy
def audit(first: DataFrame, second: DataFrame, per_archive: int = ARCHIVE, fanout: int = FANOUT) -> DataFrame:
    """What differs between the manifests of two replicas.

    archive, level (0: a record), place at that level, status, id (of a record), n (records), and the
    offset and length of the range in either replica.
    """
    leaves = common.cut(first.withColumn("side", F.lit("a")).unionByName(second.withColumn("side", F.lit("b"))), "replicas")
    levels = tree(leaves, per_archive, fanout)
    found, below = [], None
    for level in range(len(levels) - 1, -1, -1):
        sides = []
        for name in "ab":
            nodes = levels[level].where(F.col("side") == name)
            if below is not None:
                nodes = nodes.withColumn("parent", F.floor(F.col("place") / fanout)).join(below, ["archive", "parent"], "left_semi")
            sides.append(nodes.select("archive", "place", *[F.col(c).alias(f"{c}_{name}") for c in ("n", "content", "placed", "low", "length")]))
        both = sides[0].join(sides[1], ["archive", "place"], "full").where(~F.col("placed_a").eqNullSafe(F.col("placed_b")))
        both = common.cut(both, "nodes")
        same = F.col("content_a").eqNullSafe(F.col("content_b"))
        status = F.when(same, "moved").when(F.col("content_a").isNull(), "extra").when(F.col("content_b").isNull(), "missing").otherwise("changed")
        rows = both.withColumn("level", F.lit(level)).withColumn("status", status)
        found.append(rows if level == 0 else rows.where(same))
        below = both.where(~same).select(F.col("archive"), F.col("place").alias("parent"))
    records = leaves.groupBy("archive", "place").agg(F.min("id").alias("id")).withColumn("level", F.lit(0))
    out = reduce(DataFrame.unionByName, found)
    damaged = out.where("level = 0").select("archive", "place").distinct()
    records = records.join(damaged, ["archive", "place"], "left_semi")
    return out.join(records, ["archive", "place", "level"], "left").select(
        "archive", "level", "place", "status", "id", F.coalesce("n_a", "n_b").alias("n"),
        F.col("low_a").alias("offset_a"), "length_a", F.col("low_b").alias("offset_b"), "length_b",
    )
