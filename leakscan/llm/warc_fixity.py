"""Fixity audit of WARC replicas with Merkle trees.

Pages become WARC records, dealt to archives by their id and ordered within them, so every record has an
offset range. Record hashes are the leaves of one tree per archive; a node hashes FANOUT children
and covers their joint range. Two replicas are compared from the roots down: only the children of nodes that differ are
looked at, so equal archives cost one comparison, and what differs is located by its range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from leakscan.llm.common import materialize, null_safe

FANOUT = 16
ARCHIVE_RECORDS = 1024


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC 1.0 resource record. Null fields are written as empty."""
    body = F.coalesce(html, F.lit(""))
    name = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))))
    head = [
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:md5:"), name, F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    ]
    return F.concat(*head, body, F.lit("\r\n\r\n"))


def archive_count(n_records: int) -> int:
    return max(1, -(-n_records // ARCHIVE_RECORDS))


def archive_of(page_id: Column, archives: int) -> Column:
    """Archive by 32 bits of the MD5 of the id; rows without id are spread by their own hash instead (see ``leaves``)."""
    return F.pmod(F.conv(F.substring(F.md5(page_id.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(archives)).cast("int")


@dataclass
class Tree:
    """``leaves``: archive, place, page_id, offset, length, copies, hash. ``levels[0]`` are the lowest inner nodes, the last are roots."""

    leaves: DataFrame
    levels: list[DataFrame]


def leaves(pages: DataFrame, archives: int) -> DataFrame:
    """Ordered records with their hashes and ranges. Equal rows are counted first and stand together as one leaf."""
    record = record_bytes(pages["page_id"], pages["url"], pages["html"])
    hashed = pages.select(pages["page_id"], F.octet_length(record).cast("long").alias("length"), F.sha2(F.concat(F.lit("record|"), record), 256).alias("digest"))
    spread = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(archives)).cast("int")
    counted = hashed.groupBy(F.coalesce(archive_of(F.col("page_id"), archives), spread).alias("archive"), "page_id", "length", "digest").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("archive").orderBy("page_id", "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(
        "archive", "page_id", "length", "copies",
        (F.row_number().over(order) - 1).alias("place"),
        F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)).alias("offset"),
        F.sha2(F.concat_ws("|", "digest", "copies"), 256).alias("hash"),
    )


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level: FANOUT neighbours become one node."""
    children = F.sort_array(F.collect_list(F.struct("place", "hash")))
    return nodes.groupBy("archive", F.expr(f"place div {FANOUT}").cast("int").alias("place")).agg(
        F.sha2(F.concat(F.lit("node|"), F.array_join(F.transform(children, lambda c: c["hash"]), "|")), 256).alias("hash"),
        F.min("offset").alias("offset"), F.max("end").alias("end"),
    )


def build(pages: DataFrame, archives: int) -> Tree:
    """The trees of one replica, written level by level. Pages are (page_id, url, html); more columns are ignored."""
    own = materialize(leaves(pages, archives), "leaves")
    level, levels = own.select("archive", "place", "hash", "offset", (F.col("offset") + F.col("length") * F.col("copies")).alias("end")), []
    most = own.agg(F.max("place")).first()[0] or 0
    while True:
        level = materialize(_parents(level), "level")
        levels.append(level)
        most //= FANOUT
        if not most:
            return Tree(own, levels)


def _padded(tree: Tree, height: int) -> Tree:
    """The same tree with single-child levels on top."""
    while len(tree.levels) < height:
        tree.levels.append(materialize(_parents(tree.levels[-1]), "level"))
    return tree


def _children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    return nodes.withColumn("parent", F.expr(f"place div {FANOUT}").cast("int")).join(parents, ["archive", "parent"], "left_semi").drop("parent")


def audit(primary: Tree, replica: Tree) -> DataFrame:
    """What differs: ``archive``, ``page_id``, ``kind`` (changed, missing, extra), ``offset`` and ``length`` in the replica that has it.

    ``copies`` of ``primary`` and ``replica`` count equal records. An empty result means that all roots agree.
    Ranges of the primary are given where it has the record. After an insertion or a loss the rest of its archive is
    compared record by record, as places have moved. A page that occurs with several contents is listed by content, as
    missing and extra.
    """
    height = max(len(primary.levels), len(replica.levels))
    a, b = _padded(primary, height), _padded(replica, height)
    wrong = None
    for left, right in zip(reversed(a.levels), reversed(b.levels), strict=True):
        if wrong is not None:
            parents = wrong.withColumnRenamed("place", "parent")
            left, right = _children(left, parents), _children(right, parents)
        both = left.select("archive", "place", F.col("hash").alias("x")).join(right.select("archive", "place", F.col("hash").alias("y")), ["archive", "place"], "full")
        wrong = materialize(both.where("not (x <=> y)").select("archive", "place"), "wrong")
    parents = wrong.withColumnRenamed("place", "parent")
    left, right = (_children(t.leaves, parents).withColumn("id", null_safe(F.col("page_id"))) for t in (a, b))
    # equal records cancel out first, so that what is left of an archive is only what differs
    missing = left.join(right.select("archive", "id", "hash"), ["archive", "id", "hash"], "left_anti")
    extra = right.join(left.select("archive", "id", "hash"), ["archive", "id", "hash"], "left_anti")
    single = lambda side: side.withColumn("turn", F.row_number().over(Window.partitionBy("archive", "id").orderBy("place")))
    x, y = single(missing).alias("x"), single(extra).alias("y")
    pairs = x.join(y, ["archive", "id", "turn"], "full")
    kind = F.when(F.col("y.hash").isNull(), "missing").when(F.col("x.hash").isNull(), "extra").otherwise("changed")
    return pairs.select(
        "archive", F.coalesce("x.page_id", "y.page_id").alias("page_id"), kind.alias("kind"),
        F.coalesce("x.offset", "y.offset").alias("offset"), F.coalesce("x.length", "y.length").alias("length"),
        F.coalesce("x.copies", F.lit(0)).alias("primary_copies"), F.coalesce("y.copies", F.lit(0)).alias("replica_copies"),
    )


def damaged(pages: DataFrame) -> DataFrame:
    """A replica for drills: by the MD5 of its id, one page of 256 has a changed first character and one of 256 is lost."""
    mark = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    changed = F.concat(F.lit("#"), F.substr("html", F.lit(2)))
    return pages.where(F.coalesce(mark != "01", F.lit(True))).withColumn("html", F.when(mark == "00", changed).otherwise(F.col("html")))


def fixity_report(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """``audit`` of two tables of pages. Both are dealt to as many archives as the first needs."""
    archives = archive_count(pages.count())
    return audit(build(pages, archives), build(replica, archives))
