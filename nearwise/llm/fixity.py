"""Merkle fixity audit of WARC archives (built-in functions only).

Pages become WARC records in order of their ids (then of their digests), dealt into archives by ranges of
PER_ARCHIVE ids. Each record's SHA-256 is a leaf. A node stands for a range of keys: ids within an archive in
ranges of FANOUT, ranges of those, the archive, ranges of archives, the collection. It hashes, for its
children in order, the offsets they cover from its own start and their hashes, "start:stop:hash". Ranges are
of keys and offsets are relative, so a record that is lost, added or longer changes the nodes above it and no
others. Replicas build their trees by themselves; they are compared from the roots down, and only below
nodes that differ: what is read there is the damaged branches, not the records. Among the records of one id
that only one replica has, as many as the other has too are corrupt; the rest is missing or extra.

Equal records are one leaf with a number of copies. Where some id has more than MANY different records, all
trees have more levels below the ids, by digits of the records' digests, so no node has many children.

Defined cases: null url or html are empty; pages without an id are written with an empty one into an archive of
their own (`none`), apart from negative ids; rows with the same id are records of their own; an empty replica
has no root and every record of the other is missing from it; an empty primary has none, and the replica's are
extra; ids are whole numbers; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, save

FANOUT, PER_ARCHIVE, MANY = 16, 1000, 64
KEY = ["none", "archive", "place", "prefix"]


def warc_record(id_: Column, url: Column, body: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), text(id_), F.lit(">\r\nWARC-Target-URI: "), text(url),
        F.lit("\r\nContent-Length: "), F.octet_length(text(body)).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, text(body), F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, *, id_col="page_id", url_col="url", body_col="html", per_archive: int = PER_ARCHIVE) -> DataFrame:
    """id, none, archive, place (of the id in its archive), hash, size (bytes), copies of each different record."""
    record = warc_record(F.col(id_col), F.col(url_col), F.col(body_col))
    id_ = F.col(id_col).cast("long")
    rows = pages.select(id_.alias("id"), F.octet_length(record).cast("long").alias("size"), F.sha2(record.cast("binary"), 256).alias("hash"))
    rows = rows.groupBy("id", "hash", "size").agg(F.count("*").alias("copies"))
    zero = F.lit(0).cast("long")
    archive, place = F.floor(F.col("id") / per_archive).cast("long"), F.pmod("id", F.lit(per_archive)).cast("long")
    return save(rows.select("id", F.col("id").isNull().alias("none"), F.coalesce(archive, zero).alias("archive"), F.coalesce(place, zero).alias("place"), "hash", "size", "copies"))


def offsets(leaf: DataFrame) -> DataFrame:
    """The leaves with the bytes that they cover in their archives, `start` to `stop`, all copies together."""
    size = F.col("size") * F.col("copies")
    group = [*KEY[:3], "digit"]
    rows = leaf.withColumn("digit", F.substring("hash", 1, 3))
    sums = rows.groupBy(*group).agg(F.sum(size).alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("none", "archive").orderBy("place", "digit")) - F.col("bytes")
    rows = rows.join(sums.select(*group, before.alias("before")), group)
    stop = F.col("before") + F.sum(size).over(Window.partitionBy(*group).orderBy("hash"))
    return rows.select(*leaf.columns, (stop - size).alias("start"), stop.alias("stop"))


def _fold(level: DataFrame, up: dict[str, Column]) -> DataFrame:
    """A level's nodes -> their parents, whose keys `up` gives."""
    level = level.select("side", *[up.get(c, F.col(c)).alias(f"up_{c}") for c in KEY], F.struct(*KEY, "hash", "size", "copies").alias("child"))
    children = level.groupBy("side", *[f"up_{c}" for c in KEY]).agg(F.array_sort(F.collect_list("child")).alias("children"))  # FANOUT x MANY at most
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))

    def add(held: Column, child: Column) -> Column:
        stop = held.at + child["size"] * child["copies"]
        return F.struct(stop.alias("at"), F.concat(held.text, held.at.cast("string"), F.lit(":"), stop.cast("string"), F.lit(":"), child["hash"], F.lit("\n")).alias("text"))

    node = F.aggregate("children", first, add)
    folded = children.select("side", *[F.col(f"up_{c}").alias(c) for c in KEY], node.alias("node"))
    return folded.select("side", *KEY, F.sha2(F.col("node.text").cast("binary"), 256).alias("hash"), F.col("node.at").alias("size"), F.lit(1).cast("long").alias("copies"))


def _ups(most: int, widest: int, archives: int) -> list[dict[str, Column]]:
    """How keys of the parents follow from those of a level, from the leaves to the root: of `most` different
    records with one id, places up to `widest` and archives up to `archives` (or, below zero, one less)."""
    zero, digits = F.lit(0).cast("long"), 0
    while most > MANY * 16**digits:
        digits += 1
    ups = [{"prefix": F.substring("prefix", 1, n)} for n in range(digits, -1, -1)] if digits else []
    while widest:
        ups.append({"place": F.floor(F.col("place") / FANOUT).cast("long")})
        widest //= FANOUT
    while archives:
        ups.append({"archive": F.floor(F.col("archive") / FANOUT).cast("long")})
        archives //= FANOUT
    return [*ups, {"none": F.lit(False), "archive": zero, "place": zero}]


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Two tables of leaves -> none, archive, place, hash, corrupt, missing, extra of the records that differ:
    how many copies of the primary's are corrupt in or missing from the replica, how many only that has."""
    sides = primary.withColumn("side", F.lit(0)).unionByName(replica.withColumn("side", F.lit(1)))
    far = F.greatest(F.col("archive"), -F.col("archive") - 1)
    shape = sides.groupBy("side", "id").agg(F.count("*").alias("n"), F.max("place").alias("place"), F.max(far).alias("far")).agg(F.max("n"), F.max("place"), F.max("far")).first()
    ups = _ups(*(x or 0 for x in shape))
    digits = sum("prefix" in up for up in ups)
    level = sides.withColumn("prefix", F.substring("hash", 1, max(0, digits - 1))).select("side", *KEY, "hash", "size", "copies")
    levels = [level]
    for up in ups:
        level = save(_fold(level, up))
        levels.append(level)
    bad = None
    for n in range(len(levels) - 1, -1, -1):
        level = levels[n]
        if bad is not None:
            level = level.withColumns({f"up_{c}": ups[n].get(c, F.col(c)) for c in KEY})
            level = attach(level, bad.select(*[F.col(c).alias(f"up_{c}") for c in KEY]), [f"up_{c}" for c in KEY], "left_semi")
        own = [*KEY, *["hash"] * (n == 0)]
        value = F.col("copies" if n == 0 else "hash")
        both = level.groupBy(*own).agg(*[F.max(F.when(F.col("side") == k, value)).alias(c) for k, c in ((0, "ours"), (1, "theirs"))])
        bad = save(both.where(~F.col("ours").eqNullSafe(F.col("theirs"))))
        if n and bad.isEmpty():
            n = 0
            bad = save(levels[0].limit(0).select(*KEY, "hash", F.lit(0).cast("long").alias("ours"), F.lit(0).cast("long").alias("theirs")))
            break
    zero = F.lit(0).cast("long")
    ours, theirs = (F.coalesce(F.col(c), zero) for c in ("ours", "theirs"))
    bad = bad.select(*KEY, "hash", F.greatest(ours - theirs, zero).alias("lost"), F.greatest(theirs - ours, zero).alias("gained"))
    of_id = Window.partitionBy(*KEY[:3])
    both = F.least(F.sum("lost").over(of_id), F.sum("gained").over(of_id))
    upto = lambda c: F.sum(c).over(of_id.orderBy("hash"))
    paired = lambda c: F.greatest(zero, F.least(F.col(c), F.col("both") - F.col(f"{c}_upto") + F.col(c)))
    bad = bad.withColumns({"both": both, "lost_upto": upto("lost"), "gained_upto": upto("gained")})
    return bad.select(*KEY[:3], "hash", paired("lost").alias("corrupt"), (F.col("lost") - paired("lost")).alias("missing"), (F.col("gained") - paired("gained")).alias("extra"))


def audited(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """id, archive, start, stop (bytes in the primary's archive), hash, status, records: the primary's records that
    are intact in the replica, corrupt or missing there, and (without offsets) those that only the replica has."""
    found = save(audit(primary, replica))
    key = [*KEY[:3], "hash"]
    rows = attach(offsets(primary), found, key, "left").fillna(0, ["corrupt", "missing"])
    intact = F.col("copies") - F.col("corrupt") - F.col("missing")
    each = [F.struct(F.lit(status).alias("status"), n.alias("records")) for status, n in (("intact", intact), ("corrupt", F.col("corrupt")), ("missing", F.col("missing")))]
    rows = rows.select("id", "none", "archive", "start", "stop", "hash", F.explode(F.filter(F.array(*each), lambda e: e.records > 0)).alias("e"))
    nowhere = F.lit(None).cast("long")
    extra = attach(replica, found.where("extra > 0"), key).select("id", "none", "archive", nowhere.alias("start"), nowhere.alias("stop"), "hash", F.struct(F.lit("extra").alias("status"), F.col("extra").alias("records")).alias("e"))
    archive = F.when(~F.col("none"), F.col("archive")).alias("archive")
    return rows.unionByName(extra).select("id", archive, "start", "stop", "hash", "e.*")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica for trying the audit: of 50 pages one has lost its first character and gained one, one is lost,
    and one is there under another id as well."""
    digest = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    hit = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % 50
    html = F.when(hit == 7, F.concat(F.substring(F.coalesce("html", F.lit("")), 2, 2**31 - 1), F.lit("#"))).otherwise(F.col("html"))
    ids = F.when(hit == 23, F.array("page_id", -F.col("page_id") - 1)).otherwise(F.array("page_id"))
    return pages.where(hit != 11).withColumn("html", html).withColumn("page_id", F.explode(ids))


def op5_merkle_audit(spark, sf_dir: str) -> DataFrame:
    """page_id, archive, start, stop, sha256, status, records, against a replica with known damage; offsets are -1
    where the primary has none."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return audited(leaves(pages), leaves(damaged(pages))).fillna(-1, ["start", "stop"]).withColumnsRenamed({"id": "page_id", "hash": "sha256"})


OP5_SQL = r"""
WITH p AS (SELECT page_id, ('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 4))::INTEGER % 50 AS hit, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
a AS (SELECT page_id, hit, url, html FROM p UNION ALL SELECT -page_id - 1, 100, url, html FROM p WHERE hit = 23),
r AS (
  SELECT page_id, CAST(floor(page_id / 1000) AS BIGINT) AS archive, hit, html,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
         || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM a),
h AS (
  SELECT page_id, archive, sha256(record) AS sha256, CAST(count(*) AS BIGINT) AS records, CAST(count(*) * max(strlen(record)) AS BIGINT) AS size, max(hit) AS hit,
         CASE max(hit) WHEN 7 THEN CASE WHEN max(html) = substr(max(html), 2) || '#' THEN 'intact' ELSE 'corrupt' END WHEN 11 THEN 'missing' WHEN 100 THEN 'extra' ELSE 'intact' END AS status
  FROM r GROUP BY page_id, archive, sha256),
o AS (SELECT page_id, archive, sha256, sum(size) OVER (PARTITION BY archive ORDER BY page_id, sha256 ROWS UNBOUNDED PRECEDING) AS stop, size FROM h WHERE hit <> 100)
SELECT page_id, archive, coalesce(CAST(stop - o.size AS BIGINT), -1) AS start, coalesce(CAST(stop AS BIGINT), -1) AS stop, sha256, status, records
FROM h LEFT JOIN (SELECT page_id AS i, sha256 AS s, stop, size FROM o) o ON o.i IS NOT DISTINCT FROM page_id AND o.s = sha256 AND hit <> 100
"""
