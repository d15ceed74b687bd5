"""Line dedup by overlapping three-line windows (DataFrame functions only).

A document's lines are its text split at newlines; a window is three lines that follow one another.
The first occurrence of a window, by id (null first) and position, stays; the lines of every later
occurrence go. Windows are judged on the input. Each line's content survives at its first place.

Defined cases: a null text stays null (no lines); a text of one or two lines has no window and stays
as it is; an empty text is one empty line; rows with the same id and text are one document, so each
gets the same result; rows with the same id and another text are documents of their own, in the order
of their text hashes. Window keys are 128 bits, put together from 64-bit hashes of
the lines. Other columns are passed on unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

SPAN = 3


def _hashes(*parts: Column) -> Column:
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("b"), *parts).alias("b"))


def repeated_spans(docs: DataFrame, *, id_col="doc_id", text_col="text", span: int = SPAN) -> DataFrame:
    """(ka, kb, spans) for each document with lines to go: its key and its merged [start, stop) spans."""
    text, id_ = F.col(text_col), F.col(id_col)
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(x))
    d = docs.where(text.isNotNull()).select(id_.alias("id"), *_key(id_, text), lines.alias("lines"))
    d = d.where(F.size("lines") >= span)
    starts = F.sequence(F.lit(0), F.size("lines") - span)
    grams = F.transform(starts, lambda i: _hashes(*[F.get("lines", i + j) for j in range(span)]))
    windows = save(d.select("id", "ka", "kb", F.posexplode(grams).alias("pos", "w")).select("id", "ka", "kb", "pos", "w.a", "w.b"))
    first = F.min(F.struct("id", "ka", "kb", "pos")).alias("first")
    repeated = windows.groupBy("a", "b").agg(first, F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    later = windows.join(repeated, ["a", "b"]).where(F.struct("id", "ka", "kb", "pos") != F.col("first"))
    later = later.select("ka", "kb", "pos").distinct()
    by_doc = Window.partitionBy("ka", "kb").orderBy("pos")
    gap = F.col("pos") - F.lag("pos").over(by_doc) > span
    later = later.withColumn("island", F.coalesce(gap, F.lit(True)).cast("int"))
    later = later.withColumn("island", F.sum("island").over(by_doc))
    spans = later.groupBy("ka", "kb", "island").agg(F.min("pos").alias("start"), (F.max("pos") + span).alias("stop"))
    return spans.groupBy("ka", "kb").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def _key(id_: Column, text: Column) -> list[Column]:
    return [F.xxhash64(id_, text).alias("ka"), F.xxhash64(F.lit("b"), text, id_).alias("kb")]


def dedup_lines(docs: DataFrame, *, id_col="doc_id", text_col="text", span: int = SPAN, out_col="line_dedup") -> DataFrame:
    """The rows with struct column `out_col`: text (what stays), n_lines, n_removed. A column of that name is
    replaced."""
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, span=span)
    one = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != out_col]).alias("row")
    rows = docs.select(one, *_key(F.col(id_col), F.col(text_col))).join(spans, ["ka", "kb"], "left")
    text = F.col("row").getField(text_col)
    lines = F.split(text, "\n", -1)
    n = F.coalesce(F.when(text.isNotNull(), F.size(lines)), F.lit(0))
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s.stop))
    stops = F.concat(F.transform("spans", lambda s: s.start), F.array(n))
    parts = F.transform(F.arrays_zip(starts.alias("s"), stops.alias("e")), lambda z: F.slice(lines, z.s + 1, z.e - z.s))
    kept = F.when(F.col("spans").isNull(), text).otherwise(F.array_join(F.flatten(parts), "\n"))
    gone = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s.stop - s.start)
    out = F.struct(kept.alias("text"), n.cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"))
    return rows.select("row", out.alias("out")).select("row.*", F.col("out").alias(out_col))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that stays; null: of the empty text)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = F.sha2(F.coalesce(F.col("line_dedup.text"), F.lit("")).cast("binary"), 256)
    return dedup_lines(docs).select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", kept.alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT DISTINCT doc_id, text, lines, unnest(range(0, len(lines) - 2)) AS pos FROM d WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS w FROM l),
o AS (SELECT doc_id, text, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, text, pos) AS nth FROM w),
g AS (SELECT DISTINCT doc_id, text, unnest([pos, pos + 1, pos + 2]) AS gone FROM o WHERE nth > 1),
x AS (SELECT doc_id, text, list(gone) AS gone FROM g GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(len(d.lines), 0)::BIGINT AS n_lines, coalesce(len(x.gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string([d.lines[i + 1] FOR i IN range(0, len(d.lines)) IF NOT list_contains(coalesce(x.gone, []), i)], chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text = x.text
"""
