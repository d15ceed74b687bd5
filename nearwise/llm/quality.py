"""Quality classifier by hierarchical empirical Bayes.

A document classifier (logistic regression on measures of the whole text, fitted on at most `max_train`
labelled rows, those with the least hash) gives each document a log-likelihood ratio. Its sites, one within
the other, have good-document rates of their own: host and path, which are two columns, or the host and each
directory of a url down to `depth` levels (a document in a higher directory is in a site of its own below
that). Grouped aggregation gives each site the number and the sum of its documents' probabilities; the spread
of rates over the sites of a level within those above gives the strength of the level's prior by the method of
moments. A host's rate is shrunk towards the global rate and each site's towards that of the one above, so a
sparse site hardly moves its documents. A document's posterior is its likelihood ratio on the prior odds of its
last site, from all levels of which its own share is taken out. It is kept if the posterior reaches `keep_at`.

Defined cases: a null text is an empty one; null host, path or url values are values of their own; labels that
are null do not count, of several for an id the least holds; without labels of both kinds the classifier
is constant and the rates alone decide; an empty table gives no rows; other columns are passed on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, save
from .logistic import Logistic, fit, sigmoid

MAX_TRAIN, KEEP_AT, DEPTH = 20_000, 0.5, 4
_UPPER, _LOWER, _DIGIT, _BLANK = (np.isin(np.arange(256), list(s)) for s in (range(65, 91), range(97, 123), range(48, 58), (32, 9, 10, 11, 12, 13)))
_PLAIN = np.isin(np.arange(256), list(b".,;:'\"-()?")) | _UPPER | _LOWER | _DIGIT | _BLANK | (np.arange(256) >= 128)
MEASURES = ["log_words", "upper", "symbols", "marked_words", "digits", "distinct_words", "top_word", "stutter", "word_length", "sentences", "repeated_lines"]


def measures(text: bytes | None) -> list[float]:
    text = text or b""
    words, n = text.split(), len(text)
    if not words:
        return [0.0] * len(MEASURES)
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = kinds[_UPPER].sum() + kinds[_LOWER].sum()
    odd = kinds[~_PLAIN].sum()
    counts = Counter(words)
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    lines = text.split(b"\n")
    m = len(words)
    return [
        float(np.log1p(m)), kinds[_UPPER].sum() / max(1, letters), odd / n, min(1.0, odd / m), kinds[_DIGIT].sum() / n, len(counts) / m,
        max(counts.values()) / m, stutter / m, n / m, (kinds[46] + kinds[33] + kinds[63]) / m, 1 - len(set(lines)) / len(lines),
    ]


def _measured(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([measures(t) for t in texts])

    return of(text.cast("binary"))


def _evidence(text: Column, model: Logistic) -> Column:
    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.logit(np.array([measures(t) for t in texts]).reshape(len(texts), -1)))

    return of(text.cast("binary"))


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", max_train: int = MAX_TRAIN) -> tuple[Logistic, float]:
    """(classifier, share of good rows among those it was fitted on)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col)).alias("y"))
    sample = save(known.orderBy(F.xxhash64("id"), "id").limit(max_train))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    rows = rows.select("id", "y", _measured(F.col("text")).alias("x")).groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    found = rows.orderBy("id").toPandas()
    y = found["y"].to_numpy(dtype=float)
    x = np.array(found["x"].tolist(), float).reshape(len(y), len(MEASURES))
    if not len(y):
        x, y = np.zeros((1, len(MEASURES))), np.array([0.5])
    return fit(x, y), float((y.sum() + 1) / (len(y) + 2))


def _strength(between: float, within: float, mean: float) -> float:
    """Pseudo-documents of a prior: mean (1 - mean) / variance of the rates beyond sampling, less 1."""
    variance = max(between - within, 1e-9)
    return float(np.clip(mean * (1 - mean) / variance - 1, 1.0, 1e4))


def nested(*columns: str) -> Column:
    """An array of sites, each within the one before, of columns from the widest to the narrowest."""
    names = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns]
    return F.array(*[F.concat_ws("\0", *names[: n + 1]) for n in range(len(names))])


def url_sites(url: Column, depth: int) -> Column:
    """The host and the directories of a url, as `depth` sites one within the other."""
    plain = F.regexp_replace(F.coalesce(F.concat(F.lit("="), url), F.lit("null")), r"^=[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    parts = F.split(plain, "/", -1)
    steps = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x != "")  # the last part is the document
    site = lambda n: F.concat_ws("/", F.lower(F.get(parts, 0)), F.slice(steps, 1, n), F.when(F.size(steps) < n, F.lit("")))
    return F.array(*[site(n) for n in range(depth)])


def posteriors(scored: DataFrame, share: float, levels: int) -> DataFrame:
    """Rows with columns sites (an array of `levels` names) and logit -> with host_rate, path_rate and posterior
    as well: of the first and the last site, and the document's."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit")))
    scored = save(scored.withColumn("p", p))
    last = save(scored.groupBy("sites").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    total = last.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    n, mean = total["n"] or 1, float(np.clip((total["s"] or 0.0) / (total["n"] or 1), 1e-3, 1 - 1e-3))
    site, strengths, above = last.select("sites"), [], None
    for level in range(levels):
        name = F.get("sites", level).alias("site")
        up = F.get("sites", level - 1).alias("up") if level else F.lit("").alias("up")
        rates = last.groupBy(name, up).agg(F.sum("n").alias(f"n{level}"), F.sum("s").alias(f"s{level}"))
        rates = rates.join(above, "up") if level else rates.withColumn("above", F.lit(mean))
        own = F.col(f"s{level}") / F.col(f"n{level}") - F.col("above")
        moved = rates.agg(F.sum(F.col(f"n{level}") * own * own).alias("v"), F.count("*").alias("groups")).first()
        strength = _strength((moved["v"] or 0.0) / n, mean * (1 - mean) * moved["groups"] / n, mean)
        strengths.append(strength)
        rate = (F.lit(strength) * F.col("above") + F.col(f"s{level}")) / (F.lit(strength) + F.col(f"n{level}"))
        rates = save(rates.select("site", f"n{level}", f"s{level}", rate.alias(f"rate{level}")))
        above = rates.select(F.col("site").alias("up"), F.col(f"rate{level}").alias("above"))
        site = site.withColumn("site", F.get("sites", level)).join(rates, "site").drop("site")
    rows = attach(scored, save(site), ["sites"])
    prior = F.lit(mean)
    for level, strength in enumerate(strengths):
        prior = (F.lit(strength) * prior + F.col(f"s{level}") - F.col("p")) / (F.lit(strength) + F.col(f"n{level}") - 1)
    prior = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), prior))
    odds = F.col("logit") - float(np.log(share / (1 - share))) + F.log(prior / (1 - prior))
    rows = rows.withColumns({"host_rate": F.col("rate0"), "path_rate": F.col(f"rate{levels - 1}"), "posterior": F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))})
    return rows.select(*[c for c in scored.columns if c != "p"], "host_rate", "path_rate", "posterior")


def _sites(host_col: str, path_col: str, url_col: str | None, depth: int) -> tuple[Column, int]:
    return (url_sites(F.col(url_col), depth), depth) if url_col else (nested(host_col, path_col), 2)


def _keys(id_col: str, text_col: str, sites: Column) -> list[Column]:
    """128 bits of hash of what a row is judged by, and its id."""
    return [F.xxhash64(id_col, text_col, sites).alias("key"), F.xxhash64(F.lit("more"), sites, text_col, id_col).alias("more")]


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", host_col="source", path_col="lang", url_col: str | None = None, depth: int = DEPTH, label_col="quality", max_train: int = MAX_TRAIN
) -> DataFrame:
    """id, key and more (hashes of what the row is judged by), sites, logit, host_rate, path_rate, posterior for
    every row. With `url_col` sites come from that column, else from host and path."""
    model, share = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_train=max_train)
    sites, levels = _sites(host_col, path_col, url_col, depth)
    scored = docs.select(F.col(id_col).alias("id"), *_keys(id_col, text_col, sites), sites.alias("sites"), _evidence(F.col(text_col), model).alias("logit"))
    return posteriors(scored, share, levels)


def keep_good(
    docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", host_col="source", path_col="lang", url_col: str | None = None, depth: int = DEPTH, keep_at: float = KEEP_AT, **options
) -> DataFrame:
    """The rows whose posterior reaches `keep_at`, with their columns as they are. The keys of the rejected
    rows, the smaller part, are what the rows are held against."""
    found = classify(docs, labels, id_col=id_col, text_col=text_col, host_col=host_col, path_col=path_col, url_col=url_col, depth=depth, **options)
    rejected = save(found.where(F.col("posterior") < keep_at).select("key", "more").distinct())
    one = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(*_keys(id_col, text_col, _sites(host_col, path_col, url_col, depth)[0]), one)
    return attach(rows, rejected, ["key", "more"], "left_anti", 1_000_000).select("row.*")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(F.col("id").alias("doc_id"), "host_rate", "path_rate", F.col("posterior").alias("score"), (F.col("posterior") >= KEEP_AT).cast("int").alias("keep"))
