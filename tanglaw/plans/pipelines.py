"""Plans composed of several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import features as FE
from ..functions import text as T
from ..operators import audit, clean, corpus, ngrams
from ..sources.tables import materialize

FEATURES = ("mean_sentence_len", "mean_word_len", "polysyll_freq", "type_token_ratio", *FE.SHAPES, "tag_bi", "bik_bi", "ceb_bi", "tag_tri", "bik_tri", "ceb_tri")


def everything() -> WindowSpec:
    """A window over all rows, for results of a few rows."""
    return Window.partitionBy(F.lit(1))


def features14(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, the fourteen features, label, language and split_role of each row of ``df`` (doc_id, language, level, text)."""
    missing = {"doc_id", "language", "level", "text"} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    docs = FE.tokenized(df).withColumn("line", FE.line_of(F.col("words")))
    local = FE.trad(F.col("words"), F.col("n_sents"), F.col("language"), F.col("line")) | FE.syll(F.col("words"), F.col("language"), line=F.col("line"))
    rows = docs.select("doc_id", *[c.alias(n) for n, c in local.items()], F.col("level").alias("label"), "language", corpus.role(F.col("language")).alias("split_role"), "text")
    out = ngrams.with_rbo(rows, "text", anchors)
    rounded = [F.round(c, 8).alias(c) if c.endswith(("_bi", "_tri")) else c for c in FEATURES]
    return out.select("doc_id", *rounded, "label", "language", "split_role")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, min, max, n_distinct) of each column, in one pass."""
    aggs = [x for c in columns for x in (F.round(F.avg(c), 4).alias(f"{c}_mean"), F.round(F.min(c), 4).alias(f"{c}_min"), F.round(F.max(c), 4).alias(f"{c}_max"), F.count_distinct(c).alias(f"{c}_n"))]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_min").alias("min"), F.col(f"{c}_max").alias("max"), F.col(f"{c}_n").alias("n_distinct")) for c in columns])
    return one.select(F.inline(rows))


def standardized(df: DataFrame, column: str, fit_on: DataFrame | None = None) -> DataFrame:
    """``df`` with z, ``column`` less the mean over the population deviation of ``fit_on``; null where the deviation is 0."""
    fit = (fit_on or df).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    joined = df.withColumn("_k", F.lit(1)).join(F.broadcast(fit.withColumn("_k", F.lit(1))), "_k")  # one row
    return joined.withColumn("z", (F.col(column) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_k", "_m", "_s")


def standardized_by_fold(df: DataFrame, column: str) -> DataFrame:
    """``df`` (fold and ``column``) with z, ``column`` scaled by the mean and population deviation of the rows of the other folds; null where the deviation is 0."""
    x = F.col(column)
    per = df.groupBy("fold").agg(F.count(column).alias("_n"), F.avg(column).alias("_a"), F.coalesce(F.var_pop(column), F.lit(0.0)).alias("_v"))  # a row for each fold
    a, b = per.select(F.col("fold").alias("fold"), F.lit(1).alias("_k")), per.select(F.col("fold").alias("_o"), "_n", "_a", "_v", F.lit(1).alias("_k"))
    others = a.join(F.broadcast(b), "_k").where(F.col("fold") != F.col("_o"))
    moments = others.groupBy("fold").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_a")).alias("s"), F.sum(F.col("_n") * (F.col("_v") + F.col("_a") * F.col("_a"))).alias("q"))
    fit = moments.select("fold", (F.col("s") / F.col("n")).alias("_m"), F.sqrt(F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0))).alias("_d"))
    return df.join(F.broadcast(fit), "fold").withColumn("z", (x - F.col("_m")) / F.nullif(F.col("_d"), F.lit(0.0))).drop("_m", "_d")


def flagged(df: DataFrame) -> DataFrame:
    """(doc_id, language, flag, emitted) of ``df`` (doc_id, language, text): marks, then duplicates within a language."""
    return corpus.verdicts(df.withColumn("flag", F.lit("")), "doc_id")


def folds(index: DataFrame) -> DataFrame:
    """(doc_id, language, label, fold) of the distinct documents of an index with a sound label."""
    rows = index.where("label in (1, 2, 3)").groupBy("doc_id").agg(F.min_by(F.struct("language", "label"), "pos").alias("r")).select("doc_id", "r.language", "r.label")
    return corpus.stratified_folds(rows, ["language", "label"]).select("doc_id", "language", "label", "fold")


def fold_features(texts: DataFrame, index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, language, label from 0, fold and the fourteen features) of the documents of an index with a sound label."""
    known = folds(index)
    rows = known.join(texts.select("doc_id", "text"), "doc_id").select("doc_id", "language", F.col("label").alias("level"), "text")
    features = features14(materialize(rows, "fold-texts"), anchors).select("doc_id", *FEATURES)
    return known.withColumn("label", F.col("label") - 1).join(features, "doc_id")


def heldout_features(texts: DataFrame, heldout: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, language, label from 0, fold -1 and the fourteen features) of the held-out documents with a sound label."""
    rows = heldout.where("label in (1, 2, 3)").dropDuplicates(["doc_id"]).join(texts.select("doc_id", "text"), "doc_id").select("doc_id", "language", F.col("label").alias("level"), "text")
    return features14(materialize(rows, "heldout-texts"), anchors).select("doc_id", "language", (F.col("label") - 1).alias("label"), F.lit(-1).alias("fold"), *FEATURES)


def build(df: DataFrame) -> DataFrame:
    """Corpus build in one plan: clean by kind of source, mark, flag duplicates, emit and normalize. ``df`` has doc_id, language, level, title, text."""
    low = T.lower_trim(F.col("language"))
    rows = df.select("doc_id", low.alias("language"), "level", "title", "text")
    cleaned = (
        clean.clean_lines(rows.where(F.col("language").isin("cebuano", "bikol")))
        .unionByName(clean.clean_tagalog(rows.where("language = 'tagalog'")))
        .unionByName(clean.clean_pages(rows.where(F.col("language").isin(*L.LOW_RESOURCE))))
    )
    # Stored once: filters on the narrative would otherwise be pushed through every cleaning step and repeat its expressions.
    stored = materialize(cleaned.select("doc_id", "language", "level", "title", F.col("narrative").alias("text"), "flag"), "cleaned")
    marked = corpus.flag_duplicates(corpus.mark(stored), ["doc_id"])
    kept = marked.where(corpus.emittable(F.col("text"), F.col("flag")))
    normal = kept.select("doc_id", "language", "level", T.normalize(F.col("text")).alias("text"), "flag")
    return materialize(normal, "normalized").where(T.strip(F.col("text")) != "")


def aligned(df: DataFrame) -> DataFrame:
    """(doc_id, title, raw, clean, flag): each text as it is compared with its cleaned form."""
    cleaned = clean.clean_lines(df)
    return cleaned.select("doc_id", "title", T.basic_clean(F.coalesce("text", F.lit(""))).alias("raw"), F.col("narrative").alias("clean"), "flag")


def removed(df: DataFrame) -> DataFrame:
    return audit.removed_spans(aligned(df))


def span_ledger(df: DataFrame) -> DataFrame:
    """(category, position, spans, words, percent) of what the line cleaner removed."""
    spans = removed(df).where("words > 0").join(df.select("doc_id", "title"), "doc_id")
    by = spans.groupBy(audit.category(F.col("span"), F.col("title"), F.col("position")).alias("category"), "position").agg(F.count("*").alias("spans"), F.sum("words").alias("words"))
    return by.withColumn("percent", F.round(100.0 * F.col("words") / F.sum("words").over(everything()), 4))


def against_key(rows: DataFrame, key: DataFrame) -> DataFrame:
    """One row: how many of ``rows`` (title, level, words, sents) agree with ``key``, the last row of a key counting."""
    last = key.groupBy("title", "level").agg(F.max_by(F.struct("words", "sents"), "doc_id").alias("k"))
    both = rows.join(last, ["title", "level"], "left")
    return both.agg(
        F.count_if((F.col("words") == F.col("k.words")) & (F.col("sents") == F.col("k.sents"))).alias("both_match"), F.count_if(F.col("words") == F.col("k.words")).alias("word_match"),
        F.count_if(F.col("k").isNull()).alias("missing"),
    )
