"""Mixing to target weights with soft membership, in DataFrame operations only.

A naive Bayes classifier is fitted on a labelled table and gives every document a posterior over
the domains. Document rates r >= 0 are then fitted so that the expected tokens of each domain,
sum of r * tokens * posterior, match the targets: least squares over the domains, in the metric of
the inverse second moments of the posteriors of the documents with a rate, plus a small pull of
every rate towards 1, which makes the solution unique. The problem is solved by projected gradient steps. With documents
weighed by their tokens the gradient of a document depends only on its posterior and on one
residual per domain, so a step is one aggregate of a few numbers, and documents with the same
posterior have the same rate. Steps run over the distinct posteriors, which are rounded to four
digits, with their token totals; a document's rate is the same fold over the residuals, evaluated
on its own posterior. Rates are never joined.

Evidence is a short list of levels per document: language, source, length, shares of capitals,
digits and signs, repetition, and marker words. Marker words are the ``markers`` words per
domain that set it apart best in the labelled sample.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import Scratch

SAMPLE_ROWS = 8192
MARKERS = 48
MAX_LEVELS = 4096
PULL = 1e-3
STEPS = 40
TOLERANCE = 1e-6
FLOOR = 1e-5
SIGNS = "!#$%&*+/<=>@^_|~{}[]\\"


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(
        F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,;:!?\"()\[\]*#$%&]+"),
        lambda w: F.length(w).between(2, 40)))


def tokens(text: Column) -> Column:
    """Words of a text, as bigint."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("bigint")


def _share(text: Column, removed: str) -> Column:
    """Level 0 to 10 of the share of some characters, on a root scale."""
    size = F.length(text)
    part = size - F.length(F.translate(text, removed, ""))
    return F.floor(10 * F.sqrt(part / F.greatest(size, F.lit(1)))).cast("string")


def with_levels(rows: DataFrame, markers: list[str]) -> DataFrame:
    """Add ``levels``, the evidence of a row as strings such as ``caps 3``.

    ``rows`` has text, lang, source. The steps are columns of their own, so that none of them is
    evaluated once for every use.
    """
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(
        "words", _words(F.col("text"))).withColumn("tokens", tokens(F.col("text")))
    text = F.col("text")
    fixed = [
        F.concat(F.lit("lang "), F.coalesce(F.col("lang"), F.lit("?"))),
        F.concat(F.lit("source "), F.pmod(F.xxhash64("source"), F.lit(256)).cast("string")),
        F.concat(F.lit("length "), F.floor(F.log2(F.length(text) + F.lit(1.0))).cast("string")),
        F.concat(F.lit("caps "), _share(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        F.concat(F.lit("digits "), _share(text, "0123456789")),
        F.concat(F.lit("signs "), _share(text, SIGNS)),
        F.concat(F.lit("new "), F.floor(10 * F.size("words") / F.greatest(
            F.col("tokens"), F.lit(1))).cast("string")),
    ]
    levels = F.array(*fixed)
    if markers:
        levels = F.concat(levels, F.transform(
            F.array_intersect("words", F.array(*map(F.lit, markers))),
            lambda w: F.concat(F.lit("word "), w)))
    return rows.withColumn("levels", levels)


def _sample(docs: DataFrame, labelled: DataFrame, rows: int) -> DataFrame:
    chosen = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(
        F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` labels: a proven bound.
    return docs.join(F.broadcast(chosen), "doc_id")


def marker_words(sample: DataFrame, domains: list[str], markers: int) -> list[str]:
    """Words whose share in one domain exceeds that in the rest by most standard errors."""
    held = sample.select("domain", F.explode(_words(F.col("text"))).alias("word"))
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    counts = held.groupBy("word").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)))
    picked: list[str] = []
    for i, d in enumerate(domains):
        size, rest = sizes.get(d, 0), total - sizes.get(d, 0)
        if not size or not rest:
            continue
        inside, overall = F.col(f"n{i}") / size, F.col("n") / total
        score = (inside - (F.col("n") - F.col(f"n{i}")) / rest) / F.sqrt(
            overall * (1 - overall + 1 / total))
        best = counts.where("n >= 3").select("word", score.alias("score")).where(
            "score > 0").orderBy(F.col("score").desc(), "word").limit(markers)
        picked += [r["word"] for r in best.collect()]
    return sorted(set(picked))


def level_model(sample: DataFrame, domains: list[str], markers: list[str]
                ) -> tuple[list[float], dict[str, list[float]]]:
    """Log priors, and for at most ``MAX_LEVELS`` levels one log ratio per domain."""
    rows = with_levels(sample, markers).select(
        "domain", F.explode(F.array_distinct("levels")).alias("level"))
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    counted = rows.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)))
    total = sum(sizes.values())
    prior = [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    model = {}
    for r in counted.orderBy(F.col("n").desc(), "level").limit(MAX_LEVELS).collect():
        share = (r["n"] + 1) / (total + 2)
        model[r["level"]] = [math.log((r[f"n{i}"] + 2 * share) / (sizes.get(d, 0) + 2) / share)
                             for i, d in enumerate(domains)]
    return prior, model


def with_posteriors(rows: DataFrame, markers: list[str], prior: list[float],
                    model: dict[str, list[float]]) -> DataFrame:
    """doc_id, tokens, posteriors (array<double>) of ``rows``; unknown levels say nothing."""
    rows = with_levels(rows, markers)
    start = F.array(*map(F.lit, prior))
    if model:
        table = F.create_map(*(x for level, ratios in sorted(model.items())
                               for x in (F.lit(level), F.array(*map(F.lit, ratios)))))
        known = F.filter(F.transform("levels", lambda x: F.element_at(table, x)),
                         lambda x: x.isNotNull())
        rows = rows.withColumn("logs", F.aggregate(
            known, start, lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b)))
    else:
        rows = rows.withColumn("logs", start)
    rows = rows.select("doc_id", "tokens", "logs").withColumn("top", F.array_max("logs"))
    rows = rows.withColumn("raised", F.transform("logs", lambda x: F.exp(x - F.col("top"))))
    rows = rows.withColumn("sum", F.aggregate("raised", F.lit(0.0), lambda a, b: a + b))
    return rows.select("doc_id", "tokens", F.transform(
        "raised", lambda x: F.round(x / F.col("sum"), 4)).alias("posteriors"))


def _rates(p: Column, most: Column, history: list[list[float]], pull: float) -> Column:
    """Rate after the steps of ``history``: one vector over the domains per step.

    ``most`` is the largest rate allowed, null if there is none.
    """
    if not history:
        return F.lit(1.0)

    def move(r: Column, g: Column) -> Column:
        slope = F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.least(most, F.greatest(F.lit(0.0), r - (slope + pull * (r - 1.0)) / (1.0 + pull)))

    return F.aggregate(F.array(*(F.array(*map(F.lit, g)) for g in history)), F.lit(1.0), move)


def _domain_sums(q: Column, weight: Column, domains: int) -> list[Column]:
    return [F.coalesce(F.sum(weight * F.element_at(q, i + 1)), F.lit(0.0)) for i in range(domains)]


def _bounded(rows: DataFrame, labelled: DataFrame, domains: list[str],
             removed: Collection[str]) -> DataFrame:
    """Add ``most``: 1 for rows labelled as, or likeliest to be, of a removed domain, else null."""
    if not removed:
        return rows.withColumn("most", F.lit(None).cast("double"))
    of = [F.element_at("posteriors", i + 1) for i, d in enumerate(domains) if d in removed]
    known = labelled.where("doc_id is not null").where(F.col("domain").isin(*removed)).select(
        F.col("doc_id").alias("_known")).distinct()
    likeliest = F.array_max(F.array(*of)) >= F.array_max("posteriors")
    return rows.join(known, F.col("doc_id") == F.col("_known"), "left").select(
        "doc_id", "tokens", "posteriors",
        F.when(F.col("_known").isNotNull() | likeliest, F.lit(1.0)).alias("most"))


def soft_mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float],
             budget: float | None = None, sample_rows: int = SAMPLE_ROWS, markers: int = MARKERS,
             pull: float = PULL, steps: int = STEPS, removed: Collection[str] = (),
             examples: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): doc_id, tokens, posteriors, rate.

    ``labelled`` has doc_id and domain, ``targets`` the weight of each domain (any positive scale),
    ``budget`` the expected tokens of the mix (by default those of ``docs``). ``posteriors`` is an
    array in the order of the sorted domains. Null and empty texts have no tokens and
    rate by their posterior like others; a null language or source is a level of its own. Ids may
    be null or repeat. A domain without labels keeps its smoothed prior. Without tokens or
    labels every rate is 1. Other columns are ignored; an empty table gives an empty table.

    ``removed`` are domains without a target that an earlier step took out. They have posteriors,
    their tokens are in no target, and a document that is labelled as one of them, or likeliest to
    be, gets no rate above 1. The budget then counts the tokens of the other domains. ``examples``
    are the documents that labels are joined to, with the columns of ``docs``, if not ``docs``.
    """
    if not targets or min(targets.values()) <= 0:
        raise ValueError("targets need positive weights")
    if set(removed) & set(targets):
        raise ValueError("a removed domain has no target")
    domains = sorted({*targets, *removed})
    aimed = [i for i, d in enumerate(domains) if d in targets]
    scratch = Scratch(docs.sparkSession, "mix")
    docs = docs.select("doc_id", "text", "lang", "source")
    held = docs if examples is None else examples.select(*docs.columns)
    sample = scratch.write(_sample(held, labelled, sample_rows), "sample")
    words = marker_words(sample, domains, markers)
    prior, model = level_model(sample, domains, words)
    rows = scratch.write(_bounded(with_posteriors(docs, words, prior, model), labelled, domains,
                                  removed), "posteriors")
    cells = scratch.write(rows.groupBy("posteriors", "most").agg(F.sum("tokens").alias("tokens")),
                          "cells")
    q, most, n = F.col("posteriors"), F.col("most"), len(domains)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    history: list[list[float]] = []
    if total and not sample.isEmpty():
        mass = F.col("tokens") / total
        size = budget / total if budget is not None else 1.0
        if budget is None and removed:
            there = cells.agg(*_domain_sums(q, mass, n)).first()
            size = sum(there[i] for i in aimed)
        wanted = np.array([targets[domains[i]] for i in aimed]) / sum(targets.values()) * size
        before = None
        for _ in range(steps):
            rate = F.col("rate")
            free = (rate > 0) & (most.isNull() | (rate < most))
            sums = cells.withColumn("rate", _rates(q, most, history, pull)).agg(
                *_domain_sums(q, mass * rate, n),
                *(x for i in range(n) for x in _domain_sums(
                    q, F.when(free, mass * F.element_at(q, i + 1)), n))).first()
            off = np.array(sums[:n])[aimed] - wanted
            if before is not None and np.abs(off - before).max() < TOLERANCE:
                break
            # In the metric of the inverse second moments the curvature is 1.
            moments = np.array(sums[n:]).reshape(n, n)[np.ix_(aimed, aimed)]
            step = np.zeros(n)
            step[aimed] = np.linalg.solve(moments + FLOOR * np.eye(len(aimed)), off)
            history.append(step.tolist())
            before = off
    rate = _rates(q, most, history, pull)
    return rows.select("doc_id", "tokens", "posteriors", F.round(rate, 6).alias("rate"))


def _draw(key: Column) -> Column:
    """A number in [0, 1) fixed by the key."""
    return F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float],
          **options) -> DataFrame:
    """``docs`` at their fitted rates: the whole part of a rate as copies, the rest by a draw.

    The draw is a hash of the id, so a rerun mixes the same rows. Columns stay as they are.
    """
    columns = ["doc_id", "text", "lang", "source"]
    fitted = soft_mix(docs.select(*columns), labelled, targets, **options).groupBy("doc_id").agg(
        F.max("rate").alias("_rate"))
    fitted = Scratch(docs.sparkSession, "rates").write(fitted.select(
        F.col("doc_id").alias("_key"), "_rate"), "rates")
    held = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"))
    times = F.floor(F.col("_rate") + _draw(F.col("_id"))).cast("int")
    return held.join(fitted, F.col("_id").eqNullSafe(F.col("_key"))).select(
        "_doc", times.alias("_times")).where("_times > 0").select(
        "_doc", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")
