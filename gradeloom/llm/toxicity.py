"""Toxicity by a chain of linear classifiers over the labelled categories.

Categories are predicted one after the other. The model of a category sees the words of the text
and the probabilities of all earlier categories. Training uses out-of-fold probabilities for
those inputs, so a later model meets earlier predictions as unsure as they will be on new
texts; scoring uses the models fitted on the whole sample. Features are ranked by chi-square; how
many of them a link takes is chosen by the out-of-fold loss inside the labelled sample, from a
ladder of doubles that may reach all features and ends when longer steps stop to help.

The fit takes at most ``sample_rows`` labelled documents and ``SAMPLE_BYTES`` of their features,
documented bounds: they are the first ones by a hash of the id, so the choice does not depend on
the order of the table. Features are hashed in the workers. The bounded sample is broadcast, and
each fit - a fold and a number of features - is a Spark task; the driver only compares losses.
Scoring is a column expression over whole texts: nothing is shuffled.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gradeloom.llm.common import Scratch, worker_state

SAMPLE_ROWS = 8192
SAMPLE_BYTES = 32 << 20
# The smallest number of features that is tried; the others are its doubles.
FEATURES = 96
# So many doublings of the features without a better loss end the search.
PATIENCE = 2
FOLDS = 5
RIDGE = 1.0
STEPS = 100
KEPT_STEPS = 8
# So many positives weigh as much as the prior of the decision threshold, one half.
CUT_PRIOR = 30
PREFIXES = (4, 5)
KEPT_WORDS = 300_000
EDGES = " \t\r\n.,;:!?\"'()[]{}<>*-_"


def _word_features(word: str) -> tuple[int, ...]:
    word = word.strip(EDGES)
    if not word:
        return ()
    return (zlib.crc32(f"w {word}".encode("utf-8", "surrogatepass")),
            *(zlib.crc32(f"p {word[:n]}".encode("utf-8", "surrogatepass"))
              for n in PREFIXES if len(word) >= n))


def _shape_features(text: str, words: int, distinct: int) -> list[int]:
    """Hashed levels of some shares: capitals, digits, signs, repeated words, length."""
    raw = text.encode("utf-8", "surrogatepass")
    held = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    shares = (held[65:91].sum() / size, held[48:58].sum() / size,
              (held[33:48].sum() + held[58:65].sum() + held[91:97].sum()) / size,
              1 - distinct / max(1, words))
    levels = [f"s {i} {int(10 * x ** 0.5)}" for i, x in enumerate(shares)]
    levels.append(f"s len {len(raw).bit_length()}")
    return [zlib.crc32(x.encode()) for x in levels]


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature hashes of a text."""
    words = (text or "").lower().split()
    distinct = set(words)
    found = set(_shape_features(text or "", len(words), len(distinct)))
    for word in distinct:
        found.update(_word_features(word))
    return np.array(sorted(found), np.uint32)


class Link(NamedTuple):
    """One model of the chain; ``hashes`` are its features, sorted."""

    name: str
    hashes: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    cut: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Sample:
    """Sparse rows of the sample; ``back`` numbers the features by hash, ``owner`` has their rows."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.rows = len(sizes)
        self.owner = np.repeat(np.arange(self.rows, dtype=np.int32), sizes)
        self.hashes, back = np.unique(flat, return_inverse=True)
        self.back = back.astype(np.int32)

    def ranked(self, use: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Features by falling chi-square against ``y`` over the rows of ``use``, smaller first on
        ties."""
        n = len(self.hashes)
        seen = np.bincount(self.back, use[self.owner], n)
        hits = np.bincount(self.back, (use * y)[self.owner], n)
        total, positive = use.sum(), y[use].sum()
        expected = seen * positive / total
        spread = expected * (1 - positive / total) * np.maximum(1 - seen / total, 1 / total)
        score = (hits - expected) ** 2 / np.maximum(spread, 1e-9)
        return np.argsort(-score, kind="stable")

    def columns(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of every chosen feature that a row has."""
        column = np.full(len(self.hashes), -1, np.int32)
        column[chosen] = np.arange(len(chosen))
        at = column[self.back]
        return self.owner[at >= 0], at[at >= 0]


def _descend(value: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray) -> np.ndarray:
    """The minimum of a smooth convex function by limited-memory quasi-Newton steps."""
    now, slope = value(w)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        go, parts = slope.copy(), []
        for move, turn, scale in reversed(moves):
            parts.append(scale * (move @ go))
            go -= parts[-1] * turn
        if moves:
            move, turn, scale = moves[-1]
            go /= scale * (turn @ turn)
        else:
            go /= max(1.0, np.abs(go).max())
        for (move, turn, scale), part in zip(moves, reversed(parts)):
            go += (part - scale * (turn @ go)) * move
        length, drop = 1.0, slope @ go
        while True:
            there = w - length * go
            then, next_slope = value(there)
            if then <= now - 1e-4 * length * drop or length < 1e-8:
                break
            length /= 2
        move, turn = there - w, next_slope - slope
        if move @ turn > 1e-12:
            moves = [*moves[1 - KEPT_STEPS:], (move, turn, 1 / (move @ turn))]
        settled = abs(now - then) <= 1e-7 * max(1.0, abs(now))
        w, now, slope = there, then, next_slope
        if settled:
            break
    return w


def _fit(row: np.ndarray, column: np.ndarray, n: int, more: np.ndarray, y: np.ndarray,
         use: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a penalised logistic regression over the rows of ``use``; the bias comes last.

    There are ``n`` sparse columns of ones (``row``, ``column``) and the dense ones of ``more``.
    """
    inside = use[row]
    row, column = row[inside], column[inside]
    weight = use.astype(np.float64)
    penalty = np.full(n + more.shape[1] + 1, ridge)
    penalty[-1] = 1e-3

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, w[column], len(y)) + more @ w[n:-1] + w[-1]
        gap = (_sigmoid(z) - y) * weight
        loss = weight @ (np.logaddexp(0, z) - y * z) + penalty @ (w * w) / 2
        return loss, penalty * w + np.concatenate([
            np.bincount(column, gap[row], n), more.T @ gap, [gap.sum()]])

    return _descend(value, np.zeros(len(penalty)))


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The midpoint between out-of-fold probabilities that gives the best F1, drawn towards one half
    as far as the positives are few."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    at = int(np.argmax(np.where(last, f1, -1)))
    lower = p[order][at + 1] if at + 1 < len(p) else 0.0
    best, seen = float((p[order][at] + lower) / 2), y.sum()
    return float((seen * best + CUT_PRIOR * 0.5) / (seen + CUT_PRIOR))


class Job(NamedTuple):
    """One fit: the rows of ``fold`` are held out (none if negative), ``size`` features are taken."""

    fold: int
    size: int


class Done(NamedTuple):
    """Held-out probabilities by row number, and the features and weights of a fit."""

    rows: np.ndarray
    guess: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray


def solve(sample: Sample, y: np.ndarray, before: np.ndarray, fold: np.ndarray, job: Job,
          ridge: float) -> Done:
    use, out = fold != job.fold, np.flatnonzero(fold == job.fold)
    chosen = np.sort(sample.ranked(use, y)[:job.size])
    row, column = sample.columns(chosen)
    w = _fit(row, column, len(chosen), before, y, use, ridge)
    if job.fold < 0:
        return Done(out, np.empty(0), sample.hashes[chosen], w)
    z = np.bincount(row, w[column], sample.rows) + before @ w[len(chosen):-1] + w[-1]
    return Done(out, _sigmoid(z[out]), np.empty(0, np.uint32), np.empty(0))


# Solves jobs of one link: (y, before, fold, jobs) to their results in order.
Solver = Callable[[np.ndarray, np.ndarray, np.ndarray, list[Job]], list[Done]]


def fit_links(names: Sequence[str], labels: np.ndarray, features_seen: int, keys: np.ndarray,
              run: Solver, n_features: int = FEATURES, folds: int = FOLDS) -> list[Link]:
    """Links for the columns of ``labels`` (0/1, one row per document), in order.

    A category with one value only gets a constant link that never fires.
    """
    rows = len(labels)
    fold = np.array([zlib.crc32(str(k).encode()) % folds for k in keys], np.int64)
    sizes = [n_features]
    while sizes[-1] < features_seen:
        sizes.append(2 * sizes[-1])
    links: list[Link] = []
    before = np.empty((rows, 0))
    for j, name in enumerate(names):
        y = labels[:, j].astype(np.float64)
        rate = (y.sum() + 0.5) / (rows + 1)
        if not 0 < y.sum() < rows:
            links.append(Link(name, np.empty(0, np.uint32), np.empty(0), np.zeros(j),
                              float(_logit(np.array(rate))), 2.0))
            before = np.hstack([before, np.full((rows, 1), _logit(np.array(rate)))])
            continue
        parts = [f for f in range(folds) if (fold == f).any() and
                 0 < y[fold != f].sum() < (fold != f).sum()]
        tried: list[tuple[float, int, np.ndarray]] = []
        # Sizes are fitted some at a time, for as long as the last of them are still the best.
        while len(tried) < len(sizes) and (
                not tried or min(t[:2] for t in tried) in [t[:2] for t in tried[-PATIENCE:]]):
            step = sizes[len(tried):len(tried) + (PATIENCE if tried else 2 * PATIENCE)]
            jobs = [Job(f, size) for size in reversed(step) for f in parts]
            found = dict(zip(jobs, run(y, before, fold, jobs))) if jobs else {}
            for size in step:
                guess = np.full(rows, rate)
                for f in parts:
                    done = found[Job(f, size)]
                    guess[done.rows] = done.guess
                loss = -np.log(np.clip(np.where(y == 1, guess, 1 - guess), 1e-12, 1)).mean()
                tried.append((float(loss), size, guess))
        _, size, held_out = min(tried, key=lambda t: t[:2])
        (whole,) = run(y, before, fold, [Job(-1, size)])
        n, w = len(whole.hashes), whole.weights
        links.append(Link(name, whole.hashes, w[:n], w[n:-1], float(w[-1]), _best_cut(held_out, y)))
        before = np.hstack([before, _logit(held_out)[:, None]])
    return links


def fit_chain(names: Sequence[str], labels: np.ndarray, sparse: Sequence[np.ndarray],
              keys: np.ndarray, n_features: int = FEATURES, folds: int = FOLDS,
              ridge: float = RIDGE) -> list[Link]:
    """The links of a sample held here, one fit after the other."""
    flat = np.concatenate(sparse) if len(sparse) else np.empty(0, np.uint32)
    sample = Sample(flat, np.array([len(s) for s in sparse], np.int64))
    return fit_links(names, labels, len(sample.hashes), keys, lambda y, before, fold, jobs: [
        solve(sample, y, before, fold, job, ridge) for job in jobs], n_features, folds)


def _on_tasks(spark: SparkSession, flat: bytes, sizes: np.ndarray, ridge: float) -> Solver:
    """Each job is a task; the sample, bounded in bytes, is broadcast once."""
    held = spark.sparkContext.broadcast((flat, sizes))
    key = f"toxicity-sample:{uuid.uuid4().hex}"

    def run(y: np.ndarray, before: np.ndarray, fold: np.ndarray, jobs: list[Job]) -> list[Done]:
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in b["id"].tolist():
                    sample = worker_state(key, lambda: Sample(
                        np.frombuffer(held.value[0], np.uint32), held.value[1]))
                    done = solve(sample, y, before, fold, jobs[i], ridge)
                    yield pd.DataFrame({"job": [i], **{
                        name: [np.ascontiguousarray(part).tobytes()] for name, part in
                        zip(Done._fields, done)}})

        schema = "job bigint, " + ", ".join(f"{name} binary" for name in Done._fields)
        found = spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(task, schema).collect()
        kinds = np.int64, np.float64, np.uint32, np.float64
        return [Done(*(np.frombuffer(r[1 + k], kind) for k, kind in enumerate(kinds)))
                for r in sorted(found, key=lambda r: r.job)]

    return run


def labelled_chain(docs: DataFrame, labels: DataFrame, names: Sequence[str],
                   sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> list[Link]:
    """Fit on ``labels`` (doc_id and one 0/1 column per name) joined to ``docs`` (doc_id, text).

    Null labels count as 0, rows without an id are not used, repeated ids count once (the larger
    label, any one of the texts).
    """
    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint")).agg(
        *(F.max(F.coalesce(F.col(n).cast("int"), F.lit(0))).alias(n) for n in names))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.drop(columns=["text"])
            out["found"] = [features(t).tobytes() for t in b["text"]]
            yield out

    kinds = ", ".join(f"`{n}` int" for n in names)
    scratch = Scratch(spark, "toxicity")
    # At most sample_rows labels: small enough to send to every task.
    rows = scratch.write(docs.select(F.col("doc_id").cast("bigint"), "text").join(
        F.broadcast(chosen), "doc_id").select("doc_id", *names, "text").mapInPandas(
        run, f"doc_id bigint, {kinds}, found binary").dropDuplicates(["doc_id"]), "sample")
    # One small row per sampled document; from them follows which documents keep to the bytes.
    sizes = rows.select("doc_id", F.xxhash64("doc_id").alias("place"), *names, F.octet_length(
        "found").alias("bytes")).toPandas().sort_values(["place", "doc_id"])
    sizes = sizes[sizes["bytes"].cumsum() <= sample_bytes]
    if not len(sizes):
        return fit_chain(names, np.empty((0, len(names))), [], np.empty(0, np.int64))
    last = int(sizes["place"].iloc[-1])
    texts = dict(rows.where(F.xxhash64("doc_id") <= last).select("doc_id", "found").collect())
    scratch.drop(rows)
    sizes = sizes.sort_values("doc_id")
    ids = sizes["doc_id"].tolist()
    flat = b"".join(texts[i] for i in ids)
    del texts
    seen = len(np.unique(np.frombuffer(flat, np.uint32)))
    return fit_links(names, sizes[list(names)].to_numpy(), seen, np.array(ids), _on_tasks(
        spark, flat, (sizes["bytes"] // 4).to_numpy(), RIDGE))


def probabilities(links: Sequence[Link], texts: Sequence[str | None], cache: dict) -> np.ndarray:
    """One row per text, one column per category. ``cache`` maps words to weight rows."""
    places = [{int(h): i for i, h in enumerate(link.hashes)} for link in links]

    def weights_of(hashes: Sequence[int]) -> tuple:
        return tuple((j, place[h]) for j, place in enumerate(places) for h in hashes if h in place)

    logits = np.zeros((len(texts), len(links)))
    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        distinct = set(words)
        hits = set(weights_of(_shape_features(text or "", len(words), len(distinct))))
        for word in distinct:
            found = cache.get(word)
            if found is None:
                found = weights_of(_word_features(word))
                if len(word) <= 64:
                    cache[word] = found
            if found:
                hits.update(found)
        if len(cache) > KEPT_WORDS:
            cache.clear()
        for j, k in sorted(hits):
            logits[i, j] += links[j].weights[k]
    for j, link in enumerate(links):
        logits[:, j] += link.bias + logits[:, :j] @ link.earlier
    return _sigmoid(logits)


def scored(text: Column, links: Sequence[Link]) -> Column:
    """Struct of one probability ``p_<name>`` and one decision ``<name>`` per category."""
    kind = T.StructType([f for link in links for f in (
        T.StructField(f"p_{link.name}", T.DoubleType()),
        T.StructField(link.name, T.BooleanType()))])
    links = list(links)
    key = f"chain:{zlib.crc32(repr([(x.name, x.bias, x.cut, x.weights.sum()) for x in links]).encode())}"

    @F.pandas_udf(kind)
    def score(texts: pd.Series) -> pd.DataFrame:
        p = probabilities(links, texts.tolist(), worker_state(key, dict))
        out = {}
        for j, link in enumerate(links):
            out[f"p_{link.name}"] = p[:, j]
            out[link.name] = p[:, j] > link.cut
        return pd.DataFrame(out, columns=kind.names)

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, names: Sequence[str],
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, and p_<name> and <name> of every category.

    Null texts are scored as empty ones, long texts whole. Ids may be null or repeat; every row is
    scored by itself, so equal rows score alike. A probability equal to the threshold is no hit.
    Features that tie in rank come in the order of their hashes. Without usable labels all decisions are false. Other columns are ignored; an empty
    table gives an empty table.
    """
    links = labelled_chain(docs, labels, names, sample_rows)
    return docs.select("doc_id", scored(F.col("text"), links).alias("s")).select("doc_id", "s.*")
