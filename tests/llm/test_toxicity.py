import random

import numpy as np

from gradeloom.llm import toxicity as tx

from .plain import awkward

CLEAN = ["the", "river", "runs", "slowly", "under", "old", "bridge", "people", "walk", "home"]
NAMES = ("low_quality", "toxic")


def sample(n, seed):
    """Texts; low ones shout, toxic ones hold one of three words, toxic ones are often low."""
    rng, out = random.Random(seed), []
    for i in range(n):
        words = rng.choices(CLEAN, k=rng.randrange(8, 40))
        toxic = rng.random() < .2
        low = rng.random() < (.6 if toxic else .1)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["nasty", "vile", "rotten"])
        text = " ".join(words)
        out.append((i, text.upper() + "!!!" if low else text, int(not low), int(toxic)))
    return out


def accuracy(rows, decided):
    return np.mean([[d.low_quality == (not q), d.toxic == bool(t)]
                    for (_, _, q, t), d in zip(rows, decided)], axis=0)


def test_held_out_accuracy(spark):
    train, test = sample(900, 1), sample(400, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in train]
                                 + [(10_000 + i, t) for i, t, _, _ in test], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - q, t) for i, _, q, t in train],
                                   "doc_id bigint, low_quality int, toxic int")
    got = {r.doc_id: r for r in tx.toxicity(docs, labels, NAMES).collect()}
    assert len(got) == 1300
    assert (accuracy(test, [got[10_000 + i] for i in range(400)]) > .97).all()


def test_given_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr(
        "doc_id", "1 - quality AS low_quality", "toxic")
    train, test = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    got = tx.toxicity(docs, train, NAMES).select("doc_id", tx.F.col("toxic").alias("called"))
    cells = {(r.toxic, r.called): r["count"] for r in
             test.join(got, "doc_id").groupBy("toxic", "called").count().collect()}
    hits, missed, false = (cells.get(k, 0) for k in ((1, True), (1, False), (0, True)))
    # At this scale some labels do not follow the text.
    assert hits / (hits + missed) > .88 and hits / (hits + false) > .9


def test_toxic_wording_of_many_words():
    """Each of 150 words marks few documents: 96 features hold about a third of them."""
    rng, rows = random.Random(5), []
    marks = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=6)) for _ in range(150)]
    for i in range(4500):
        words, toxic = rng.choices(CLEAN, k=rng.randrange(8, 40)), i % 3 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(marks)
        rows.append((" ".join(words), int(toxic)))
    y = np.array([t for _, t in rows])
    (link,) = tx.fit_chain(["toxic"], y[:3000, None], [tx.features(t) for t, _ in rows[:3000]],
                           np.arange(3000))
    called = tx.probabilities([link], [t for t, _ in rows[3000:]], {})[:, 0] > link.cut
    assert len(link.hashes) > 96
    assert called[y[3000:] == 1].mean() > .95 and y[3000:][called].mean() > .97


def test_later_links_use_out_of_fold_probabilities():
    rows = sample(400, 3)
    sparse = [tx.features(t) for _, t, _, _ in rows]
    # The second category repeats the first, which no feature of its own shows.
    first = np.array([1 - q for _, _, q, _ in rows])
    links = tx.fit_chain(NAMES, np.stack([first, first], axis=1), sparse, np.arange(400))
    assert len(links[1].earlier) == 1 and links[1].earlier[0] > 0
    blank = [np.empty(0, np.uint32)] * 400
    held = tx.fit_chain(NAMES, np.stack([first, first], axis=1), blank, np.arange(400))
    # Without features out-of-fold probabilities hold no label, so nothing leaks to the next link.
    assert abs(held[1].bias + held[1].earlier @ [held[0].bias] - held[0].bias) < .5


def test_awkward_documents(spark):
    texts = [None, "", "x " * 60_000, "nasty", "nasty", "É!"]
    docs = awkward(spark, texts).withColumn("toxic", tx.F.lit("clash"))
    labels = spark.createDataFrame([(4, 0, 1), (4, 0, None), (None, 1, 1), (77, 1, 1)],
                                   "doc_id bigint, low_quality int, toxic int")
    for given in (labels, labels.where("doc_id > 99")):
        got = tx.toxicity(docs, given, NAMES)
        assert got.columns == ["doc_id", "p_low_quality", "low_quality", "p_toxic", "toxic"]
        rows = got.collect()
        assert len(rows) == 6 and not any(r.toxic or r.low_quality for r in rows)
        assert all(0 < r.p_toxic < 1 for r in rows)
    assert tx.toxicity(docs.where("doc_id > 99"), labels, NAMES).collect() == []
