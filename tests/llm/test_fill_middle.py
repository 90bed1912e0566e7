import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import fill_middle as fm
from gradeloom.llm.queries import op13_fill_in_middle

from .plain import awkward, rows_of

LONG = "word, Wörter 漢字 é 1.5\n" * 9000
TEXTS = [None, "", "a", "one two  three", "<P> stays", "tail <S", "S>x <M", "É" * 4000, "a" * 200_000,
         LONG, LONG + "end", "x\x00y\x1fz \U0001F600", "one two  three", "  ", "a<b>c<P"] * 3


def brute(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    digest = hashlib.sha256(text.encode()).hexdigest()
    if not text or h3 % 100 >= 90 or any(s in text for s in ("<P>", "<S>", "<M>")):
        return key, n, "plain", None, None, digest, digest
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return key, n, form, len(pre), len(mid), hashlib.sha256(out.encode()).hexdigest(), digest


COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def digests(df):
    return df.select(*COLUMNS[:5], F.sha2(F.col("output").cast("binary"), 256).alias(COLUMNS[5]), F.sha2(
        fm.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias(COLUMNS[6]))


def test_awkward_documents(spark):
    docs = awkward(spark, TEXTS).withColumn("form", F.lit("clash")).withColumn("raw", F.lit(1))
    got = digests(fm.fill_in_middle(docs))
    want = [brute(i + 1, t) for i, t in enumerate(TEXTS)]
    assert rows_of(got, *COLUMNS) == sorted(want, key=repr)
    assert {"plain", "psm", "spm"} == {w[2] for w in want}
    assert fm.fill_in_middle(docs.where("doc_id > 999")).collect() == []


def test_repeated_rows_and_missing_ids(spark):
    rows = [(None, "some text"), (None, "some text"), (7, "other words"), (7, "other words")]
    got = digests(fm.fill_in_middle(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert rows_of(got, *COLUMNS) == sorted((brute(*r) for r in rows), key=repr)


def test_given_documents(spark, folder):
    got = rows_of(op13_fill_in_middle(spark, folder), *COLUMNS)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((brute(r.doc_id, r.text) for r in docs), key=repr)


@pytest.mark.parametrize("bits,longest", [(2, 64), (4, 8), (11, 1 << 16)])
def test_counts_and_places_by_chunks(bits, longest):
    rng = random.Random(bits)
    cache = fm.Summaries(limit=500)
    for _ in range(60):
        text = "".join(rng.choices(["a", "b", "xyz", " ", "é", "漢", "😀", ".", "\n"],
                                   k=rng.randrange(0, 300)))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        done = fm.Counted(text.encode(), cache, bits=bits, longest=longest)
        assert done.n == len(units) and b"".join(done.chunks).decode() == text
        for chunk in done.chunks:
            chunk.decode()
        for m in range(len(units) + 1):
            head = "".join(units[:m])
            assert done.place(m) == (len(head.encode()), len(head))


def test_shared_passages_share_chunks():
    rng = np.random.default_rng(3)
    passage = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8))
    one, two = b"first start " + passage, b"another, longer beginning " + passage + b" end"
    cache = fm.Summaries()
    fm.Counted(one, cache)
    before = len(cache.known)
    later = fm.Counted(two, cache)
    assert cache.hits >= .8 * len(later.chunks) and len(cache.known) - before <= 4


def test_pieces_of_long_texts_cut_alike(monkeypatch):
    text = bytes(np.random.default_rng(4).integers(32, 127, 100_000, dtype=np.uint8))
    whole = fm.cut_points(text)
    monkeypatch.setattr(fm, "PIECE", 777)
    assert fm.cut_points(text) == whole
