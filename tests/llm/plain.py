"""Small tables with the awkward cases, and helpers of the tests."""

from __future__ import annotations

DOCUMENT = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
            "rest string, kept boolean, _id bigint, _sha string, runs string")


def awkward(spark, texts, start=1):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(start + i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src1", None,
             "x", None, 7, "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENT)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


class Union:
    """Disjoint sets of integers with the smallest member as name."""

    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
