import zstandard

from gradeloom.llm.license_scan import TEMPLATES, Scanner, license_notices

from .plain import awkward, rows_of

MIT = TEMPLATES["MIT-text"]


def names(text):
    return [(n.license_id, n.confirmed) for n in Scanner(TEMPLATES).notices(text)]


def test_every_template_is_found_in_prose():
    for name, text in TEMPLATES.items():
        page = f"Some words before it, and\n{text}\nsome words after it."
        (notice,) = Scanner(TEMPLATES).notices(page)
        assert (notice.license_id, notice.confirmed, notice.missing, notice.extra) == (
            name, True, "", "")
        found = page[notice.start:notice.start + notice.length]
        assert found.split() == text.split()


def test_other_versions_are_not_confirmed():
    assert names("Licensed under the Apache License, Version 1.1.") == [("Apache-2.0", False)]
    assert names("Licensed under CC BY-NC 3.0.") == [("CC-BY-NC-4.0", False)]
    assert names("He lost his driving license yesterday.")[0][1] is False


def test_small_changes_of_long_wording():
    changed = MIT.replace("free of charge", "without charge")
    (notice,) = Scanner(TEMPLATES).notices(changed)
    assert (notice.license_id, notice.confirmed) == ("MIT-text", True)
    assert notice.missing and notice.extra == "without"
    half = " ".join(MIT.split()[:40])
    assert all(not ok for _, ok in names(half))


def test_several_notices_in_order():
    text = f"{TEMPLATES['MIT']} a b c {TEMPLATES['GPL-3.0']} {'w ' * 50} {TEMPLATES['CC-BY-4.0']}"
    assert names(text) == [("MIT", True), ("GPL-3.0", True), ("CC-BY-4.0", True)]


def test_sizes_are_those_of_the_compressor():
    (n,) = Scanner(TEMPLATES).notices(TEMPLATES["MIT"])
    given = zstandard.ZstdCompressionDict(TEMPLATES["MIT"].encode(),
                                          dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = TEMPLATES["MIT"].encode()
    assert n.plain_bytes == len(zstandard.ZstdCompressor(level=19).compress(raw))
    assert n.given_bytes == len(zstandard.ZstdCompressor(level=19, dict_data=given).compress(raw))


def test_awkward_documents(spark):
    texts = [None, "", "no cue", TEMPLATES["MIT"], "w " * 50_000 + TEMPLATES["GPL-3.0"],
             TEMPLATES["MIT"], "LICENSED UNDER CC BY-SA 4.0"]
    docs = awkward(spark, texts)
    got = license_notices(docs)
    assert rows_of(got.where("confirmed"), "doc_id", "license_id", "start") == sorted(
        [(4, "MIT", 0), (5, "GPL-3.0", 100_000), (6, "MIT", 0), (7, "CC-BY-SA-4.0", 0)], key=repr)
    assert license_notices(docs.where("doc_id > 99")).collect() == []
    same = spark.createDataFrame([(None, TEMPLATES["MIT"])] * 2, "doc_id bigint, text string")
    assert rows_of(license_notices(same), "doc_id", "confirmed") == [(None, True)] * 2


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = sorted((r.doc_id, name) for r in docs.collect() for name in
                  ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0")
                  for _ in range((r.text or "").count(TEMPLATES[name])))
    assert rows_of(license_notices(docs).where("confirmed"), "doc_id", "license_id") == sorted(
        want, key=repr)


def test_wording_without_any_cue_word(spark):
    own = {"Own": "Members may pass this text on to others as long as they name the club."}
    text = own["Own"].replace("to others ", "to all others ")
    docs = spark.createDataFrame([(1, f"x y. {text} z"), (2, "Members may pass.")],
                                 "doc_id bigint, text string")
    got = license_notices(docs, own).collect()
    assert [(r.doc_id, r.license_id, r.missing, r.extra, r.confirmed) for r in got] == [
        (1, "Own", "", "all", True)]
    assert license_notices(docs, {}).collect() == license_notices(docs, {"": " "}).collect() == []


def test_any_tolerated_change_leaves_a_place_to_look_at(spark):
    """Every choice of changed words within the tolerance, in a template without cue words."""
    words = [f"w{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(20)]
    own = {"Own": " ".join(words)}
    rows = []
    for a in range(20):
        for b in range(a + 1, 20):
            kept = [w for i, w in enumerate(words) if i not in (a, b)]
            rows.append((100 * a + b, "pre\u00a0" + " * ".join(kept) + "\u2003post"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = license_notices(docs, own).where("confirmed").collect()
    assert sorted(r.doc_id for r in got) == [k for k, _ in rows]


def test_headers_in_comments_and_other_numbers():
    for name, text in TEMPLATES.items():
        lines = text.split()
        page = "/*\n" + "\n".join(" * " + " ".join(lines[i:i + 9]) for i in range(0, len(lines), 9))
        assert names(page + "\n */") == [(name, True)]
    for name in ("GPL-3.0-header", "LGPL-2.1-header", "MPL-2.0-header", "GPL-2.0-only-spdx"):
        changed = TEMPLATES[name].replace("version 3", "version 4").replace("2.", "7.")
        assert all(not sure for _, sure in names(changed))
