"""Every operator and stage over empty tables, nulls, repeated rows, ties, very long texts and clashing columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, license_scan, quality, sentencepiece, simhash, suffix_array, surrogates, toxicity, url_filter, warc_revisit
from tests.llm.test_operators import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = words(30, 77)
#: Names that operators use or add.
CLASHING = ["_id", "_k", "_n", "_lang", "_source", "_g", "_t", "_w", "_hw", "_l", "_h", "_p", "_row", "_notes", "_attempts", "usable", "d2", "n_lines", "s_length", "item", "window", "key", "slice", "fp", "anchor", "canonical", "host_", "Runs", "value"]


def documents(spark):
    base, long_ = words(150, 1), words(40_000, 2)
    rows = [
        (1, f"{base} {ITEM}", "en", "a", 1), (2, base, "en", "a", 2), (2, base, "en", "a", 2), (3, base.replace(base.split()[70], "other", 1), "en", None, 3),
        (None, base, None, None, None), (None, None, None, None, None), (None, None, None, None, None), (4, "", "en", "a", 0), (5, "a", "en", "a", 1),
        (6, long_, "en", "a", len(long_)), (7, f"{long_[:60_000]} {ITEM}", "de", "b", 5), (2, words(60, 9), "en", "a", 2), (8, "x" * 300_000, "en", "a", 8), (9, " \t\n" * 50, "en", "a", 9), (10, "Mr. Al Smith, a.b@c.org, Smith 日本 ß " + words(50, 10), "xx", "é", 10),
    ]
    return spark.createDataFrame(rows, DOCS)


def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, ""), (3, None), (None, "x y z"), (1, ITEM)], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (6, 0), (6, 1)], "doc_id long, toxic int")


OPERATORS = {
    "op1": lambda s, d: decontaminate.leaks(d, items(s)),
    "op3": lambda s, d: toxicity.score_toxicity(d, labels(s)),
    "op4": lambda s, d: sentencepiece.encode_texts(d),
    "op5": lambda s, d: simhash.simhash_groups(d),
    "op6": lambda s, d: quality.quality_rules(d).select("doc_id", *quality.RESULT),
    "op7": lambda s, d: suffix_array.remove_repeats(d),
    "op8": lambda s, d: surrogates.replace_entities(d).select("doc_id", "text", "lang", "source", "n_chars", "n_entities", "kinds"),
    "op9": lambda s, d: license_scan.scan_licenses(d, license_scan.template_table(s)),
}
#: The stages that keep the columns of documents.
STAGES = {"quality": lambda s, d: quality.good_documents(d), "near": lambda s, d: simhash.one_of_each(d), "leaks": lambda s, d: decontaminate.without_leaks(d, items(s)), "private": lambda s, d: surrogates.replace_entities(d), "tokens": lambda s, d: sentencepiece.encode_texts(d, keep_ids=True), "rules": lambda s, d: quality.quality_rules(d)}


def clashed(docs):
    return docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING])


def rows(df, columns=None):
    return Counter(str(r) for r in df.select(*(columns or df.columns)).collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(spark, name):
    run, docs = OPERATORS[name], documents(spark)
    got = run(spark, docs)
    plain = rows(got)
    assert rows(run(spark, clashed(docs)), got.columns) == plain
    if name == "op1":
        assert {r.doc_id for r in got.collect()} == {1, 7}
    else:
        assert sum(plain.values()) == docs.count()  # every row stays, repeats too
    empty = run(spark, docs.limit(0))
    assert empty.columns == got.columns and empty.count() == 0
    no_text = run(spark, docs.select("doc_id", F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars"))
    assert no_text.count() == (0 if name == "op1" else docs.count())


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stage(spark, name):
    run, docs = STAGES[name], documents(spark)
    wide = clashed(docs)
    got = run(spark, wide)
    assert got.columns[: len(wide.columns)] == wide.columns
    for r in got.collect():
        assert all(r[c] == f"{c}:{'none' if r.doc_id is None else r.doc_id}" for c in CLASHING)
    assert rows(got, docs.columns) == rows(run(spark, docs), docs.columns)
    empty = run(spark, wide.limit(0))
    assert empty.columns == got.columns and empty.count() == 0
    if name == "near":
        ids = [r.doc_id for r in got.collect()]
        assert ids.count(2) == 2 and 5 in ids  # two texts of one id; a tie keeps the smallest


@pytest.mark.parametrize("run", [surrogates.replace_entities, lambda d: sentencepiece.encode_texts(d, keep_ids=True), quality.quality_rules, simhash.one_of_each, quality.good_documents])
def test_tables_without_texts(spark, run):
    d = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, other string")
    assert run(d).count() >= 0


def test_urls(spark):
    urls = ["http://a.example.net/en/x", None, "", "://", "http://" + "a." * 2000 + "net/" + "p/" * 20_000, "HTTP://ORG/fr/" + "x" * 100_000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2 + [(None, None)], "page_id long, url string")
    for d in (pages, pages.select("*", *[F.lit(1).alias(c) for c in ("_h", "_p", "e_host", "lengths", "prefix", "digest")])):
        got = url_filter.judge_urls(d, url_filter.rule_table(spark))
        assert Counter(r.verdict for r in got.collect()) == {"allow": 11, "block": 2} and set(d.columns) <= set(got.columns)
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_crawls(spark):
    kind = "record_id long, url string, ts long, revisit boolean, etag string, last_modified string, digest string, headers map<string,string>"
    rows_ = [(1, "http://a.org/", 1, False, None, None, None, None), (2, "http://a.org/", 1, False, "t", None, None, {"x": None}), (3, "http://a.org", 2, True, "t", None, None, None), (3, "http://a.org", 2, True, "t", None, None, None), (None, None, None, None, None, None, None, None), (None, None, None, True, None, None, None, None), (4, "http://a.org/" + "y" * 100_000, 5, True, None, None, None, {}), (5, "http://b.org/", None, False, "u", None, None, {}), (6, "http://b.org/", -5, True, "u", None, None, {}), (7, "http://b.org/", None, True, "u", None, None, {})]
    d = spark.createDataFrame(rows_, kind)
    for t in (d, d.select("*", *[F.lit("z").alias(c) for c in ("part", "found", "full", "canonical", "carry", "asked")])):
        for parts in (None, 2, 500):
            got = Counter((r.record_id, r.response_id, r.outcome) for r in warc_revisit.resolve_revisits(t, parts).collect())
            assert got == {(3, 2, "resolved"): 2, (None, None, "missing"): 1, (4, None, "missing"): 1, (6, 5, "resolved"): 1, (7, None, "missing"): 1}
    assert warc_revisit.resolve_revisits(d.limit(0)).count() == 0


def test_hot_tick_and_hot_url(spark):
    d = spark.range(3000).select(F.col("id").alias("record_id"), F.lit("http://a.org/").alias("url"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("ts"), (F.col("id") % 2 == 1).alias("revisit"), F.lit("t").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"), F.expr("map('a', 'b')").alias("headers"))
    rows_ = [(r.record_id, r.ts, r.revisit) for r in d.collect()]
    full = sorted((t, i) for i, t, v in rows_ if not v)
    for parts in (3, 200):
        got = {r.record_id: r.response_id for r in warc_revisit.resolve_revisits(d, parts).collect()}
        for i, t, v in rows_:
            if v:
                before = [x for x in full if x[0] < t]
                assert got[i] == (before[-1][1] if before else None)
