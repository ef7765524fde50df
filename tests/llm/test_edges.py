"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, exact_dedup, html_text, packing, quality, secret_scan, simhash, suffix_dedup, toxicity, url_filter

LONG = "word " * 30_000
CLASHES = "k t x y h a g s m n own left closed name block level row_hash label score edits i task rank offset host path verdict rule best".split()


def docs_of(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES:
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


ROWS = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, " \n\t", "en", "s", 3), (4, LONG, "en", "s", 1), (5, "a b c", "en", "s", 5), (5, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5), (6, "ab  c", "en", "s", 5), (7, "ünï 漢字 😀", "de", "s", 1)]


@pytest.fixture(scope="module", params=["rows", "none"])
def docs(request, spark):
    return docs_of(spark, ROWS if request.param == "rows" else [])


def test_suffix_dedup(spark, docs):
    got = suffix_dedup.remove_repeats(spark, docs)
    assert got.count() == docs.count()
    by = {r.doc_id: r for r in got.collect()}
    if by:
        assert (by[1].n_bytes, by[1].n_removed, by[4].n_removed, by[5].n_spans) == (0, 0, len(LONG), 0)


def test_exact_dedup(spark, docs):
    rows = exact_dedup.exact_dedup(spark, docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    if by:
        # Null, empty and blank texts are one group, of which the longest original stays.
        assert [by[i].keep_id for i in (1, 2, 3)] == [3, 3, 3] and by[3].kept and not by[1].kept
        assert by[5].group_size == 4 and by[5].keep_id == 5 and by[6].keep_id == 5 and by[None].keep_id == 5 and not by[None].kept


def test_simhash(spark, docs):
    rows = simhash.near_duplicates(spark, docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    if by:
        assert [by[i].component_id for i in (1, 2, 3)] == [1, 1, 1] and by[None].component_id == 5 and by[2].fp == 0


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "word " * 20), (2, None), (3, ""), (None, "never in any of the texts at all, not at all")], "item_id int, text string").withColumn("k", F.lit(0))
    got = decontamination.find_items(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == ({(4, 1)} if docs.count() else set())
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == max(0, docs.count() - 1)
    assert decontamination.find_items(docs, items.limit(0)).count() == 0


def test_packing(spark, docs):
    rows = packing.pack(spark, docs, packing.default_tokenizer()).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    if rows:
        assert [r.length for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers(spark, docs, module):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit(0))
    for known in (labels, labels.limit(0)):
        got = module.score(docs, module.learn(docs, known)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)


def test_secret_scan(spark, docs):
    got = secret_scan.scan_secrets(docs).collect()
    assert len(got) == docs.count() and not any(r.assign or r.access or r.hex or r.entropy for r in got)


def test_pages(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.COM", "https://a.b.example.com/en/1?x=/es/", "http://www.example.com/en/", "ftp://x.net/es/#", "http://net/fr/a", "://com/", "http://com?/en/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "<p>x, y" if i % 2 else None) for i, u in enumerate(urls)] + [(0, None, "")], "page_id long, url string, html string").withColumn("rule", F.lit(1)).withColumn("u", F.lit(2)).withColumn("h", F.lit(2)).withColumn("key", F.lit(2))
    rows = url_filter.filter_urls(spark, pages, url_filter.rules(spark)).collect()
    assert len(rows) == len(urls) + 1
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert by[0] == by[1] == by[2] == ("", "", None, "allow")
    assert by[4] == ("example.com", "", None, "allow")
    assert by[5] == ("a.b.example.com", "/en/1", "example.com/en/", "block")
    assert by[6] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert by[7] == ("x.net", "/es/", "net/es/", "block") and by[8][2] == "net/fr/" and by[9] == ("com", "/", "com/", "allow") and by[10] == ("com", "", None, "allow")
    assert by[11] == ("b:", "//c/d", None, "allow")
    assert {r.text for r in html_text.extract_pages(pages).collect()} == {"", "x, y"}
    assert url_filter.filter_urls(spark, pages.limit(0), url_filter.rules(spark).limit(0)).count() == 0


def test_stages(spark, tmp_path):
    import corpus_pipeline

    for rows, name in ((ROWS, "rows"), ([], "none")):
        folder = str(tmp_path / name)
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        frame.withColumn("k", F.lit("clash")).withColumn("label", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(4, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "word " * 20)] if rows else [], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        # 1 and 2 equal 3, which has the most characters; 6 equals 5; 4 has the item. A null id is not matched.
        assert sorted({r.doc_id for r in got if r.doc_id is not None}) == ([3, 5, 7] if rows else [])
