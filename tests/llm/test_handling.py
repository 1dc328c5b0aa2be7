"""Tables that operators must take without crashing: clashing extra columns, null ids and sources, repeated rows, very long texts."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heddle.llm import exact_dedup, html_extract, jaccard_join, mixing, pieces, pii, quality, queries, secret_scan, sharding, telephony

EXTRA = ("key", "id", "row", "digest", "salt", "spread", "heavy", "path", "place", "rep", "size", "n", "content", "kind", "base", "text_sha256", "class_id", "weight", "bucket", "hash")


def texts():
    pick = random.Random(12)
    word = lambda: "".join(pick.choices("abcdefghijkl", k=pick.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    plain = [" ".join(sentence(8) for _ in range(6)) for _ in range(12)]
    return [None, "", " \n", *plain, *plain[:3], plain[0] + " end", "a " * 60_000, "word" * 40_000, " ".join(word() for _ in range(30_000))]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts())]
    rows += [(None, "one of the rows without an id, which come twice here", None, None, None)] * 2 + [rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(EXTRA)})


OPERATORS = {
    "jaccard": jaccard_join.assign, "pii": pii.report, "sharding": sharding.assign, "secrets": secret_scan.report, "quality": quality.assess, "telephony": telephony.text_media,
    "exact": exact_dedup.assign, "pieces": lambda docs: pieces.encode(docs, queries.load_pieces()), "mixing": mixing.assign,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_document(odd, name):
    got = OPERATORS[name](odd).select("doc_id").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("nth", range(4))
def test_stages_keep_columns_and_whole_rows(spark, odd, nth):
    got = corpus_pipeline.STAGES[nth][1](spark, odd, "")
    assert got.columns == odd.columns
    assert {(r.doc_id, r.text) for r in got.collect()} <= {(r.doc_id, r.text) for r in odd.collect()} or nth == 3
    assert corpus_pipeline.STAGES[nth][1](spark, odd.limit(0), "").count() == 0


def test_encoding_of_an_empty_table(spark, odd):
    assert corpus_pipeline.STAGES[4][1](spark, odd.limit(0), "").count() == 0


def test_pages_that_repeat_or_clash(spark, data):
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>Title here</h1><p>Some words of an article.</p></article></body></html>"
    pages = spark.createDataFrame([(i % 3, "u", page, "x", 1) for i in range(9)] + [(None, None, None, None, None)], "page_id long, url string, html string, text string, key0 int")
    got = html_extract.extract(pages, model=html_extract.fit(spark.read.parquet(f"{data}/pages.parquet"))).collect()
    assert len(got) == 10 and len({r.text for r in got if r.page_id is not None}) == 1 and [r.text for r in got if r.page_id is None] == [""]


def test_copies_of_a_page_count_once_in_training(spark, monkeypatch):
    page = lambda i: f"<article><h1>Page {i}</h1><p>Words of page {i}.</p></article>"
    pages = spark.createDataFrame([(page(0),)] * 900 + [(page(i),) for i in range(1, 60)], "html string")
    taken = []
    monkeypatch.setattr(html_extract, "fit_pages", lambda pages, layouts: taken.extend(pages))
    html_extract.fit(pages, sample=40)
    assert len(taken) == len(set(taken)) == 40


BANDS = ((6, 20), (20, 60), (60, 200), (200, 1000))


def test_recall_of_the_join_by_size(spark):
    """Pairs just above the threshold and copies far above it, by the number of words."""
    pick = random.Random(13)
    word = lambda: "".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    pairs, rows = [], []
    for band, (low, high) in enumerate(BANDS):
        while sum(p[0] == band for p in pairs) < 120:
            own = [word() for _ in range(pick.randint(low, high))]
            near = list(own)
            for _ in range(pick.randint(1, max(1, len(own) // 45))):
                near[pick.randrange(len(near)) if len(own) > 60 else pick.choice((0, -1))] = word()
            a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (own, near))
            if len(a & b) >= 0.8 * len(a | b):
                pairs.append((band, len(rows), len(rows) + 1))
                rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(near))]
    got = {r.doc_id: r.class_id for r in jaccard_join.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for band in range(len(BANDS)):
        own = [got[a] == got[b] for k, a, b in pairs if k == band]
        print(BANDS[band], sum(own), "of", len(own))
        assert sum(own) >= 0.98 * len(own)
