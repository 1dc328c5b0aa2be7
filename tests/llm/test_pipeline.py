"""The pipeline on a small table, stage by stage against brute force, and the registered queries."""

from collections import Counter

import corpus_pipeline
from heddle.llm import exact_dedup, jaccard_join, mixing, queries
from tests.llm.test_jaccard import brute


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, found = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], data).write.parquet(str(tmp_path / str(i)))
        found.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(f.columns == columns for f in found[:-1])
    good, unique, single, mixed, encoded = ([r.asDict() for r in f.collect()] for f in found[1:])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    assert sum(i in kept for i, q in labels.items() if q) >= 0.97 * sum(labels.values())
    firsts = {}
    for r in sorted(good, key=lambda r: r["doc_id"]):
        firsts.setdefault(r["text"], r["doc_id"])
    assert {r["doc_id"] for r in unique} <= set(firsts.values())
    ids = sorted(r["doc_id"] for r in unique)
    texts = {r["doc_id"]: r["text"] for r in unique}
    want = brute([texts[i] for i in ids])
    assert sorted(r["doc_id"] for r in single) == [ids[i] for i, (c, _) in want.items() if c == i]
    taken = {r.doc_id: r.taken for r in mixing.assign(found[3]).collect()}
    words = Counter()
    for r in mixed:
        words[r["doc_id"]] += len(r["text"].split())
    assert all(words[i] == n for i, n in taken.items())
    rows_of = {r["doc_id"]: r for r in single}
    assert all(r == rows_of[r["doc_id"]] for r in mixed)  # whole texts, as they were
    assert Counter(r["doc_id"] for r in encoded) == Counter(r["doc_id"] for r in mixed)
    own = queries.load_pieces()
    text_of = {(r["doc_id"], r["text"]) for r in mixed}
    assert all((r["doc_id"], own.decode(list(r["ids"]))) in text_of for r in encoded)


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


def test_operators_agree_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = brute([r.text for r in rows])
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.assign(docs).collect()}
    assert got == {rows[i].doc_id: (rows[c].doc_id, n) for i, (c, n) in want.items()}
    assert exact_dedup.assign(docs).filter("kept").count() == exact_dedup.deduplicate(docs).count()
