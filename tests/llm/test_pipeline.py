import corpus_pipeline as C
from siltstone.llm import bpe, decontamination, language, lines, near

from .helpers import documents, no_docs, odd_docs
from .test_near import similar_pairs


def test_stages_filter_what_their_operators_say(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf)
    columns, ids = docs.columns, lambda d: {r[0] for r in d.select("doc_id").collect()}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    for i, (_, stage) in enumerate(C.STAGES[:-1]):
        out = C.materialize(stage(spark, docs, sf), f"t{i}")
        assert out.columns == columns and out.dtypes == docs.dtypes
        before, after = ids(docs), ids(out)
        if i == 0:
            assert after == {r.doc_id for r in language.identify(docs).collect() if r.accepted}
            assert len(after) >= 0.99 * len(before)
        elif i == 1:
            cut = ids(lines.common_blocks(docs))
            text = {r.doc_id: r.text for r in docs.collect()}
            assert before - after <= cut and cut
            assert all((r.text == text[r.doc_id]) == (r.doc_id not in cut) for r in out.collect())
            assert all(r.n_chars == len(r.text) for r in out.collect() if r.doc_id in cut)
        elif i == 2:
            gone = before - after
            assert gone == {r.doc_id for r in near.near_duplicates(docs).collect() if not r.keep}
            left = similar_pairs(out, near.SIMILARITY)
            assert len(left) <= 0.1 * max(1, len(similar_pairs(docs, near.SIMILARITY)))
        else:
            assert before - after == ids(decontamination.contaminated(docs, bench))
        docs = out
    rows = C.STAGES[-1][1](spark, docs, sf)
    assert all(r.lossless for r in rows.collect())
    assert {tuple(r) for r in bpe.decode(rows).collect()} == {(r.doc_id, r.text) for r in docs.collect()}
    assert {r.doc_id: r.ids for r in C.run(spark, sf).collect()} == {r.doc_id: r.ids for r in rows.collect()}


def test_edges(spark, sf):
    assert 4 <= len(C.STAGES) <= 5
    odd = odd_docs(spark)
    writable = odd.toDF(*("other" if c == "DOC_ID" else c for c in odd.columns))  # Parquet has no two names that differ by case only
    for rows in (writable, no_docs(spark)):
        docs = rows
        for i, (_, stage) in enumerate(C.STAGES):
            docs = C.materialize(stage(spark, docs, sf), f"e{i}")
            assert i == len(C.STAGES) - 1 or docs.columns == rows.columns
