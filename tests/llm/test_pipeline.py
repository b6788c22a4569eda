from zlib import crc32

import corpus_pipeline
import sentencepiece
from graphloom.llm.piece_codec import MODEL
from graphloom.llm.toxicity import fit, toxicity
from tests.llm import test_decontaminate, test_jaccard_join, test_line_dedup

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    model = fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity(docs, model).filter("predicted = 1").collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, docs, SF)
    assert one.columns == cols and {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect()} - bad
    two = stages[1](spark, one, SF)
    want = {d: t for d, _, t in test_line_dedup.brute([(r.doc_id, r.text) for r in one.collect()])}
    assert two.columns == cols and {r.doc_id: r.text for r in two.collect()} == want
    assert all(r.n_chars == len(r.text) for r in two.collect())
    three = stages[2](spark, two, SF)
    want = {d: want[d] for d, _, c in test_jaccard_join.brute(list(want.items()), 5, 80) if d == c}
    assert three.columns == cols and {r.doc_id: r.text for r in three.collect()} == want
    four = stages[3](spark, three, SF)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in test_decontaminate.brute(list(want.items()), bench)}
    want = {d: t for d, t in want.items() if d not in leaks}
    assert four.columns == cols and {r.doc_id: r.text for r in four.collect()} == want
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = {d: library.encode(t) for d, t in want.items()}
    assert {r.doc_id: r.ids for r in stages[4](spark, four, SF).collect()} == ids
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()} == ids
    assert crc32(b"1") % 5 in range(5)
