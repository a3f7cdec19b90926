import sentencepiece

import corpus_pipeline
from seedweave.llm import jaccard_join, mixing, suffix_dedup
from seedweave.llm.common import table
from seedweave.llm.queries import MIX_SEED, MIX_WEIGHTS, ORACLES, QUERIES, piece_model


def test_stages_follow_one_another(spark, shared_folder):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    columns, tables = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.write_stage(stage(spark, tables[-1], sf_dir), "test"))
    raw, good, single, cut, mixture, coded = tables
    assert all(t.columns == columns for t in tables[:-1])
    ids = [{r["doc_id"] for r in t.select("doc_id").collect()} for t in tables]
    assert ids[1] < ids[0] and ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] <= ids[3] and ids[5] == ids[4]
    links = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(good).collect()}
    assert ids[2] == set(links.values())
    left = {r["doc_id"]: r for r in suffix_dedup.deduplicated(single).collect()}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {i: r["text"] for i, r in left.items() if not r["n_removed"] or r["text"].strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    expected = mixing.mixed(cut, MIX_WEIGHTS, seed=MIX_SEED).groupBy("doc_id").count()
    assert sorted(mixture.groupBy("doc_id").count().collect()) == sorted(expected.collect())
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = {r["doc_id"]: r["text"] for r in mixture.collect()}
    for r in coded.collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["decoded"] == library.decode(r["ids"]) and r["n_tokens"] == len(r["ids"])


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_empty_documents(spark, shared_folder, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0
