import __spark_entry__
import corpus_pipeline
from credence.llm import merge_automaton, ngram_join, source_schedule

FOLDER = "/root/testdata/sf0.001"


def test_stages_hand_on_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        rows = out.collect()
        counts.append(len(rows))
        if name != "bpe_encoding":
            assert out.columns == columns
            assert all(r.text == before[r.doc_id].text for r in rows)
            docs = spark.createDataFrame(rows, docs.schema)
        if name == "ngram_jaccard_join":
            assert len({r.doc_id for r in rows}) == len(rows)
            assert all(r.component_id == r.doc_id for r in ngram_join.near_components(docs).collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "ngram_jaccard_join", "source_mix", "bpe_encoding"]
    assert counts[0] >= counts[1] >= counts[2] > 0 and counts[3] == counts[4]


def test_later_stages_equal_their_operators(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    stages = dict(corpus_pipeline.STAGES)
    mixed = stages["source_mix"](spark, docs, FOLDER)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in source_schedule.mixture(docs).collect())
    import public_tokenizers
    want = merge_automaton.encoded(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted(map(str, stages["bpe_encoding"](spark, docs, FOLDER).collect())) == sorted(map(str, want))


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert set(__spark_entry__.oracle_sql()) <= names
