"""The pipeline against each stage's decision taken by brute force."""

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_near_duplicates import brute as components
from tests.llm.test_personal_data import base_spans
from tidemark.llm import quality, sentence_pieces
from tidemark.llm.queries import tokenizer_file

SF_DIR = "/root/testdata/sf0.001"


def test_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    left = {r.doc_id: r for r in docs.collect()}
    kept = {r.id for r in quality.judge(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect() if r.kept}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        rows = {r.doc_id: r for r in out.collect()}
        texts = [(i, r.text) for i, r in left.items()]
        if name == "quality_rules":
            assert set(rows) == kept and all(len(left[i].text.split()) >= 50 for i in kept)
        elif name == "near_duplicates":
            assert set(rows) == {i for i, root in components(texts, 5, 80).items() if i == root}
        elif name == "decontamination":
            assert set(rows) == set(left) - {d for d, *_ in leaks(texts, items)}
        elif name == "personal_data":
            assert set(rows) == set(left)
            for i, r in rows.items():
                assert (r.text == left[i].text) == (not base_spans(left[i].text)) and base_spans(r.text) == []
                assert r.n_chars == len(r.text)
        else:
            codec = sentence_pieces.codec(tokenizer_file("piece_bpe_32k.model"))
            assert {i: r.ids for i, r in rows.items()} == {i: codec.encode(r.text) for i, r in left.items()}
            assert all(r.round_trip and r.n_ids == len(r.ids) for r in rows.values())
            assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(tuple, out.collect()))
            break
        assert out.columns == docs.columns
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        docs, left = spark.read.parquet(path), rows


def test_awkward_documents_go_through(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b " * 60_000, "en", "s", 1), (None, "word " * 60, None, "s", 2), (4, " ".join(f"w{i}" for i in range(80)), "en", "s", 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, SF_DIR).columns == docs.columns
            stage(spark, table, SF_DIR).collect()
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF_DIR).count() == table.count()


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
