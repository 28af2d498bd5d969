import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerline.llm import catalog, near_dedup, pii
from ledgerline.llm.language_id import has_letter


def test_stages_by_brute_force(spark, sf_dir):
    docs = catalog.table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    start = {r.doc_id: r.text for r in catalog.table(spark, sf_dir, "documents").collect()}

    assert kept["language_id"] == {i: t for i, t in start.items() if has_letter(t)}
    best = {}
    for i, t in kept["language_id"].items():
        key = t.encode().lower()
        best[key] = max(i, best.get(key, i))
    assert kept["exact_dedup"] == {i: start[i] for i in best.values()}

    before, after = kept["exact_dedup"], kept["near_dedup"]
    words = {i: t.lower().split() for i, t in before.items()}
    for i in before.keys() - after.keys():  # what went has a similar text that was there
        assert any(near_dedup.similar(words[i], words[j]) for j in before if j != i)
    ids = sorted(after)
    grams = {i: {tuple(words[i][n:n + 5]) for n in range(max(1, len(words[i]) - 4))} for i in ids}
    for n, i in enumerate(ids):  # and no two that stayed have much the same shingles
        for j in ids[n + 1:]:
            assert len(grams[i] & grams[j]) < 0.8 * len(grams[i] | grams[j])
    assert kept["pii"] == {i: pii.redact_text(t) for i, t in after.items()}
    assert not any(k == "email" for t in kept["pii"].values() for k, *_ in pii.find_spans(t))

    library = Tokenizer.from_file(catalog.vocabulary("word_bpe_49k.json"))
    pieces = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert pieces.keys() == kept["pii"].keys()
    for i, own in pieces.items():
        ids = library.encode(kept["pii"][i], add_special_tokens=False).ids + [2]
        assert np.frombuffer(b"".join(x for _, x in sorted(own)), "<u4").tolist() == ids


def test_edge_rows_go_through_every_stage(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, ""), name)
            assert docs.columns == columns
        n = corpus_pipeline.STAGES[-1][1](spark, docs, "").select("doc_id").distinct().count()
        assert n == docs.select("doc_id").distinct().count()


def test_documents_without_languages_stay(spark, edge_docs):
    """No labelled row teaches the classifier: only texts without a letter go."""
    docs = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert got.columns == docs.columns
    want = [r.text for r in docs.collect() if has_letter(r.text or "")]
    assert len(want) > 40 and sorted(r.text for r in got.collect()) == sorted(want)
