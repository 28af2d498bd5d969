import zlib

import numpy as np

from ledgerline.llm import catalog, language_id, toxicity


def out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_language_query_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in catalog.table(spark, sf_dir, "documents").collect()}
    got = catalog.op4_language_id(spark, sf_dir).collect()
    assert len(got) == len(lang) and all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.97


def test_language_edges(spark, edge_docs, edge_rows, no_docs):
    model = language_id.train(edge_docs)
    got = language_id.identify(edge_docs, model).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        if r.doc_id in (40, 41, 50, 52):  # null, empty, no letter
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("en", "de", "fr")
    kept = language_id.keep_identified(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == len(edge_rows) - 4
    empty = language_id.train(no_docs)
    assert language_id.identify(no_docs, empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(edge_docs, empty).collect()} == {"und"}


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 6, 9, 30):
        code = language_id.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else code.shape[1] // 4)


def test_wrong_bits_are_corrected():
    code = language_id.codewords(6)
    model = language_id.Model(list("abcdef"), code, np.zeros(0), np.full(code.shape, 1 / code.shape[1]), 1.0)
    for i in range(6):
        outputs = code[i].astype(float)
        outputs[[1, 5, 9, 20]] *= -0.8
        assert model.distances(outputs[None])[0].argmin() == i


def test_toxicity_query(spark):
    sf_dir = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in catalog.table(spark, sf_dir, "labels").collect()}
    text = {r.doc_id: r.text.lower() for r in catalog.table(spark, sf_dir, "documents").collect()}
    got = catalog.op5_toxicity(spark, sf_dir).collect()
    assert len(got) == len(text) and all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    marked = [r for r in held if toxic[r.doc_id] and any(w in text[r.doc_id] for w in ("idiot", "stupid", "moron"))]
    clean = [r for r in held if not toxic[r.doc_id]]
    assert np.mean([r.predicted for r in marked]) > 0.9 and np.mean([r.predicted for r in clean]) < 0.02
    # all held-out rows of label 1, whatever their words: under half reach the cut
    bad = np.array([r.score for r in held if toxic[r.doc_id]])
    good = np.array([r.score for r in clean])
    assert np.mean(bad >= 0.7) > 0.4
    assert np.mean((bad[:, None] > good).mean(axis=1) + (bad[:, None] == good).mean(axis=1) / 2) > 0.88  # area under the curve


def test_toxicity_edges(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 0, 1), (4, None, None), (None, 1, 1), (1, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = toxicity.train(edge_docs, known)
        got = toxicity.score(edge_docs, model).collect()
        assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(no_docs, toxicity.train(no_docs, labels)).count() == 0
