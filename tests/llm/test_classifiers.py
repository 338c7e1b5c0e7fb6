"""Held-out accuracy of the classifiers, their edge cases, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackweave.llm import quality, queries, toxicity
from stackweave.llm.learning import held_out

FOLDER = "/root/testdata/sf0.01"


def auc(y, x):
    order = np.argsort(np.argsort(x)) + 1
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.fixture(scope="module")
def tables(spark):
    return queries.table(spark, FOLDER, "documents"), queries.table(spark, FOLDER, "labels")


@pytest.mark.parametrize("module,label,column,least", [(quality, "quality", "quality_score", 0.9), (toxicity, "toxic", "toxic_score", 0.9)])
def test_held_out(tables, module, label, column, least):
    docs, labels = tables
    model = module.fit(docs, labels, label)
    got = module.score(docs, model).where(held_out()).join(labels, "doc_id").select(label, column).toPandas()
    assert got[column].between(0, 1).all()
    assert auc(got[label].to_numpy(), got[column].to_numpy()) > least


@pytest.mark.parametrize("module,column", [(quality, "quality_score"), (toxicity, "toxic_score")])
def test_edges(spark, tables, module, column):
    docs, labels = tables
    model = module.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (2, "", 5.0), (3, " \n", 5.0), (None, "A word. Another!", 5.0), (4, "word " * 50_000, None)], f"doc_id long, text string, {column} double")
    got = module.score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r[column] <= 1 for r in got)
    assert len({round(r[column], 9) for r in got if r["doc_id"] in (1, 2)}) == 1
    assert module.score(odd.limit(0), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    blank = module.fit(docs, none)
    assert {round(r[column], 6) for r in module.score(odd, blank).collect()} == {0.5}
    assert module.score(odd.withColumnRenamed(column, column.upper()), blank).columns[-1] != column.upper()


@pytest.mark.parametrize("label", [0, 1])
def test_toxicity_of_one_class(spark, tables, label):
    """Nothing is learned from one class: the share of label 1 for all, no sentence stands out, the filter keeps all."""
    docs, labels = tables
    model = toxicity.fit(docs, labels.withColumn("toxic", F.lit(label)))
    some = docs.limit(50).withColumns({"toxic_score": F.lit("mine"), "rest": F.lit(1)})
    got = toxicity.score(some, model).collect()
    assert {r["toxic_score"] for r in got} == {float(label)} and not any(r["offending"] for r in got)
    kept = toxicity.filter_toxic(some, model)
    assert kept.columns == some.columns and kept.count() == 50


def test_filter_toxic_keeps_columns(tables):
    docs, labels = tables
    some = docs.withColumns({"toxic_score": F.lit("mine"), "rest": F.lit(1)})
    model = toxicity.fit(docs, labels)
    kept = toxicity.filter_toxic(some, model)
    assert kept.columns == some.columns and kept.where("toxic_score = 'mine' AND rest = 1").count() == toxicity.score(docs, model).where("toxic_score < 0.5").count() < docs.count()


def test_pipeline_without_labels(spark, tmp_path):
    """The first stage of a corpus without labels keeps every document."""
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()


def test_same_score_wherever_a_text_stands(spark, tables):
    docs, labels = tables
    few = docs.limit(60)
    for module, column in ((quality, "quality_score"), (toxicity, "toxic_score")):
        model = module.fit(docs, labels)
        a = {r["doc_id"]: r[column] for r in module.score(few, model).collect()}
        b = {r["doc_id"]: r[column] for r in module.score(few.repartition(5), model).collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_gradient():
    r = np.random.default_rng(0)
    g = lambda *n: r.normal(0, 0.5, n)
    w = {"E": g(quality.FEATURES, 4), "e": g(4), "V": g(4, 3), "G": g(4, 3), "u": g(3), "c": g(4), "b": g(1)}
    m = quality.GatedAttention(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), w)
    x, at, y = g(7, quality.FEATURES), np.array([0, 2, 3, 7]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(m.forward(x, at)["p"]) + (1 - y) * np.log(1 - m.forward(x, at)["p"]))
    grad = m.step(x, at, y)
    for k in w:
        i = tuple(r.integers(0, n) for n in w[k].shape)
        old = w[k][i]
        w[k][i] = old + 1e-5
        up = loss()
        w[k][i] = old - 1e-5
        down = loss()
        w[k][i] = old
        assert abs((up - down) / 2e-5 - grad[k][i]) < 1e-6


def holds_item(doc, item):
    """Whether some window of 13 words (the item, if shorter) laid word by word over the document has 4/5 of them equal."""
    n, need = len(item), min(13, len(item))
    if not n or len(doc) < need:
        return False
    own = np.concatenate([np.full(n - 1, -1), doc, np.full(n - 1, -1)])
    view = np.lib.stride_tricks.sliding_window_view
    same, inside = view(own, n) == item, view(own >= 0, n)
    total = lambda x: view(x, need, axis=1).sum(-1)
    return bool(((total(inside) == need) & (5 * total(same) >= 4 * need)).any())


def test_pipeline(spark):
    """Each stage keeps of its own input what its rule says, by brute force; the last gives every text's ids."""
    import re

    import corpus_pipeline

    from stackweave.llm import lines

    from .test_text_operators import LOW, SPACE, brute_components

    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram jaccard join", "benchmark decontamination", "sentencepiece"]
    text = lambda d: {r["doc_id"]: r["text"] or "" for r in d.collect()}

    def run(name, want):
        out = stages[name](spark, docs, folder)
        assert out.columns == docs.columns
        got = out.collect()
        assert {r["doc_id"]: r["text"] or "" for r in got} == want, name
        return spark.createDataFrame(got, docs.schema), want

    before = text(docs)
    model = toxicity.fit(docs, queries.table(spark, folder, "labels"))
    low = {r["doc_id"] for r in toxicity.score(docs, model).where("toxic_score < 0.5").collect()}
    docs, now = run("toxicity", {d: t for d, t in before.items() if d in low})
    assert 0 < len(before) - len(now) < 40
    key = lambda x: x.strip(SPACE).translate(LOW)
    first, want = {}, {}
    for d in sorted(now):
        for x in now[d].split("\n"):
            first.setdefault(key(x), d)
    for d, t in now.items():
        kept = [x for x in t.split("\n") if len(key(x)) < lines.MIN_CHARS or first[key(x)] == d]
        if len(kept) == t.count("\n") + 1 or "\n".join(kept).strip(SPACE):
            want[d] = "\n".join(kept)
    docs, now = run("line dedup", want)
    assert all(r["n_chars"] == len(r["text"] or "") for r in docs.collect())
    docs, now = run("n-gram jaccard join", {d: now[d] for d, (_, c) in brute_components(5, 80, 100, now).items() if d == c})
    words = lambda t: re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t.translate(LOW))
    code = {}
    coded = lambda t: np.array([code.setdefault(w, len(code)) for w in words(t)], np.int64)
    items = [coded(r["text"]) for r in queries.table(spark, folder, "benchmark").collect()]
    docs, now = run("benchmark decontamination", {d: t for d, t in now.items() if not any(holds_item(coded(t), i) for i in items)})
    last = stages["sentencepiece"](spark, docs, folder).collect()
    assert {r["doc_id"] for r in last if r["round_trip"]} == now.keys() == {r["doc_id"] for r in last}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, folder).collect()} == {r["doc_id"]: r["ids"] for r in last}


def test_contract_columns(spark):
    want = {
        "op1_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
        "op3_ngram_jaccard": {"doc_id", "n_shingles", "component_id"},
        "op5_suffix_array_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
        "op6_toxicity": {"doc_id", "held_out", "score", "predicted"},
        "op7_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
        "op8_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
        "op9_token_binary": {"doc_id", "start", "n_tokens", "ids_crc32"},
        "op10_secret_scans": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
        "op12_fill_middle": {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"},
        "op13_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    }
    for name, columns in want.items():
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert columns <= set(got.columns)
        assert got.count() == 200
    nodes = {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"}
    assert nodes <= set(queries.QUERIES["op11_prefix_trie"](spark, "/root/testdata/sf0.001").columns)
    assert set(queries.QUERIES) == {*want, "op2_sentencepiece", "op4_decontamination", "op11_prefix_trie"}


def test_line_dedup_sql(spark):
    from ..oracle import of_query, of_sql

    assert of_query(spark, queries.op7_line_dedup) == of_sql(queries.OP7_SQL)
