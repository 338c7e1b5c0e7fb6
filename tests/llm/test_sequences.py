"""The prefix trie, fill-in-the-middle and language identification against brute force, edge cases included."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stackweave.llm import fill_middle, language, prefix_trie, queries
from stackweave.llm import text as X

from ..oracle import FOLDER, of_query, of_sql

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, conv string, name int"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_fill_middle"])
def test_query(spark, name):
    assert of_query(spark, queries.QUERIES[name]) == of_sql(queries.SQL[name])


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [out[k] for k in kids[p]]
        ends = ",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), sum(b[5] for b in below) or 1, saved + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def conversations(seed):
    r = random.Random(seed)
    texts = ["a b", "", None, "x", "one two  three ", "é\n\t"]
    rows = []
    for c in [*range(0, 65), 140, 141, 12345678901, 12345678900]:
        like = r.choice(rows)[0] if rows and r.random() < 0.4 else None
        turns = [x[1:4] for x in rows if x[0] == like] if like is not None else [(t, r.choice(["user", "assistant", None]), r.choice(texts)) for t in range(r.choice([1, 2, 3, 4, 5, 8, 9, 17, 40]))]
        if r.random() < 0.3:
            turns = [*turns[:-1], (turns[-1][0], "user", "else")]
        if r.random() < 0.2:
            turns[0] = (None, *turns[0][1:])
        rows += [(c, *t, "clash", 1) for t in turns]
    rows += [(None, 0, "user", "gone", "clash", 1), rows[5], rows[5]]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie(spark, seed):
    rows = conversations(seed)
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_trie_of_hot_and_deep_conversations(spark):
    """Copies of one conversation, one first turn, and a chain far longer than the others."""
    rows = [(c, t, "user", f"turn {t}", "", 0) for c in range(400, 700) for t in range(5)]
    rows += [(c, t, "user", "turn 0" if not t else f"{c} {t}", "", 0) for c in range(700, 760) for t in range(3)]
    rows += [(c, t, "user", f"turn {t}" if c == 401 or t < 150 else "other", "", 0) for c in (800, 801, 803, 805) for t in range(333 + c % 3)]
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS).repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_trie_edges(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(none).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b", "", 0)], TURNS)).count() == 0
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 2)  # its two turns go, its group's start has none
    rows = [(c, 0, None, None, None, None), (c, 1, "user", "word " * 100_000, None, None)]
    assert sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect()), key=str) == brute_trie(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_numbered_over_ranges(spark):
    """Turns of a conversation that lies in many ranges are numbered through."""
    rows = [(7, t, "user", str(t), "", 0) for t in range(500)] + [(c, 0, "user", "x", "", 0) for c in (6, 8)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.numbered(spark.createDataFrame(rows, TURNS)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(r["pos"] for r in got if r["conv"] == 7) == list(range(1, 501))
    assert sorted((r["conv"], r["pos"]) for r in got if r["conv"] != 7) == [(6, 1), (8, 1)]


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    hex = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hex[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return len(units), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def test_fill_middle(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab é日𝄞 \n\t\x0b<PSM>") for _ in range(r.choice([1, 2, 7, 60, 900]))) for _ in range(150)]
    texts += ["", None, " ", "\n\n", "a", " a ", "x<P>y", "no <S>", "<M", "<P" * 40, "word " * 300_000, "w" * 1_000_000]
    rows = [(i, t, "own", 1, "z") for i, t in enumerate(texts)] + [(3, texts[3], "own", 1, "z"), (3, "other words here", "own", 1, "z"), (None, "some words without an id", "own", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Form string, fim_workP int, lang string").repartition(3)
    got = fill_middle.transform(docs)
    assert got.columns == ["doc_id", "text", "fim_workP", "lang", "n_units", "form", "prefix_chars", "middle_chars", "output"]
    got = got.withColumn("back", fill_middle.restored()).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x["n_units"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]) == brute_fim(x["doc_id"], x["text"])
        assert x["back"] == (x["text"] or "")
    assert {x["form"] for x in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_skip_list_reaches_every_rank():
    r = np.random.default_rng(2)
    units = np.array([0, 1, 5, 2000, 0, 37])
    chars = r.integers(1, 9, units.sum())
    lanes = fill_middle.SkipList(units, chars)
    assert len(lanes.lanes) > 2
    first = np.concatenate([[0], np.cumsum(units)])
    for t, n in enumerate(units.tolist()):
        got, passed = lanes.descend(np.full(n + 1, t), np.arange(n + 1))
        assert got.tolist() == list(range(n + 1))
        assert passed.tolist() == np.concatenate([[0], np.cumsum(chars[first[t] : first[t + 1]])]).tolist()


def test_language_gradients():
    r = np.random.default_rng(0)
    buf = np.frombuffer("hello été ja nein da averylongwordthatfillsawindow".encode(), np.uint8)
    begin, stop, _ = language.spans(buf, np.array([0, len(buf)]))
    order = np.argsort(begin - stop, kind="stable")
    wins, y = language.windows(buf, begin[order], stop[order]), r.integers(0, 3, len(order))
    net = language.started(["a", "b", "c"], hidden=5)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}

    def loss():
        (f, b), _ = net.states(wins)
        t, i = np.nonzero(wins.letter)
        return -np.log(language.softmax(f[t, i] @ net.w["Cf"] + b[t, i] @ net.w["Cb"] + net.w["c"])[np.arange(len(t)), y[i]]).mean()

    grad = net.step(wins, y)
    for k, v in net.w.items():
        for _ in range(4):
            i = tuple(int(r.integers(0, n)) for n in v.shape) if k[0] != "W" else (int(r.choice(buf)), int(r.integers(0, v.shape[1])))
            v[i] += 0.02
            up = loss()
            v[i] -= 0.04
            down = loss()
            v[i] += 0.02
            assert grad[k][i] == pytest.approx((up - down) / 0.04, rel=0.02, abs=2e-5), k


def test_language_windows():
    """Windows hold each letter once; what is kept of earlier pieces changes nothing."""
    texts = ["Hello, wörld 123 -- " + "x" * 60, "", None, "42 !", "é"]
    buf, at = X.utf8(pa.array(texts, pa.string()))
    begin, stop, doc = language.spans(buf, at)
    assert doc.tolist() == [0, 0, 0, 0, 0, 4] and (stop - begin).max() <= language.WINDOW
    net = language.started(["a", "b"])
    seen = language.Seen(net)
    fresh = net.labels(buf, begin, stop)
    for _ in range(3):
        assert np.allclose(seen.labels(buf, begin, stop), fresh, atol=1e-5)
    assert np.allclose(fresh.sum(1), [language.LETTERS[buf[i:j]].sum() for i, j in zip(begin, stop)], atol=1e-3)
    seen.limit = 2
    assert np.allclose(seen.labels(buf, begin, stop), fresh, atol=1e-5) and len(seen.hash) <= 5


def test_language(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    net = language.fit(docs)
    assert net.langs == sorted(net.langs) and len(net.langs) == 4
    got = language.predict(docs, net).withColumn("out", language.held_out()).where(F.length("text") > 20).collect()
    for part in (True, False):
        own = [r for r in got if r["out"] is part]
        assert np.mean([r["lang_pred"] == r["lang"] for r in own]) > 0.93


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, "le chat noir est là" if i % 2 else "the black cat is there", "fr" if i % 2 else "en", 1) for i in range(40)], "doc_id long, text string, lang string, LANG_pred int")
    odd = spark.createDataFrame([(100, None, "fr", 1), (101, "", "en", 1), (102, "12 34 !?", "en", 1), (None, "the cat", None, 1), (104, "the cat " * 100_000, "en", 1), (104, "the cat", "en", 1), (105, "é", None, 1), (106, "x" * 5000, "en", 1)], docs.schema)
    net = language.fit(docs.unionByName(odd), steps=60)
    got = language.predict(odd, net)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = got.collect()
    by = {(r["doc_id"], len(r["text"] or "")): (r["lang_pred"], r["score"]) for r in rows}
    assert by[100, 0] == by[101, 0] == by[102, 8] == ("und", 0.0)
    assert by[104, 7] == (by[104, 800_000][0], pytest.approx(by[104, 800_000][1], abs=1e-4)) and by[104, 7][0] == "en"
    assert all(r["lang_pred"] in ("en", "fr", "und") and 0 <= r["score"] <= 1 for r in rows)
    none = language.fit(docs.where("lang = 'xx'"))
    assert {(r["lang_pred"], r["score"]) for r in language.predict(docs, none).collect()} == {("und", 0.0)}
    assert language.predict(docs.limit(0), net).count() == 0
