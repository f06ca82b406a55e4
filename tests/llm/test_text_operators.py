"""Language ID, decontamination, personal data: per-document operators."""

import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratamesh.llm import decontaminate, language, pii

from .cases import clashing, documents, empty, sentence


def labelled(spark):
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["kwik", "zwart", "kaas"]}
    rows = [(k, " ".join(words[lang][(k * j) % 3] for j in range(1, 30)), lang) for k, lang in enumerate(["aa", "bb"] * 20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_texts(spark):
    model = language.fit(labelled(spark))
    rows = [(1, "ipsum lorem dolor lorem"), (2, "kaas zwart kwik"), (3, None), (4, "12 !"), (5, "lorem ipsum dolor " * 20 + "zwart kaas kwik " * 8)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "score")
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    assert [got[k].lang_pred for k in range(1, 6)] == ["aa", "bb", "und", "und", "aa"]
    assert got[3].score == got[4].score == 0 and 0.5 < got[5].score < 0.95 and "bb" in got[5].languages


def test_language_without_training_rows_and_without_documents(spark):
    model = language.fit(empty(spark))
    assert {r.lang_pred for r in language.predict(documents(spark), model).collect()} == {"und"}
    assert language.predict(empty(spark), model).count() == 0


def test_held_out_accuracy(spark, data):
    found = language.op1_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97 and found.filter("score < 0 OR score > 1").count() == 0


def brute_hits(text, items, n=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = fold(text), set(), set()
    for item, t in items:
        w = fold(t)
        m = min(n, len(w))
        for i in range(len(w) - m + 1) if m else ():
            for j in range(len(words) - m + 1):
                if words[j : j + m] == w[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark):
    items = [(1, "the quick Brown fox"), (2, None), (3, ""), (4, " ".join(f"w{k}" for k in range(20))), (5, "the quick Brown fox"), (6, "x")]
    rows = [(1, "see The quick, brown FOX! " * 3), (2, None), (3, ""), (4, " ".join(f"w{k}" for k in range(3, 18))), (5, "w1 w2"), (6, "é x-y " * 400), (6, "é x-y " * 400)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "n_words", "items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.AUTOMATON_BYTES, 10):  # one automaton, and several
        got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.find(df, bench, most=most).orderBy("doc_id").collect()]
        assert got == [(i, *brute_hits(t, items)) for i, t in rows]
    assert decontaminate.find(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find(df.limit(0), bench).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4))
def test_scanner_matches_brute_force(seed, letters):
    rng = np.random.default_rng(seed)
    draw = lambda n: " ".join("abcdefgh"[k] for k in rng.integers(0, letters + 1, n))
    items = [(i, draw(int(rng.choice([1, 4, 5, 6, 12, 13, 14, 22, 40])))) for i in range(int(rng.integers(1, 6)))]
    text = " q ".join([draw(int(rng.integers(0, 60))), *(" ".join(t.split()[int(rng.integers(0, 4)) :]) for _, t in items)])
    n, hits, ids = decontaminate.scanner([(str(i), t) for i, t in items])(text)
    assert (n, sum(b - a for a, b in hits), sorted(ids)) == brute_hits(text, items)


def test_hits_map_to_the_original_text(spark):
    item = " ".join(f"w{k}" for k in range(15))
    text = "Ünï — (" + item.upper().replace(" ", ", ") + ")!  tail"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = decontaminate.find(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    ((a, b),) = row.spans
    assert text[a:b] == item.upper().replace(" ", ", ") and row.hits == [[2, 17]]
    first, last = decontaminate.original_spans("Ab-é  12.")
    assert list(zip(first.tolist(), last.tolist())) == [(0, 2), (3, 4), (6, 8)]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a0.@+- 1(59)%é\n", max_size=60))
def test_base_spans_match_the_patterns(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    want = [(0, *m.span()) for m in EMAIL.finditer(text)]
    want += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    want += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    want += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    assert pii.base_spans(text) == want


def test_personal_data_of_documents(spark):
    model = pii.model_of(documents(spark))
    found = pii.find(clashing(documents(spark), "spans"), model)
    rows = {r.doc_id: r for r in found.collect()}
    assert [s.kind for s in rows[14].base] == [0, 1, 2, 3] and len(rows[14].spans) >= 4 and rows[5].base == [] and rows[6].spans == []
    assert found.count() == documents(spark).count() and pii.find(empty(spark), pii.model_of(empty(spark))).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(documents(spark), model).collect()}
    assert clean[14] == "mail <EMAIL> or call <PHONE>, card <CARD>, ip <IP>." and clean[5] is None and clean[15] == "12345 !!! ???"


def test_repeated_card_number_without_a_base_span_is_carried_over():
    card = "4845168114407329"
    model = pii.train([(f"nr {card} x", pii.mentions(f"nr {card} x", pii.base_spans(f"nr {card} x")))] * 40)
    text = f"first {card} seen, later 1111111111111 {card} again"
    base, all_ = pii.spans(text, model)
    assert len(base) == 1 and len(all_) == 2 and text[all_[1][1] : all_[1][2]] == card


def test_propagation_matches_enumeration_on_a_tree():
    rng = np.random.default_rng(0)
    node, pair = rng.normal(size=(3, 5)), rng.normal(size=(3, 5, 5))
    edges = np.array([[0, 1, 0], [1, 2, 1]])
    total = np.zeros((3, 5))
    for a in range(5):
        for b in range(5):
            for c in range(5):
                p = np.exp(node[0, a] + node[1, b] + node[2, c] + pair[0, a, b] + pair[1, b, c])
                total[0, a] += p
                total[1, b] += p
                total[2, c] += p
    assert pii.propagate(node, edges, pair, rounds=40) == pytest.approx(total / total.sum(axis=1, keepdims=True), abs=1e-6)


def test_query_columns(spark, data):
    rows = pii.op9_pii(spark, data).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert all(r.n_spans == len(r.spans.split(",") if r.spans else []) >= r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows)
    assert all((r.base_sha256 == none) == (r.n_email + r.n_ip + r.n_card + r.n_phone == 0) for r in rows)


def test_labels_reach_the_end_of_a_long_chain():
    node, pair = np.zeros((30, 2)), np.array([[[3.0, 0.0], [0.0, 3.0]]])
    node[0, 1] = 30
    edges = np.array([(i, i + 1, 0) for i in range(29)])
    step = np.exp(pair[0]) / np.exp(pair[0]).sum(axis=1, keepdims=True)
    want = [np.linalg.matrix_power(step, i)[1, 1] for i in range(30)]  # a chain has exact marginals
    assert pii.propagate(node, edges, pair)[:, 1] == pytest.approx(want, abs=1e-6)


def test_training_takes_whole_documents(spark, monkeypatch):
    rows = [(k, " ".join(f"call 0171 55{k}{j:02d}77 now" for j in range(10))) for k in range(6)]
    taken = []
    monkeypatch.setattr(pii, "train", lambda docs: taken.append([len(nodes) for _, nodes in docs]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pii.model_of(df, most_mentions=10**6)
    pii.model_of(df, most_mentions=25)
    pii.model_of(df, most_mentions=1)
    assert taken == [[10] * 6, [10] * 2, [10]]


def test_numbers_given_again_without_their_prefix_are_found(spark, data):
    docs = spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    model = pii.model_of(docs)
    assert np.abs(model["pair"][1:]).sum(axis=(1, 2)).min() > 0.5  # repeated and similar mentions count
    found = planted = 0
    for k in range(60):
        number = f"555 7{k:03d}"
        text = f"{sentence(k, 8)} call +1 017 {number} {sentence(k + 99, 40)} again 1 017 {number} {sentence(k + 7, 5)}"
        at = text.rindex("1 017")
        planted += 1
        found += any(kind == 3 and a == at for kind, a, b in pii.spans(text, model)[1])
    assert found / planted >= 0.9


def test_very_long_runs_are_scanned_in_linear_time():
    model = pii.train([])
    began = time.perf_counter()
    for text in ("7" * 1_000_000, "1.2 " * 250_000, "+1 017 5550001 x " * 20_000):
        pii.spans(text, model)
    assert time.perf_counter() - began < 10
