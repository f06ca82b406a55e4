"""Deduplication, similarity joins, scoring, packing, media, sharding, URL rules."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratamesh.llm import jaccard, media, packing, pitman_yor, sharding, substrings, tokens, url_filter

from .cases import clashing, documents, empty, sentence, texts

# ----------------------------------------------------------------- substrings


def brute_removed(rows, length=100):
    """(id, text) -> (bytes, removed, spans, digest), judged on the input; equal rows share their fate."""
    seen, out = set(), {}
    key = lambda r: (r[0] is None, r[0] or 0)
    for i, t in sorted(set(rows), key=key):
        b, ranges = (t or "").encode(), []
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                if ranges and ranges[-1][1] >= p:
                    ranges[-1][1] = p + length
                else:
                    ranges.append([p, p + length])
            seen.add(s)
        kept = b"".join(b[x:y] for x, y in zip([0, *(y for _, y in ranges)], [*(x for x, _ in ranges), len(b)]))
        out[i, t] = (len(b), len(b) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("split, shards", [(8192, 16), (2, 16), (1, 1)])
def test_repeated_substrings_match_brute_force(spark, monkeypatch, split, shards):
    monkeypatch.setattr(substrings, "SHARD_CONTEXTS", split)
    monkeypatch.setattr(substrings, "PART_SHARDS", shards)
    line = sentence(9, 40)
    extra = [(20 + k, sentence(50 + k, 10) + line + sentence(70 + k, 10), "en", "s", 0) for k in range(8)] + [(40, "ab" * 300, "en", "s", 0), (41, "z" + "ab" * 100, "en", "s", 0)]
    df = documents(spark).unionByName(spark.createDataFrame(extra, documents(spark).schema))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute_removed(rows)
    got = substrings.deduplicate(clashing(df, "n_bytes", "id", "key")).collect()
    assert len(got) == len(rows)
    by_id = {i: want[i, t] for i, t in rows}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == by_id


def test_no_documents_no_substrings(spark):
    assert substrings.deduplicate(empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=200) | st.text(alphabet="ab", min_size=1, max_size=200).map(str.encode))
def test_suffix_array_and_prefixes(data):
    array = np.frombuffer(data, dtype=np.uint8)
    sa, rank = substrings.suffix_array(array)
    assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:]) and rank[sa].tolist() == list(range(len(data)))
    count = max(1, len(data) - 2)
    order, prefix = substrings.common_prefixes(array, sa, np.array([0]), np.array([count]), 100)
    for a, b, p in zip(order, order[1:], prefix[1:]):
        same = 0
        while same < 100 and max(a, b) + same < len(data) and data[a + same] == data[b + same]:
            same += 1
        assert p == same


def test_merge_of_sorted_runs():
    runs = [(np.array([x.encode("latin-1") for x in k], dtype="S3"), np.array(i), np.array(s)) for k, i, s in ((["abc", "b\0\0"], [3, 3], [0, 1]), (["abc", "az\xff"], [2, 9], [7, 7]), (["b\0\0"], [3], [0]))]
    keys, ids, starts = substrings.merge_runs(runs)
    assert (keys.tolist(), ids.tolist(), starts.tolist()) == ([b"abc", b"az\xff", b"b"], [2, 9, 3], [7, 7, 0])


# -------------------------------------------------------------------- jaccard


def shingles(text, n):
    w = tokens.folded(text).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (a and b and 100 * len(a & b) >= percent * len(a | b)) or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent", "texts_at_once"), [(3, 90, 6000), (5, 80, 6000), (3, 80, 1)])
def test_similar_sets_match_brute_force(spark, monkeypatch, n, percent, texts_at_once):
    monkeypatch.setattr(jaccard, "CLUSTER_TEXTS", texts_at_once)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    base = sentence(5, 100).split()
    chain = [(30 + k, " ".join(base[k * 2 : 60 + k * 2]), "en", "s", 0) for k in range(12)]  # each like the next, the ends unlike
    df = documents(spark).unionByName(spark.createDataFrame(chain, documents(spark).schema))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted((tuple(r) for r in jaccard.join(clashing(df, "key", "component_id"), n, percent).collect()), key=str)
    assert got == sorted(brute_components(rows, n, percent), key=str)


def test_one_of_each_group_stays(spark):
    kept = jaccard.keep_one(documents(spark), 5, 80)
    ids = Counter(r.doc_id for r in kept.collect())
    assert 1 in ids and not {2, 3, 13} & set(ids) and ids[11] == 2 and ids[5] == 1 and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert jaccard.join(empty(spark), 3, 90).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([80, 90]), st.integers(1, 400))
def test_similar_sets_share_a_signature_and_pass_the_sketches(seed, percent, size):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
    gone = int(rng.integers(0, 1 + max(0, len(a) * (100 - percent) // 100)))
    b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + gone))).astype(np.uint64)]))
    if len(b) and jaccard.linked(len(np.intersect1d(a, b)), len(a), len(b), percent):
        assert len(np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)))
        sets = pd.DataFrame({"id": [9, 5], "n": [len(b), len(a)], "sketch": [jaccard.sketch(b), jaccard.sketch(a)]})
        assert len(jaccard.near(pd.DataFrame({"signature": [1, 1], "id": [5, 9]}), sets, percent)) == 1


@pytest.mark.parametrize("table_bytes", [96_000_000, 400])
def test_links_within_a_cluster(monkeypatch, table_bytes):
    monkeypatch.setattr(jaccard, "TABLE_BYTES", table_bytes)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 39, 60)
    sets = [np.unique(np.concatenate([base[rng.random(60) > 0.04], rng.integers(0, 1 << 39, 2)])).astype(np.uint64) for _ in range(30)]
    ids = rng.permutation(500)[:30].astype(np.int64)
    root = list(range(30))
    for _ in range(30):
        for i in range(30):
            for j in range(30):
                if jaccard.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 90):
                    root[i] = root[j] = min(root[i], root[j])
    assert jaccard.link_cluster(ids, sets, 90).tolist() == [min(ids[j] for j in range(30) if root[j] == root[i]) for i in range(30)]


# --------------------------------------------------------------- language model


def test_scores_match_brute_force_base(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 3000)
    df = documents(spark).withColumn("held", F.coalesce(F.col("doc_id"), F.lit(0)) % 4 == 1)
    rows = [(r.doc_id, r.text, r.held) for r in df.collect()]
    words = lambda t: [*tokens.folded(t).split(), None]
    counts = Counter(w for _, t, h in rows if not h for w in words(t))
    total, types = sum(counts.values()), len(counts)
    got = pitman_yor.score(clashing(df, "score"), "held").collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, h in rows:
        w = words(t)
        want[i] = (h, len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w))
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4]) and r.score < 0


def test_model_probabilities_add_up_and_beat_the_base(spark, data):
    rows = pitman_yor.op4_pitman_yor(spark, data).toPandas()
    held = rows[rows.held_out]
    assert len(held) and held.score.sum() > held.base_score.sum()


def test_rare_contexts_have_restaurants(spark, monkeypatch):
    filler = " ".join(f"w{k}" for k in range(2000))
    rows = [(1, filler, False), (2, "left right other", False), (3, "left right", False), (4, "other apart", False), (5, "left right", True), (6, "left other", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in pitman_yor.score(df, "held").collect()}
    assert got[5] > got[6] + 0.5  # "right" and "other" are as frequent, but only one was seen after "left"
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 10)
    assert {r.doc_id: r.score for r in pitman_yor.score(df, "held").collect()} == pytest.approx(got, rel=1e-6)


def test_scores_of_single_pairs_are_exact(spark):
    df = spark.createDataFrame([(1, "a b c d", False), (2, "b z", True)], "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in pitman_yor.score(df, "held").collect()}
    d = 0.95  # all counts are one
    new = (1 + d * 5) / 6 / 6
    p = (1 - d + (1 + d * 5) / 6) / 6
    met, unmet = (1 - d + (1 + d) * p) / 2, (1 + d) / 2
    assert got[1] == pytest.approx(5 * math.log10(met), rel=1e-5)
    assert got[2] == pytest.approx(math.log10(unmet * p) + math.log10(unmet * new) + math.log10(p), rel=1e-5)  # after "z" the parent's


def test_probabilities_of_every_context_sum_to_one_and_make_the_score(spark):
    texts = ["a b a b c", "a b c a", "b a b", "c c a b d", "a b", "d a b a"]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(50, "a b c d a", True), (51, "b q a", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    made = pitman_yor.materialise(pitman_yor.blocks(df.withColumnRenamed("doc_id", "row"), "row", "text", "held"))
    fixed, states, state, known, _ = pitman_yor.train(made, 4)
    kept = {(r.kind, r.bucket): r for r in state.filter("kind NOT LIKE 'asked%'").collect()}
    last, d = states[pitman_yor.BURN + 1 :], fixed["discounts"][1]
    words = [*"abcdq", None]
    code = {w: tokens.word_hashes([w.encode()])[0][0] if w else pitman_yor.END for w in words}
    count, parent, inner, own = {}, {}, {}, {}
    lists = {b: np.sort(np.array([h for h in code.values() if int(h) >> 62 == b], dtype=np.uint64)) for b in range(4)}  # every token is in one block here
    repeated = {r.bucket: np.cumsum(tokens.unpack(r.data, r.n, np.uint64, np.uint64)[0]) for r in known.filter("kind = 'pairs'").collect()}
    for (kind, b), r in kept.items():
        if kind == "base":
            c = tokens.unpack(r.data, r.n, *[np.uint64] * 3)[0]
            got = tokens.unpack(kept["words", b].data, r.n, *[np.uint64] * (1 + 3 * len(last)))[1:]
            assert r.n == len(lists[b])
            for i, h in enumerate(lists[b]):
                count[h] = int(c[i])
                for k, s in enumerate(last):
                    parent[h, k] = pitman_yor.predict(got[3 * k + 1][i : i + 1].astype(float), got[3 * k + 2][i : i + 1].astype(float), s, fixed)[0]
                    inner[h, k] = int(got[3 * k][i])
        if kind == "seats":
            n, _, tables = tokens.unpack(r.data, r.n, np.uint32, np.uint32, np.uint64, np.uint64, np.uint64)[2:]
            own |= dict(zip(repeated[b], n - d * tables / len(last)))
    pairs = Counter((u, w) for t in texts for u, w in zip([None, *t.split()], [*t.split(), None]))
    fresh = [pitman_yor.predict(np.zeros(1), np.zeros(1), s, fixed)[0] for s in last]

    def p(w, u):
        mine = own[pitman_yor.pair_of(np.array([code[w]]), np.array([code[u]]))[0]] if pairs[u, w] > 1 else (1 - d) * pairs[u, w]
        c, n = code[u], len(last)
        return (mine + sum((1 + d * inner.get((c, k), 0)) * parent.get((code[w], k), fresh[k]) for k in range(n)) / n) / (1 + count.get(c, 0))

    for u in words:  # "q" was never seen: it stands for what is new
        assert sum(p(w, u) for w in words) == pytest.approx(1)
    for r in pitman_yor.score(df, "held").collect():
        t = dict((i, t) for i, t, _ in rows)[r.doc_id].split()
        assert r.score == pytest.approx(sum(math.log10(p(w, u)) for u, w in zip([None, *t], [*t, None])), rel=1e-5)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))


def test_parent_probabilities_sum_to_one():
    customers, tables = np.array([5.0, 2.0, 1.0]), np.array([2.0, 1.0, 1.0])
    state, fixed = {"parent_tables": 4.0, "parent_customers": 8.0}, {"types": 3, "discounts": [0.5, 0.5]}
    new = pitman_yor.predict(np.zeros(1), np.zeros(1), state, fixed)[0]
    assert pitman_yor.predict(customers, tables, state, fixed).sum() + new == pytest.approx(1)


def test_seating_matches_the_expected_number_of_tables():
    rng = np.random.default_rng(1)
    n = np.full(20_000, 3)
    tables = pitman_yor.seat(n, np.full(len(n), 0.7), 0.4, rng)
    second = 0.7 / (0.7 + 1 - 0.4)
    third = second * 0.7 / (0.7 + 2 - 0.8) + (1 - second) * 0.7 / (0.7 + 2 - 0.4)
    assert tables.min() >= 1 and tables.max() <= 3 and tables.mean() == pytest.approx(1 + second + third, abs=0.02)
    assert pitman_yor.seat(np.array([0, 1, 10**6]), np.full(3, 0.5), 0.5, rng)[:2].tolist() == [0, 1]


def test_scoring_without_rows_or_training(spark):
    assert pitman_yor.score(empty(spark).withColumn("held", F.lit(True)), "held").count() == 0
    alone = pitman_yor.score(documents(spark).withColumn("held", F.lit(True)), "held").collect()
    assert {r.n_known for r in alone} == {0} and {r.train_tokens for r in alone} == {0}


# -------------------------------------------------------------------- packing


def test_packing_is_whole(spark):
    df = clashing(documents(spark), "piece", "length")
    rows = packing.pack(df).toPandas()
    encode = packing.encoder()
    want = Counter()
    for i, t, *_ in texts():
        ids = np.frombuffer(encode(t), dtype="<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples())
    assert got == want and rows.length.max() == 4096
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096
    assert rows.sequence_id.nunique() == -(-rows.length.sum() // 4096)
    assert packing.pack(empty(spark)).count() == 0


def test_hot_lengths_are_ranked_in_more_parts(spark):
    made = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 5 == 0, F.col("id") % 4000 + 1).otherwise(700).cast("long").alias("length"))
    sums = []
    for part_rows in (10**6, 7):  # of the 2400 of one length, 64 and 343 parts
        rows = packing.place(made, part_rows=part_rows).toPandas()
        assert sorted(rows.doc_id) == list(range(3000)) and rows.length.sum() <= 4096 * rows.sequence_id.nunique()
        for _, s in rows.sort_values("offset").groupby("sequence_id"):
            assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096
        sums.append(rows.sequence_id.nunique())
    assert sums[0] == sums[1]


def test_encoder_agrees_with_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    own, encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), packing.encoder()
    for t in ["It's 3.5 o'clock...", "ÄÖ́ ΣΑΣ ς", "a.b,, c.\n\tD e", "x" * 300, "", "<|endoftext|> 'll", "١٢ 漢字。", "end1. 9, é,"]:
        assert np.frombuffer(encode(t), dtype="<u4").tolist() == [*own.encode(t, add_special_tokens=False).ids, 1]


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.integers(1, 4096), st.integers(1, 30), max_size=40))
def test_plans_cover_the_histogram(histogram):
    groups = packing.plan(histogram, rounds=60)
    used = Counter()
    for lengths, n in groups:
        assert sum(lengths) <= 4096
        for x in lengths:
            used[x] += n
    assert used == Counter(histogram)
    assert sum(n for _, n in groups) <= 1 + 11 / 9 * max(1, -(-sum(k * v for k, v in histogram.items()) // 4096)) + sum(v for k, v in histogram.items() if k > 1365)


@pytest.mark.parametrize("seed", [0, 1])
def test_the_program_packs_most_and_packs_tight(seed):
    rng = np.random.default_rng(seed)
    lengths, n = np.unique(np.minimum(4096, rng.lognormal(6.3, 0.9, 4000).astype(int) + 1), return_counts=True)
    histogram = dict(zip(lengths.tolist(), n.tolist()))
    total = int((lengths * n).sum())
    made = list(packing.programmed(packing._Stock(histogram, 4096)))
    assert sum(sum(x) * k for x, k in made) >= 0.8 * total
    assert sum(k for _, k in packing.plan(histogram)) <= 1.005 * total / 4096 + 1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aTİıIς Σσß’‘“”.,!\n漢1é\u0307K", max_size=40))
def test_encoder_agrees_with_the_tokenizer_on_odd_letters(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids + [packing.END_ID]
    assert np.frombuffer(packing.encoder()(text), dtype="<u4").tolist() == whole


def test_pricing_finds_the_best_filling():
    value = np.array([0, 1.0, 0, 5.0, 0, 8.5])
    count = packing.price(value)
    assert count @ np.arange(6) <= 5 and count @ value == 8.5
    assert (packing.price(np.array([0, 1.0, 3.0, 0, 0, 7.4])) @ np.array([0, 1.0, 3.0, 0, 0, 7.4])) == pytest.approx(7.4)


# ---------------------------------------------------------------------- media


def test_media_round_trip(spark):
    rows = {r.doc_id: r for r in media.media_columns(clashing(documents(spark), "feature", "n_bytes").drop("lang")).collect()}
    for i, t, *_ in texts():
        if i is None:
            continue
        data = (t or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        stored = media.encode_media(data)
        assert media.decode_media(stored) == payload
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.features(payload))
    assert media.media_columns(empty(spark)).count() == 0 and media.media_columns(documents(spark)).count() == len(texts())


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200_000))
def test_cuts_follow_contents(seed, size):
    data = np.random.default_rng(seed).integers(0, 256, size, dtype=np.uint8).tobytes()
    gear = media.gear_table()
    ends = media.cuts(data, gear)
    sizes = np.diff([0, *ends])
    assert ends[-1] == size and (sizes[:-1] >= media.LEAST).all() and sizes.max() <= media.MOST
    shifted = {e - 7 for e in media.cuts(b"1234567" + data, gear)}
    if len(ends) > 20:
        assert len(shifted & set(ends)) > len(ends) // 2


def test_a_damaged_chunk_is_noticed(spark):
    made = media.chunks(documents(spark).select(F.lit("k").cast("binary").alias("k"), "text").filter("doc_id = 12"), "k")
    store = made.select("digest", "size", F.lit(b"\x28\xb5\x2f\xfd\x00\x58\x01\x00\x00").alias("data"))
    with pytest.raises(Exception, match="."):
        media.read_back(made.select("key", "ordinal", "parts", "digest"), store).collect()


# ------------------------------------------------------------------- sharding


@pytest.mark.parametrize("most,many", [(10**9, 1000), (5000, 60), (2000, 20)])
def test_members_of_signatures_meet_in_bounded_memory(most, many):
    rng = np.random.default_rng(1)
    sets = [np.append(np.unique(rng.integers(0, 3000, 200).astype(np.uint64)) * np.uint64(6148914691236517), np.uint64(5)) for _ in range(300)]
    ids = rng.permutation(10_000)[:300].astype(np.int64)
    dealt = pd.concat([jaccard.packages(sets[a : a + 50], ids[a : a + 50], 4) for a in range(0, 300, 50)]).sort_values("bucket", kind="stable")
    holders = {}
    for i, s in zip(ids.tolist(), sets):
        for x in s.tolist():
            holders.setdefault(x, set()).add(i)
    rows = pd.concat(jaccard.shared_rows([dealt], most, many)).drop_duplicates()
    assert {frozenset(g) for _, g in rows.groupby("signature")["id"]} == {frozenset(v) for v in holders.values() if len(v) > 1}


def test_different_texts_of_one_id_are_linked(spark):
    a, b, c = sentence(31, 60), sentence(32, 60), sentence(33, 60)
    df = spark.createDataFrame([(1, c), (5, a), (5, b), (3, b), (9, a + " more")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in jaccard.join(df, 3, 90).collect())
    assert got == [(1, 1), (3, 3), (5, 3), (5, 3), (9, 3)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 100))
def test_feistel_is_a_permutation(n, seed):
    assert sorted(sharding.feistel(np.arange(n), n, seed).tolist()) == list(range(n))


def test_shards_are_even_and_gapless(spark):
    rows = sharding.shard(documents(spark).select("doc_id", "text"), ["doc_id", "text"], 4).toPandas()
    assert len(rows) == len(texts())
    sizes = rows.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    for _, s in rows.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    again = sharding.shard(documents(spark).select("doc_id", "text").repartition(5), ["doc_id", "text"], 4).toPandas()
    key = lambda df: sorted(map(str, df.itertuples(index=False)))
    assert key(rows) == key(again)
    assert sharding.shard(empty(spark), ["doc_id"]).count() == 0


# ------------------------------------------------------------------------ URLs


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7?x", "http://example.com/en/8", "http://com/en/", "http://xcom/en/", "https://a.b.example.net/de/8#f", "ftp://e.net/de/", "http://e.org?/es/", "http://e.org/es/", "http://e.org/ES/", "http://e.org/es/"]
    df = clashing(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "rule", "host")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[4][2:] == ("com/en/", "block") and got[5][3] == "block"
    assert got[6][2:] == (None, "allow") and got[7][2:] == ("example.net/de/8", "block") and got[8][2:] == ("net/de/", "allow")
    assert got[9][1:] == ("", None, "allow") and got[10] == got[12] and got[10][3] == "block" and got[11][3] == "allow" and len(got) == len(urls)
    assert url_filter.judge(df, rules.limit(0)).filter("verdict <> 'allow'").count() == 0 and url_filter.judge(df.limit(0), rules).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/p").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit("/page")).alias("url"))
    assert {r.page_id for r in url_filter.judge(pages, listed).filter("verdict = 'block'").collect()} == set(range(2000))
