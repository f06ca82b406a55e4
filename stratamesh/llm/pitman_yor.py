"""Language-model scoring with a hierarchical Pitman-Yor model.

Every training token is a context with a restaurant of its own; they share a parent
restaurant over a uniform base. The tables of the context restaurants are the
parent's customers. After a token that training has not seen the model is the parent. Gibbs sweeps reseat
the customers of each dish given all other tables (in the manner of the Chinese
restaurant, customers of a dish in growing groups once there are many), and the
predictive probabilities of the sweeps after the first ones are averaged.

Texts are held in blocks. Pairs of a token and its context are dealt to buckets by the pair's hash,
and tokens by their own, so no common word gathers its pairs in one task. Each block sends the hashes of its
pairs and learns of each whether training has it never, once or more often, and whether this block is the one to speak for it. A pair seen
once has one table for good and needs no more; for the others the block that speaks for it names the context. Buckets then exchange sums between
sweeps: a pair's bucket sends what it added to its tokens and contexts, and
gets their sums back. A token is a context as often as it occurs, since each text ends
with a token that also stands before the first word. Only sums over all tokens pass
through the driver. At last each block gets the values of its repeated pairs and its tokens and adds up its texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold_id, materialise, table, trim
from .tokens import folded, mix, pack, steps, unmix, unpack, word_hashes

END = np.uint64(0x1E17D0)
SWEEPS, BURN = 4, 2
THETA = 1.0
SEED = 17
BLOCK_BYTES, BUCKET_BYTES = 4_000_000, 12_000_000
_PAIR = np.uint64(0xA24BAED4963EE407)
#: Answers on a pair: never, once or more often in training; and the mark of the block that speaks for it.
NEVER, ONCE, OFTEN, SPEAKS = 0, 1, 2, 4
#: Rows that buckets get: state or a message from bucket (or block) ``source`` of ``n`` packed items. Rows to a block have bucket and source exchanged.
ROW = "bucket int, kind string, source long, n long, data binary, a double, b double"


def blocks(docs: DataFrame, doc_id: str, text: str, held: str) -> DataFrame:
    """Texts in blocks of about BLOCK_BYTES: row numbers, held-out flags, sizes and all bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)

        def block() -> pd.DataFrame:
            ids = np.array([i for i, *_ in own], dtype=np.int64)
            flags = np.array([h for _, h, _ in own], dtype=np.uint8)
            sizes = np.array([len(b) for *_, b in own], dtype=np.int64)
            name = zlib.crc32(ids.tobytes()) << 31 ^ zlib.crc32(sizes.tobytes())
            return pd.DataFrame([(name, ids.tobytes(), flags.tobytes(), sizes.tobytes(), press.compress(b"".join(b for *_, b in own)), size)], columns=["block", "ids", "held", "sizes", "data", "bytes"])

        own, size = [], 0
        for frame in frames:
            for i, h, t in zip(frame["row"], frame["held"], frame["text"]):
                own.append((i, h, folded(t)))
                size += len(own[-1][2])
                if size >= BLOCK_BYTES:
                    yield block()
                    own, size = [], 0
        if own:
            yield block()

    rows = docs.select(F.col(doc_id).alias("row"), F.col(held).alias("held"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "block long, ids binary, held binary, sizes binary, data binary, bytes long")


def tokens(sizes: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts of a block, ends included, and the number of tokens of each text."""
    ends = np.cumsum(sizes)
    words, counts = [], []
    a = 0
    while a < len(sizes):  # some megabytes at a time
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + 1_000_000)))
        hashed, first = word_hashes([data[e - s : e] for s, e in zip(sizes[a:b].tolist(), ends[a:b].tolist())])
        words.append(np.insert(hashed, first[1:], END))
        counts.append(np.diff(first) + 1)
        a = b
    return np.concatenate(words), np.concatenate(counts)


def open_block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, tokens of each text, row numbers, held-out flags) of a row of ``blocks``."""
    import zstandard

    sizes = np.frombuffer(row.sizes, dtype=np.int64)
    found, counts = tokens(sizes, zstandard.ZstdDecompressor().decompress(row.data, max_output_size=max(1, int(sizes.sum()))))
    return found, counts, np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.held, dtype=np.uint8).astype(bool)


def pair_of(token: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(token ^ (context * _PAIR))


def token_of(pair: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The token of a pair, its context being known."""
    return unmix(pair) ^ (context * _PAIR)


def bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets, which are ranges, begin and end in sorted hashes."""
    return np.searchsorted((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def to_buckets(kind: str, source: int, buckets: int, hashes: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """Rows with sorted ``hashes`` and what belongs to each."""
    bound = bounds(hashes, buckets)
    cut = [(b, slice(bound[b], bound[b + 1])) for b in range(buckets) if bound[b] < bound[b + 1]]
    return [(b, kind, source, at.stop - at.start, pack(steps(hashes[at]), *(v[at] for v in values))) for b, at in cut]


def before(found: np.ndarray) -> np.ndarray:
    """The context of each token of a sequence of texts with their ends."""
    return np.concatenate([found[-1:], found[:-1]])  # the last one is an end


def pairs_in(found: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs in order, the place of one of each, how often each stands where ``own``, and which pair each token is."""
    pair, where, which = np.unique(pair_of(found, before(found)), return_index=True, return_inverse=True)
    return pair, where, np.bincount(which[own], minlength=len(pair)).astype(np.uint32), which


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(*r, 0.0, 0.0)[:7] for r in rows], columns=["bucket", "kind", "source", "n", "data", "a", "b"])


def of_kind(frame: pd.DataFrame, kind: str) -> list:
    return list(frame[frame["kind"] == kind].sort_values("source").itertuples(index=False))


def met(made: DataFrame, buckets: int) -> DataFrame:
    """What buckets know of pairs; rows as in ROW.

    reply: for each block, in the order of its pairs, how often training has them, and whether the block speaks
    for them. asked: where those of a block that are seen more than once stand in the bucket's list. pairs: those seen more than once, with their counts; a and b are the numbers of those seen once and twice.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                found, counts, _, held = open_block(row)
                pair, _, n, _ = pairs_in(found, ~np.repeat(held, counts))
                yield frame_of(to_buckets("ask", row.block, buckets, pair, n))
        trim()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        b, asks = int(frame["bucket"].iloc[0]), of_kind(frame, "ask")
        parts = [unpack(r.data, r.n, np.uint64, np.uint32) for r in asks]
        pair, n = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
        del parts
        order = np.argsort(pair, kind="stable")
        new = np.concatenate([[True], pair[order][1:] != pair[order][:-1]])
        first = np.flatnonzero(new)
        total = np.add.reduceat(n[order].astype(np.uint64), first)
        which = np.empty(len(pair), dtype=np.uint32)
        which[order] = np.cumsum(new) - 1
        code = np.minimum(total, OFTEN).astype(np.uint8)[which]
        learned = np.flatnonzero(n > 0)
        speaker = np.full(len(first), len(pair))
        np.minimum.at(speaker, which[learned], learned)
        code[speaker[total > 0]] += SPEAKS
        often = total >= OFTEN
        place = (np.cumsum(often) - 1).astype(np.uint32)
        out, a = [], 0
        for r in asks:
            own = code[a : a + r.n]
            at = place[which[a : a + r.n][own & 3 == OFTEN]]
            out += [(b, "reply", r.source, r.n, pack(own)), (b, "asked", r.source, len(at), pack(steps(at)))]
            a += r.n
        out.append((b, "pairs", b, int(often.sum()), pack(steps(pair[order][first][often]), total[often]), float((total == 1).sum()), float((total == 2).sum())))
        del frame, pair, n, order, which
        trim()
        return frame_of(out)

    return made.mapInPandas(ask, ROW).groupBy("bucket").applyInPandas(merge, ROW)


def replies(given: pd.DataFrame, kind: str, n: int, *kinds) -> list[np.ndarray]:
    """The values that buckets gave for ``n`` sorted hashes of a block."""
    rows = given[given["kind"] == kind].sort_values("bucket")
    if int(rows["n"].sum()) != n:
        raise ValueError("a bucket gave no answer")
    parts = [unpack(d, m, *kinds) for d, m in zip(rows["data"], rows["n"].tolist())]
    return [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, dtype=t) for k, t in enumerate(kinds)]


def told(made: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """What blocks tell once they know their pairs; rows as in ROW.

    sums: all tokens of the block with their training count, and the different contexts and successors in the pairs
    for which the block speaks. names: such pairs seen more often than once, with their contexts.
    """

    def run(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in own.itertuples(index=False):
            found, counts, _, held = open_block(row)
            learned = ~np.repeat(held, counts)
            pair, where, _, which = pairs_in(found, learned)
            del which
            (code,) = replies(given, "reply", len(pair), np.uint8)
            often = code & 3 == OFTEN
            speaks = code >= SPEAKS
            context = before(found)[where]
            out += to_buckets("names", row.block, buckets, pair[often & speaks], context[often & speaks])
            word, at = np.unique(found, return_inverse=True)
            told_of = (at[learned], at[where[speaks]], before(at)[where[speaks]])
            out += to_buckets("sums", row.block, buckets, word, *(np.bincount(x, minlength=len(word)).astype(np.uint32) for x in told_of))
        trim()
        return frame_of(out)

    mine = known.filter("kind = 'reply'").withColumnRenamed("source", "block")
    return made.groupBy("block").cogroup(mine.groupBy("block")).applyInPandas(run, ROW)


def seats_of(known: DataFrame, said: DataFrame, buckets: int) -> DataFrame:
    """The pairs seen more than once and the tokens in them; rows as in ROW.

    seats: places of token and context in the list of such tokens, customers, tables, and the sum of tables over samples. live: a part of that list.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        b = int(frame["bucket"].iloc[0])
        parts = [unpack(r.data, r.n, np.uint64, np.uint64) for r in of_kind(frame, "names")]
        pair, context = (np.concatenate(x) if parts else np.empty(0, dtype=np.uint64) for x in (([np.cumsum(p[0]) for p in parts]), ([p[1] for p in parts])))
        order = np.argsort(pair)
        pair, context = pair[order], context[order]
        (row,) = of_kind(frame, "pairs")
        known_, n = unpack(row.data, row.n, np.uint64, np.uint64)
        if not np.array_equal(pair, np.cumsum(known_)):
            raise ValueError("a pair has no name")
        word, at = np.unique(np.concatenate([token_of(pair, context), context]), return_inverse=True)
        m, at = len(pair), at.astype(np.uint32)
        out = [(b, "seats", b, m, pack(at[:m], at[m:], n, np.ones(m, dtype=np.uint64), np.zeros(m, dtype=np.uint64)))]
        return frame_of(out + to_buckets("live", b, buckets, word))

    return known.filter("kind = 'pairs'").unionByName(said.filter("kind = 'names'")).groupBy("bucket").applyInPandas(run, ROW)


def words_of(said: DataFrame) -> DataFrame:
    """What buckets of tokens hold and first answer; rows as in ROW.

    base: counts, different contexts and successors of tokens, zero where only texts held out have them. words: tables in
    the parent and samples. order: the tokens that another bucket lists. reply: sums of those tokens. asked: where a block's
    tokens stand in the bucket's list.
    """

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        b = int(frame["bucket"].iloc[0])
        told_ = of_kind(frame, "sums")
        parts = [(np.cumsum(k), *v) for k, *v in (unpack(r.data, r.n, np.uint64, np.uint32, np.uint32, np.uint32) for r in told_)]
        all_ = np.concatenate([p[0] for p in parts])
        order = np.argsort(all_, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], all_[order][1:] != all_[order][:-1]]))
        word = all_[order][first]
        count, contexts, successors = (np.add.reduceat(np.concatenate([p[k] for p in parts])[order].astype(np.uint64), first) for k in (1, 2, 3))
        out = [
            (b, "base", b, len(word), pack(count, contexts, successors), float((contexts == 1).sum()), float((contexts == 2).sum())),
            (b, "words", b, len(word), pack((contexts > 0).astype(np.uint64)), float(contexts.sum()), float((contexts > 0).sum())),
            (b, "total", b, int((count > 0).sum()), b"", float(count.sum()), 0.0),
        ]
        out += [(b, "asked", r.source, r.n, pack(steps(np.searchsorted(word, p[0]).astype(np.uint32)))) for r, p in zip(told_, parts)]
        for r in of_kind(frame, "live"):
            at = np.searchsorted(word, np.cumsum(unpack(r.data, r.n, np.uint64)[0])).astype(np.uint32)
            out += [(b, "order", r.source, r.n, pack(steps(at))), (int(r.source), "reply", b, r.n, pack(successors[at], count[at], np.ones(len(at), dtype=np.uint64)))]
        return frame_of(out)

    return said.filter("kind IN ('sums', 'live')").groupBy("bucket").applyInPandas(gather, ROW)


def reseat(rows: DataFrame, fixed: dict, k: int, state: dict, burn: int) -> DataFrame:
    """Sweep ``k`` of the context restaurants: new seats, and what each adds to tokens beyond one table a pair."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        b, d = int(frame["bucket"].iloc[0]), fixed["discounts"][1]
        (row,) = of_kind(frame, "seats")
        token, context, n, tables, in_all = unpack(row.data, row.n, np.uint32, np.uint32, np.uint64, np.uint64, np.uint64)
        sums_ = of_kind(frame, "reply")
        if not sums_:
            return frame_of([(b, "seats", b, row.n, row.data)])
        inner, customers, parent = (np.concatenate(x).astype(np.float64) for x in zip(*(unpack(r.data, r.n, np.uint64, np.uint64, np.uint64) for r in sums_)))
        share = predict(customers, parent, state, fixed) if k else (customers + 0.5) / (fixed["tokens"] + 0.5 * (fixed["types"] + 1))
        others = np.maximum(inner[context] - tables, 0)
        tables = seat(n.astype(np.int64), (THETA + d * others) * share[token], d, np.random.default_rng([SEED, b, k, 0]))
        tables = tables.astype(np.uint64)
        if k >= burn:
            in_all = in_all + tables
        out = [(b, "seats", b, row.n, pack(token, context, n, tables, in_all))]
        more = [np.bincount(at, weights=tables.astype(np.float64) - 1, minlength=len(share)).astype(np.uint64) for at in (token, context)]
        a = 0
        for r in sums_:
            out.append((int(r.source), "more", b, r.n, pack(*(x[a : a + r.n] for x in more))))
            a += r.n
        return frame_of(out)

    return rows.groupBy("bucket").applyInPandas(run, ROW)


def reseat_parent(rows: DataFrame, fixed: dict, k: int, state: dict, burn: int) -> DataFrame:
    """Sweep ``k`` of the parent restaurant, and the sums that the next sweep of the others needs; seats pass through."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        b, d = int(frame["bucket"].iloc[0]), fixed["discounts"][0]
        out = [tuple(r) for r in of_kind(frame, "seats")]
        for base, row in zip(of_kind(frame, "base"), of_kind(frame, "words")):
            _, customers, inner = unpack(base.data, base.n, np.uint64, np.uint64, np.uint64)
            parent, *samples = unpack(row.data, row.n, *[np.uint64] * (1 + 3 * max(0, k - burn)))
            customers, inner, parent = customers.astype(np.int64), inner.astype(np.int64), parent.astype(np.int64)
            orders = [(int(r.source), np.cumsum(unpack(r.data, r.n, np.uint32)[0], dtype=np.uint32)) for r in of_kind(frame, "order")]
            more = {int(r.source): [x.astype(np.int64) for x in unpack(r.data, r.n, np.uint64, np.uint64)] for r in of_kind(frame, "more")}
            for source, at in orders:
                customers[at] += more[source][0]
                inner[at] += more[source][1]
            others = np.maximum(state["parent_tables"] - parent, 0)
            parent = seat(customers, (THETA + d * others) / (fixed["types"] + 1), d, np.random.default_rng([SEED, b, k, 1]))
            now = [x.astype(np.uint64) for x in (inner, customers, parent)]
            out.append((b, "words", b, row.n, pack(now[2], *samples, *(now if k >= burn else ())), float(customers.sum()), float(parent.sum())))
            out += [(source, "reply", b, len(at), pack(*(x[at] for x in now))) for source, at in orders]
        return frame_of(out)

    return rows.groupBy("bucket").applyInPandas(run, ROW)


def seat(n: np.ndarray, urge: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its ``n`` customers have been seated; ``urge``: weight of a new table.

    The first few customers sit down one by one, later ones in groups of an eighth of those seated.
    """
    tables = (n > 0).astype(np.float64)
    i, open_ = 1, np.flatnonzero(n > 1)
    while len(open_):
        group = max(1, i // 8)
        new = urge[open_] / (urge[open_] + np.maximum(i - discount * tables[open_], 1e-9))
        tables[open_] += rng.binomial(np.minimum(group, n[open_] - i), new)
        i += group
        open_ = open_[n[open_] > i]
    return tables


def predict(customers: np.ndarray, tables: np.ndarray, state: dict, fixed: dict) -> np.ndarray:
    """Parent probabilities of tokens with so many customers and tables."""
    d = fixed["discounts"][0]
    return (np.maximum(customers - d * tables, 0) + (THETA + d * state["parent_tables"]) / (fixed["types"] + 1)) / (THETA + state["parent_customers"])


def sums(rows: DataFrame, kind: str) -> tuple[float, float, int]:
    """Sums of a, b and n over rows of a kind."""
    a, b, n = rows.filter(F.col("kind") == kind).agg(F.sum("a"), F.sum("b"), F.sum("n")).first()
    return a or 0.0, b or 0.0, int(n or 0)


def train(made: DataFrame, buckets: int, sweeps: int = SWEEPS, burn: int = BURN) -> tuple[dict, list[dict], DataFrame, DataFrame, list[DataFrame]]:
    """What holds throughout, the parent's sums before each sweep and after the last, what ``answer`` needs, what is known of pairs, and the tables to discard."""
    known = materialise(met(made, buckets))
    said = materialise(told(made, known, buckets))
    seats = materialise(seats_of(known, said, buckets))
    first = materialise(words_of(said.unionByName(seats)))
    once, twice, _ = sums(first, "base")
    pairs, (tokens_, _, types) = sums(known, "pairs"), sums(first, "total")
    fixed = {"tokens": int(tokens_), "types": types, "discounts": [float(np.clip(x / max(1, x + 2 * y), 0.1, 0.95)) for x, y in ((once, twice), pairs[:2])]}
    discard(said)
    states, rows = [], first.filter("kind IN ('words', 'reply')").unionByName(seats.filter("kind = 'seats'"))
    keep = lambda f, *kinds: f.filter(F.col("kind").isin(*kinds))
    current = first
    for k in range(sweeps):
        states.append(dict(zip(("parent_customers", "parent_tables"), sums(current, "words"))))
        seated = reseat(keep(rows, "seats", "reply"), fixed, k, states[k], burn)
        before_, rows = current, materialise(reseat_parent(seated.unionByName(keep(first, "base", "order")).unionByName(keep(rows, "words")), fixed, k, states[k], burn))
        current = rows
        discard(before_) if k else discard(seats)
    states.append(dict(zip(("parent_customers", "parent_tables"), sums(current, "words"))))
    state = keep(known, "asked").withColumn("kind", F.lit("asked pairs")).unionByName(keep(first, "asked", "base")).unionByName(keep(rows, "words", "seats"))
    return fixed, states, state, known, [first, *([current] if sweeps else [seats])]


def answer(rows: DataFrame, samples: int) -> DataFrame:
    """(block, kind, bucket, n, data): what blocks need of the buckets' state.

    of pairs: customers, and the sum of tables over samples. of words: training count, and in each
    sample the tables in the restaurant of that context, and customers and tables in the parent.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        b, out = int(frame["bucket"].iloc[0]), []
        for row in of_kind(frame, "seats"):
            _, _, n, _, tables = unpack(row.data, row.n, np.uint32, np.uint32, np.uint64, np.uint64, np.uint64)
            for r in of_kind(frame, "asked pairs"):
                at = np.cumsum(unpack(r.data, r.n, np.uint32)[0], dtype=np.uint32)
                out.append((r.source, "of pairs", b, r.n, pack(n[at], tables[at])))
        for base, row in zip(of_kind(frame, "base"), of_kind(frame, "words")):
            count = unpack(base.data, base.n, np.uint64, np.uint64, np.uint64)[0]
            values = [count, *unpack(row.data, row.n, *[np.uint64] * (1 + 3 * samples))[1:]]
            for r in of_kind(frame, "asked"):
                at = np.cumsum(unpack(r.data, r.n, np.uint32)[0], dtype=np.uint32)
                out.append((r.source, "of words", b, r.n, pack(*(v[at] for v in values))))
        trim()
        return pd.DataFrame(out, columns=["block", "kind", "bucket", "n", "data"])

    return rows.groupBy("bucket").applyInPandas(run, "block long, kind string, bucket int, n long, data binary")


def score(docs: DataFrame, held: str, doc_id: str = "doc_id", text: str = "text", sweeps: int = SWEEPS, burn: int = BURN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row of ``docs``.

    The model learns from the rows where column ``held`` is false. Null texts
    count as empty: their end is their one token. Repeated rows are learned from and
    scored as often as they stand. Without any training token all
    counts are zero, and base and model are uniform. An empty table gives an empty result.
    ``perplexity`` is that of a token: 10 to the power of -score / n_tokens.
    """
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    null = -(1 << 63)  # stands for a null id
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(null)).alias("row"), F.coalesce(F.col(held), F.lit(False)).alias("held"), F.col(text).alias("text"))
    made = materialise(blocks(rows, "row", "text", "held"))
    size = made.agg(F.sum("bytes")).first()[0]
    if size is None:
        return docs.sparkSession.createDataFrame([], kind + ", perplexity double")
    buckets = max(4, -(-size // BUCKET_BYTES))
    fixed, states, state, known, spent = train(made, buckets, sweeps, burn)
    last = states[burn + 1 :]
    answers = materialise(answer(state, len(last)))
    discard(*spent)
    scale = float(np.log10(fixed["tokens"] + 0.5 * (fixed["types"] + 1)))
    d = fixed["discounts"][1]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def add_up(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in own.itertuples(index=False):
            found, counts, ids, flags = open_block(row)
            pair, _, _, which = pairs_in(found, np.zeros(len(found), dtype=bool))
            (code,) = replies(given, "reply", len(pair), np.uint8)
            code &= 3
            inside = np.where(code == ONCE, 1 - d, 0.0)
            n, tables = replies(given, "of pairs", int((code == OFTEN).sum()), np.uint64, np.uint64)
            inside[code == OFTEN] = n - d * tables / len(last)
            p = inside[which]
            del pair, which, inside, code, n, tables
            word, at = np.unique(found, return_inverse=True)
            count, *values = replies(given, "of words", len(word), *[np.uint64] * (1 + 3 * len(last)))
            context = before(at)
            for k, state_ in enumerate(last):
                inner, customers, parent = (x.astype(np.float64) for x in values[3 * k : 3 * k + 3])
                p += predict(customers, parent, state_, fixed)[at] * (THETA + d * inner)[context] / len(last)
            p /= (THETA + count.astype(np.float64))[context]
            first = np.cumsum(counts) - counts
            base = np.add.reduceat(np.log10(count + 0.5)[at], first) - counts * scale
            out.append(pd.DataFrame({
                "doc_id": ids, "held_out": flags, "n_tokens": counts, "n_known": np.add.reduceat((count > 0)[at].astype(np.int64), first),
                "train_tokens": fixed["tokens"], "base_score": base, "score": np.add.reduceat(np.log10(p), first),
            }))
        trim()
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    mine = known.filter("kind = 'reply'").select(F.col("source").alias("block"), "kind", "bucket", "n", "data")
    found = made.groupBy("block").cogroup(answers.unionByName(mine).groupBy("block")).applyInPandas(add_up, kind)
    return found.withColumns({"doc_id": F.when(F.col("doc_id") != null, F.col("doc_id")), "perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))})


def op4_pitman_yor(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs.withColumn("held", fold_id(F.col("doc_id"), 5) == 1), "held")
