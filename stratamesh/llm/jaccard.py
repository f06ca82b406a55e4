"""Similarity join of shingle sets with PartEnum signatures.

Two sets with Jaccard similarity of at least g and sizes up to h differ in at
most k = 2h(1-g)/(1+g) elements. Sets fall into bands of sizes, a set near
a band's upper end into the next one too. In a band the feature domain is dealt by hash
into partitions of n2 parts; of similar sets, some partitions have at most one
part that differs, so dropping one part at a time (enumerating subsets of
n2-1 parts) they share a signature there. There are more partitions than needed,
so a few whose signatures hold hardly any element can stay unsigned.

Signatures with the same members count once. Sets that share a signature are
compared by parity sketches, which bound their difference from below: no pair
that could link is lost. Signatures are dealt to tasks by their least member, so that the sketch
of a set is sent to few tasks. What passes connects clusters, each set is sent
to its cluster once, and links are found there exactly. Clusters too large for
one task are linked in rounds: every signature's sets are compared with a
pivot, and pairs in one component are settled. When few pairs are open, each of
them is verified. Texts that are equal stand for one another from the start.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components, roots_of
from .common import discard, materialise, table, trim
from .tokens import mix, pack, parcels, shingle_sets, steps, unpack

BAND = 1.3
#: Signatures of fewer elements are left out in as many partitions as there are to spare, one in SPARE.
LIGHT, SPARE = 2, 16
#: Signatures of a bucket, on average, and how many are dealt to buckets at a time.
BUCKET_ROWS, BATCH_ROWS = 1_500_000, 1_000_000
#: Once so many rows of a bucket are held, signatures with HOT or more of them are passed on as they come.
HELD_ROWS, HOT = 4_000_000, 1000
#: Bytes of signatures and sketches compared in one task; a signature of more than BLOCK_ROWS sets is compared block by block.
TASK_BYTES, BLOCK_ROWS = 8_000_000, 20_000
#: Bytes of sketches of the pairs that are compared at a time.
PAIR_BYTES = 8_000_000
#: Clusters of up to so many texts and elements are linked in one task.
CLUSTER_TEXTS, CLUSTER_ELEMENTS = 4000, 1_500_000
#: Bits of the filter that spares texts outside clusters a shuffle: at most half a million words of 64.
FILTER_BITS = 1 << 25
#: Bytes of a cluster's bit table at a time.
TABLE_BYTES = 48_000_000
#: Rounds with pivots go on until so many pairs a text are open at most.
OPEN_PAIRS = 5


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def parts_of(percent: int) -> int:
    """Parts of a partition: of which one is dropped. Fewer signatures where many elements may differ."""
    return 3 if percent >= 85 else 2


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one set of 64-bit elements in each of its bands; none for the empty set."""
    m = len(elements)
    if not m:
        return np.empty(0, dtype=np.uint64)
    g, n2, out = percent / 100, parts_of(percent), []
    own = int(math.log(m) / math.log(BAND) + 1e-9)
    # A partner can be as large as m / g, and its band holds then.
    for band in range(own, int(math.log(m / g) / math.log(BAND) + 1e-9) + 1):
        most = math.ceil(BAND ** (band + 1))
        k = int(2 * most * (1 - g) / (1 + g) + 1e-9)
        need = k // 2 + 1  # k differences: one of so many partitions has fewer than 2
        spare = need // SPARE
        n1 = need + 2 * spare  # either set may leave so many unsigned
        spread = mix(elements + np.uint64(0x5BF0))
        part = (spread % np.uint64(n1 * n2)).astype(np.int64)
        sums = np.zeros(n1 * n2, dtype=np.uint64)
        np.add.at(sums, part, mix(spread + np.uint64(1)))
        sums, held = sums.reshape(n1, n2), np.bincount(part, minlength=n1 * n2).reshape(n1, n2)
        place = np.arange(n1, dtype=np.uint64) * np.uint64(8) + np.uint64(band << 40)
        found = mix(mix(sums.sum(axis=1, dtype=np.uint64)[:, None] - sums) + mix(place[:, None] + np.arange(n2, dtype=np.uint64)))
        left = held.sum(axis=1)[:, None] - held  # elements in each signature
        light = np.flatnonzero(left.min(axis=1) < LIGHT)
        light = light[np.argsort(left[light].min(axis=1), kind="stable")[:spare]]
        signed = np.ones((n1, n2), dtype=bool)
        signed[light] = left[light] >= LIGHT
        out.append(found[signed])
    return np.concatenate(out)


def sketch(elements: np.ndarray) -> bytes:
    """The parity of the number of elements in each of 2**q parts of the domain, 2**q being as large as the set; empty for the empty set."""
    if not len(elements):
        return b""
    parts = 1 << max(6, (len(elements) - 1).bit_length())
    at = (mix(elements + np.uint64(0x51)) & np.uint64(parts - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=parts).astype(np.uint8) & 1, bitorder="little").tobytes()


def halved(bits: np.ndarray) -> np.ndarray:
    """Sketches, a row each, over half as many parts."""
    half = bits.shape[1] // 2
    if half:
        return bits[:, :half] ^ bits[:, half:]
    return (bits ^ (bits >> np.uint64(32))) & np.uint64(0xFFFFFFFF)


def near(rows: pd.DataFrame, sets: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(id, other): links that connect the sets of one signature whose sketches let them be similar.

    ``rows`` has signature and id, ``sets`` has id, n and sketch.
    """
    ids = sets["id"].to_numpy(dtype=np.int64)
    order = np.argsort(ids)
    ids, size = ids[order], sets["n"].to_numpy(dtype=np.int64)[order]
    sketches = sets["sketch"].to_numpy()[order]
    words = np.array([len(b) // 8 for b in sketches], dtype=np.int64)
    table_of, row_of, folded = {}, np.zeros(len(ids), dtype=np.int64), {}
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        table_of[w] = np.frombuffer(b"".join(sketches[at]), dtype=np.uint64).reshape(-1, w)
        row_of[at] = np.arange(len(at))
        folded[w] = halved(table_of[w])
    del sketches
    signature, which = rows["signature"].to_numpy(), np.searchsorted(ids, rows["id"].to_numpy(dtype=np.int64))
    order = np.lexsort((which, signature))
    signature, which = signature[order], which[order]
    root = np.arange(len(ids))

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Parts in which the sketches of pairs differ."""
        out = np.zeros(len(x), dtype=np.int64)
        low, high = np.minimum(words[x], words[y]), np.maximum(words[x], words[y])
        for w in np.unique(low).tolist():
            step = max(1, PAIR_BYTES // (8 * w))
            for top, wide in ((w, table_of[w]), (2 * w, folded.get(2 * w))):
                met = np.flatnonzero((low == w) & (high == top))
                for at in range(0, len(met), step):
                    k = met[at : at + step]
                    narrow = words[x[k]] == w
                    a, b = np.where(narrow, x[k], y[k]), np.where(narrow, y[k], x[k])
                    out[k] = np.bitwise_count(table_of[w][row_of[a]] ^ wide[row_of[b]]).sum(axis=1, dtype=np.int64)
        return out

    live, d = np.arange(len(which)), 1
    while True:
        live = live[live + d < len(which)]
        live = live[signature[live] == signature[live + d]]
        if not len(live):
            break
        passed = []
        for at in range(0, len(live), BLOCK_ROWS):
            x, y = which[live[at : at + BLOCK_ROWS]], which[live[at : at + BLOCK_ROWS] + d]
            small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            open_ = (root[x] != root[y]) & (100 * small >= percent * large)
            x, y = x[open_], y[open_]
            near_ = apart(x, y) <= (size[x] + size[y]) * (100 - percent) // (100 + percent)
            passed.append(np.stack([x[near_], y[near_]]))
        x, y = np.concatenate(passed, axis=1)
        if len(x):
            root = roots_of(np.concatenate([np.arange(len(ids)), x]), np.concatenate([root, y]), len(ids))
        d += 1
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return pd.DataFrame({"id": ids[moved], "other": ids[root[moved]]})


def packed(elements: np.ndarray) -> bytes:
    return np.unique(elements).astype("<u8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u8")


def link_cluster(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest id that links lead to; pairs already in one component aren't compared."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    order = np.lexsort((ids, size))
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    cut = np.split(code, np.cumsum(size)[:-1])
    holders = np.bincount(code)
    column = np.cumsum(holders > 1) - 1
    words = int((holders > 1).sum()) // 64 + 1
    size, ids = size[order], ids[order]
    at = [column[c[holders[c] > 1]] for c in (cut[i] for i in order)]

    def table_of(low: int, high: int) -> np.ndarray:
        """Bits of the columns of words ``low`` to ``high``, a row for each set."""
        bits = np.zeros((m, high - low), dtype=np.uint64)
        for row, c in enumerate(at):
            c = c[(c >> 6 >= low) & (c >> 6 < high)]
            np.bitwise_or.at(bits[row], (c >> 6) - low, np.uint64(1) << (c & 63).astype(np.uint64))
        return bits

    step = max(1, TABLE_BYTES // (8 * m))
    common_of = None
    if words > step:  # in pieces, adding up
        common_of = np.zeros((m, m), dtype=np.int32)
        for low in range(0, words, step):
            bits = table_of(low, min(words, low + step))
            for i in range(m - 1):
                common_of[i, i + 1 :] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(axis=1, dtype=np.int32)
    else:
        bits = table_of(0, words)
    root = np.arange(m)
    for i in range(m):
        top = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))  # sizes grow: larger ones can't link
        other = np.arange(i + 1, top)
        other = other[root[other] != root[i]]
        if len(other):
            common = common_of[i, other].astype(np.int64) if common_of is not None else np.bitwise_count(bits[other] & bits[i]).sum(axis=1, dtype=np.int64)
            for j in root[other[100 * common >= percent * (size[i] + size[other] - common)]]:
                root[root == root[j]] = root[i]
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    out = np.empty(m, dtype=np.int64)  # back in the given order
    out[order] = least[root]
    return out


def link_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = []
            for x, y in zip(frame["x"], frame["y"]):
                p, q = unpacked(x), unpacked(y)
                good.append(linked(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent))
            yield frame.loc[np.array(good, dtype=bool), ["a", "b"]]

    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
    both = first.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(run, pairs.select("a", "b").schema)


def link_large(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links that connect the sets of large clusters, by rounds of pivots and then pair by pair."""
    spark = shared.sparkSession
    n = sets.count()
    links = spark.createDataFrame([], "a long, b long")
    labels, tried, k, done = sets.select("id", F.col("id").alias("root")), None, 0, -1
    while True:
        held = materialise(shared.join(labels, "id"))
        by = held.groupBy("signature").agg(F.count("*").alias("n"), F.count_distinct("root").alias("roots"))
        alike = held.groupBy("signature", "root").count().groupBy("signature").agg(F.sum(F.col("count") * F.col("count")).alias("settled"))
        mixed = by.filter("roots > 1").join(alike, "signature")
        about = mixed.agg(F.sum(F.expr("(n * n - settled) / 2"))).first()[0] or 0
        if not about or about <= OPEN_PAIRS * n or done == about:
            break
        done = about
        least = held.join(mixed.select("signature"), "signature").groupBy("signature").agg(F.min(F.struct(F.xxhash64("id", F.lit(k)), "id", "root")).alias("p"))
        star = held.join(least, "signature").filter("root <> p.root").select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()
        if tried is not None:
            star = star.join(tried, ["a", "b"], "left_anti")
        star = materialise(star)
        tried = star if tried is None else tried.unionByName(star)
        links = materialise(links.unionByName(link_pairs(star, sets, percent)))
        labels = _labels(sets, links)
        k += 1
    if about:
        x = held.join(mixed.select("signature"), "signature")
        y = x.select("signature", F.col("id").alias("b"), F.col("root").alias("root_b"))
        pairs = x.join(y, "signature").filter("id < b AND root <> root_b").select(F.col("id").alias("a"), "b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        links = links.unionByName(link_pairs(pairs, sets, percent))
    return links


def _labels(sets: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links, "a", "b").withColumnRenamed("node", "id")
    return materialise(sets.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root")))


def text_key(text: str | None) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"", digest_size=16).digest()


def _sets_of(frame: pd.DataFrame, column: str, n: int, press=None) -> Iterator[np.ndarray]:
    texts = (press.decompress(z).decode("utf-8", "surrogatepass") for z in frame[column]) if press else frame[column]
    for part in parcels(texts):
        yield from shingle_sets(part, n)


def join(docs: DataFrame, n: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    A set holds the distinct ``n``-word shingles of a text, a shorter text's
    words being one; sets are linked if 100 * intersection >= ``percent`` *
    union. ``component_id`` is the smallest id that links lead to. Texts
    without words, and null texts, link with nothing and keep their own id; a
    null id is no node, so its row takes the component of equal texts with
    ids, else null. Rows with one id and several texts count as linked.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def about(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [(len(s), sketch(s)) for s in _sets_of(frame, "text", n)]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_shingles": [b[0] for b in both], "key": [text_key(t) for t in frame["text"]], "sketch": [b[1] for b in both]})
        trim()

    rows = materialise(own.mapInPandas(about, "doc_id long, n_shingles long, key binary, sketch binary"))
    # One node for each text that has words: its least id, or where that is another text's, a negative number from its key.
    first = rows.filter("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")).filter("n > 0")
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy("key")) > 1
    nodes = materialise(first.withColumn("id", F.when(again, -1 - F.shiftrightunsigned(F.xxhash64("key", "doc_id"), 1)).otherwise(F.col("doc_id"))))
    several = rows.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high")

    def squeeze(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "key": [text_key(t) for t in frame["text"]], "z": [press.compress(t.encode("utf-8", "surrogatepass")) for t in frame["text"]]})

    press = lambda df: df.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(squeeze, "doc_id long, key binary, z binary")
    texts = press(own).groupBy("key").agg(F.first("z").alias("z")).join(nodes.select("key", "id"), "key").select("id", "z")

    in_all = nodes.agg(F.sum("n")).first()[0] or 0
    rate = len(signatures(mix(np.arange(1000, dtype=np.uint64)), percent)) / 1000
    buckets = max(4, math.ceil(in_all * rate / BUCKET_ROWS))

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        found, ids, size = [], [], 0
        for frame in frames:
            for at in range(0, len(frame), 500):
                some = frame.iloc[at : at + 500]
                own = [signatures(s, percent) for s in _sets_of(some, "z", n, press)]
                found += own
                ids.append(some["id"].to_numpy(dtype=np.int64))
                size += sum(len(f) for f in own)
                if size >= BATCH_ROWS:
                    yield packages(found, np.concatenate(ids), buckets)
                    found, ids, size = [], [], 0
        if size:
            yield packages(found, np.concatenate(ids), buckets)
        trim()

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from shared_rows(frames)
        trim()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = texts.mapInPandas(sign, "bucket int, rows int, texts int, ids binary, data binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    # Signatures with the same members are one from here on; of very many rows (n is 0) they stay apart.
    shared = materialise(signed.mapInPandas(meet, "signature long, least long, n long, id long").distinct())
    if shared.filter("n = 0").limit(1).count():
        counts = shared.filter("n = 0").groupBy("signature").agg(F.count("*").alias("n"))
        whole = materialise(shared.filter("n > 0").unionByName(shared.filter("n = 0").drop("n").join(counts, "signature")))
        discard(shared)
        shared = whole

    sketches = nodes.select("id", "n", "sketch")
    passed = materialise(_passed(_deal(shared, sketches), sketches, percent))
    clusters = materialise(components(passed, "id", "other").withColumnRenamed("node", "id"))
    discard(passed)

    # The texts of clusters, once more, by the id that stands for each.
    stands = materialise(nodes.join(clusters, "id").select("id", "doc_id", "key", "root", "n"))

    def elements(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for frame in frames:
            sets = [packed(s) for s in _sets_of(frame, "z", n, press)]
            yield pd.DataFrame({"id": frame["id"], "root": frame["root"], "elements": sets})
        trim()

    sizes = stands.groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("in_all")).withColumn("large", F.expr(f"texts > {CLUSTER_TEXTS} OR in_all > {CLUSTER_ELEMENTS}"))
    sizes = materialise(sizes.select("root", "large"))
    placed = press(_likely(own, stands)).join(stands.drop("n"), ["doc_id", "key"]).dropDuplicates(["id"]).select("id", "root", "z").join(sizes, "root")

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        found = link_cluster(frame["id"].to_numpy(dtype=np.int64), [unpacked(e) for e in frame["elements"]], percent)
        return pd.DataFrame({"id": frame["id"], "component": found})

    fields = "id long, root long, elements binary"
    labels = materialise(placed.filter("NOT large").mapInPandas(elements, fields).groupBy("root").applyInPandas(cluster, "id long, component long"))
    if sizes.filter("large").limit(1).count():
        large = materialise(placed.filter("large").mapInPandas(elements, fields).select("id", "elements"))
        links = link_large(shared.join(large.select("id"), "id", "left_semi").select("signature", "id"), large, percent)
        labels = materialise(labels.unionByName(_labels(large, links).select("id", F.col("root").alias("component"))))
        discard(large)
    discard(clusters, sizes, shared, stands)
    if several.limit(1).count():  # several texts of one id are linked, whatever they hold
        twins = rows.join(several, "doc_id").select("doc_id", "key").join(nodes.select("key", "id"), "key").select("doc_id", "id").distinct()
        twins = twins.join(twins.groupBy("doc_id").agg(F.min("id").alias("other")), "doc_id").select("id", "other")
        edges = labels.withColumnRenamed("component", "other").unionByName(twins)
        labels = materialise(components(edges, "id", "other").select(F.col("node").alias("id"), F.col("root").alias("component")))
    # A component's least number can be a negative one: its least id is that of its texts.
    known = nodes.select("key", "id", "doc_id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = known.groupBy("component").agg(F.min("doc_id").alias("of"))
    by_key = known.join(least, "component").select("key", F.col("of").alias("component"))
    joined = rows.join(by_key, "key", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def packages(found: list[np.ndarray], ids: np.ndarray, buckets: int) -> pd.DataFrame:
    """A row for each bucket with the signatures of texts that fall into it: (signature, text) in order, packed."""
    signature = np.concatenate(found)
    text = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(f) for f in found])
    order = np.argsort(signature)
    signature, text = signature[order], text[order]
    bucket = (signature >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # ranges of signatures
    bound = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    out = []
    for b in range(buckets):
        part = slice(bound[b], bound[b + 1])
        if bound[b] < bound[b + 1]:
            used, which = np.unique(text[part], return_inverse=True)
            held = np.sort(ids[used])
            place = np.argsort(np.argsort(ids[used]))[which].astype(np.uint32)
            out.append((b, len(place), len(held), pack(steps(held)), pack(steps(signature[part]), place)))
    return pd.DataFrame(out, columns=["bucket", "rows", "texts", "ids", "data"])


def shared_rows(frames: Iterator[pd.DataFrame], most: int = HELD_ROWS, many: int = HOT) -> Iterator[pd.DataFrame]:
    """(signature, least, n, id) of signatures with two members or more, from packages sorted by bucket.

    Signatures with the same members get one number. While a bucket is held, its hot signatures are
    passed on under their own number with n = 0, so that memory stays bounded.
    """
    bucket, held, size, hot = None, [], 0, np.empty(0, dtype=np.uint64)

    def rows_of(signature: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        own = signature.view(np.int64)
        return pd.DataFrame({"signature": own, "least": own, "n": 0, "id": ids})

    def close() -> Iterator[pd.DataFrame]:
        signature, ids = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        if len(hot):
            out = np.isin(signature, hot)
            yield rows_of(signature[out], ids[out])
            signature, ids = signature[~out], ids[~out]
        order = np.lexsort((ids, signature))
        signature, ids = signature[order], ids[order]
        again = signature[1:] == signature[:-1]
        keep = np.concatenate([again, [False]]) | np.concatenate([[False], again])
        signature, ids = signature[keep], ids[keep]
        if not len(ids):
            return
        first = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
        n = np.diff(np.append(first, len(ids)))
        members = mix(np.add.reduceat(mix(ids.view(np.uint64)), first) + n.astype(np.uint64))
        one = np.unique(members, return_index=True)[1]
        n, first = n[one], first[one]
        at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield pd.DataFrame({"signature": np.repeat(members[one].view(np.int64), n), "least": np.repeat(ids[first], n), "n": np.repeat(n, n), "id": ids[at]})

    for frame in frames:
        for b, m, texts, ids, data in zip(frame["bucket"], frame["rows"], frame["texts"], frame["ids"], frame["data"]):
            if b != bucket and held:
                yield from close()
                held, size, hot = [], 0, hot[:0]
            bucket = b
            signature, place = unpack(data, m, np.uint64, np.uint32)
            held.append((np.cumsum(signature), np.cumsum(unpack(ids, texts, np.int64)[0])[place]))
            size += m
            if size > most:
                signature, ids = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                number, count = np.unique(signature, return_counts=True)
                hot = np.union1d(hot, number[count >= many])
                out = np.isin(signature, hot)
                yield rows_of(signature[out], ids[out])
                held, size = [(signature[~out], ids[~out])], 0
    if held:
        yield from close()


def _likely(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``own`` whose doc_id can be in ``wanted``: its hash is marked in a bit map of FILTER_BITS at most, which is broadcast."""
    bits = min(FILTER_BITS, 1 << max(12, (16 * wanted.count()).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    word, bit = F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    marks = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("marks"))
    return own.withColumns({"word": word, "bit": bit}).join(F.broadcast(marks), "word").filter("marks & bit <> 0").select("doc_id", "text")


def _deal(shared: DataFrame, sketches: DataFrame) -> DataFrame:
    """(task, signature, id): rows of ``shared`` in tasks of about TASK_BYTES.

    Signatures go by their least member; one of very many sets goes block by block, each two blocks together,
    and a member that is the least of very many rows has its signatures spread.
    """
    of = shared.select("least", "id").distinct().join(sketches.select("id", F.octet_length("sketch").alias("bytes")), "id")
    weight = of.groupBy("least").agg(F.sum("bytes").alias("bytes")).join(shared.groupBy("least").agg(F.count("*").alias("rows")), "least")
    weight = materialise(weight.select("least", (F.col("bytes") + 24 * F.col("rows")).alias("bytes")))
    tasks = -(-(weight.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES) or 1
    heavy = weight.filter(F.col("bytes") > TASK_BYTES // 4).select("least", F.ceil(F.col("bytes") / (TASK_BYTES // 4)).alias("parts"))
    block, blocks = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")), F.ceil(F.col("n") / BLOCK_ROWS)
    hot = shared.filter(f"n > {BLOCK_ROWS}").withColumn("blocks", blocks).withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    hot = hot.select(F.xxhash64("signature", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "signature", "id")
    rest = shared.filter(f"n <= {BLOCK_ROWS}").join(F.broadcast(heavy), "least", "left")  # four heavy ones a task at most
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("signature"), F.col("parts"))).otherwise(F.lit(0))
    return rest.select(F.pmod(F.xxhash64("least", part), F.lit(tasks)).alias("task"), "signature", "id").unionByName(hot)


def _passed(dealt: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(id, other) links between sets of one signature whose sketches let them be similar."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = near(left, right, percent)
        trim()
        return out

    to = dealt.select(F.col("task").alias("t"), F.col("id").alias("i")).distinct().join(sketches.withColumnRenamed("id", "i"), "i").select("t", F.col("i").alias("id"), "n", "sketch")
    return dealt.groupBy("task").cogroup(to.groupBy("t")).applyInPandas(run, "id long, other long").distinct()


def keep_one(docs: DataFrame, n: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, and rows without an id."""
    found = join(docs, n, percent, doc_id, text).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("c"))
    gone = found.filter("c <> doc_id").select(F.col("doc_id").alias(doc_id))
    return docs.join(gone, doc_id, "left_anti")


def op7_ngram_jaccard_join(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"), 3, 90)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def sql(n: int, percent: int, docs: str = "documents") -> str:
    """SQL for ``join``."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, w, len(w) AS k FROM (SELECT doc_id, {_WORDS} AS w FROM {docs})),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(k, {n}) - 1], ' ') AS s
  FROM d, unnest(range(1, k - least(k, {n}) + 2)) AS t(i) WHERE k > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(reach) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n
"""


SQL = sql(3, 90)
