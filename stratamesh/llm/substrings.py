"""Removal of repeated substrings with suffix arrays.

A string of LENGTH bytes is filed under its minimizer, the gram with the least
hash in it, so equal strings share a gram. Grams that occur once need no look.
Around the others, the stretch of text whose strings share that gram occurrence
is a context; equal contexts stand for one another. Contexts go to shards by
gram. A shard is a suffix array, built by Larsson-Sadakane refinement
in numpy; Kasai's common prefixes split it into classes of equal
strings, and each class keeps its first occurrence. A gram with too many
contexts for one shard has several; each deals its strings, in suffix order, to
parts by the place of the gram in them, which equal strings share, and the sorted runs
of a part are merged across shards by binary search for the strings themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table, trim
from .tokens import byte_values, mix

LENGTH = 100
GRAM = 24
#: Bytes of a shard, under 2**21; different contexts of one gram from which it has several shards.
SHARD_BYTES, SHARD_CONTEXTS = 600_000, 256
PARCEL = 500_000
#: Shards whose strings of some gram places make one part; strings of one place are dealt on by hash where there are more.
PART_SHARDS = 16
#: Contexts met again that a task remembers, so that later copies need not travel; this decides speed only.
REMEMBERED = 50_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text index, first start, last start, gram hash, context hash, place of the gram from the first start on) of each run of strings that share a minimizer occurrence."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(size) - size
    if n < length:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    value = byte_values()[data]
    weighted = np.concatenate([[np.uint64(0)], np.cumsum(value * _powers(_BASE, n), dtype=np.uint64)])
    inverse = _powers(_INVERSE, n + 1)
    hashed = mix((weighted[gram:] - weighted[:-gram]) * inverse[: n - gram + 1])
    least = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: n - length + 1], least[width - span :][: n - length + 1])
    inside = np.zeros(n + 1, dtype=np.int64)  # starts whose string lies in one text
    long = size >= length
    np.add.at(inside, begin[long], 1)
    np.add.at(inside, (begin + size - length + 1)[long], -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(least)])
    if not len(start):
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    first = start[new]
    last = start[np.concatenate([new[1:], [True]])]
    context = mix((weighted[last + length] - weighted[first]) * inverse[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    text = np.searchsorted(begin, first, side="right") - 1
    return text, first - begin[text], last - begin[text], hashed[at[new]], context, at[new] - first


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of fewer than 2**21 - 1 bytes, by Larsson-Sadakane refinement of unsorted groups."""
    n, low = len(data), np.uint64((1 << 21) - 1)
    wide = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(4, dtype=np.uint64)])
    key = wide[:n]
    for k in range(1, 4):
        key = (key << np.uint64(9)) | wide[k : n + k]
    order = np.sort((key << np.uint64(21)) | np.arange(n, dtype=np.uint64))
    sa = (order & low).astype(np.int64)
    group = order >> np.uint64(21)
    slots = np.arange(n)
    rank = np.zeros(n + 1, dtype=np.uint64)  # 1 + place of the group's first, 0 beyond the end
    done = 4
    while len(slots):
        new = np.concatenate([[True], group[1:] != group[:-1]])
        place = np.maximum.accumulate(np.where(new, slots, 0))
        rank[sa[slots]] = place.astype(np.uint64) + np.uint64(1)
        alone = new & np.concatenate([new[1:], [True]])
        slots = slots[~alone]
        if not len(slots):
            break
        i = sa[slots]
        key = (rank[i] << np.uint64(42)) | (rank[np.minimum(i + done, n)] << np.uint64(21)) | i.astype(np.uint64)
        order = np.sort(key)
        sa[slots] = (order & low).astype(np.int64)
        group = order >> np.uint64(21)
        done *= 2
    return sa, rank[:n].astype(np.int64) - 1


def common_prefixes(data: np.ndarray, sa: np.ndarray, begin: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of strings in the order of ``sa``, and the common prefix, ``length`` at most, of each with the one before.

    Text i has ``count[i]`` strings from ``begin[i]`` on. Kasai's scheme, for
    all texts abreast: the prefix of the next start is shorter by one at most,
    if the start after the neighbour is that of a string too.
    """
    n = len(data)
    is_start = np.zeros(n + 1, dtype=bool)
    where = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    is_start[where] = True
    order = sa[is_start[sa]]
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    prefix = np.zeros(n, dtype=np.int64)
    known = np.zeros(len(begin), dtype=np.int64)
    last = np.full(len(begin), -1)
    for t in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > t)
        p = begin[live] + t
        j = before[p]
        h = np.where((last[live] >= 0) & is_start[last[live] + 1], np.maximum(known[live] - 1, 0), 0)
        open_ = np.flatnonzero(j >= 0)
        while len(open_):
            a, b = p[open_] + h[open_], j[open_] + h[open_]
            same = (h[open_] < length) & (a < n) & (b < n)
            same[same] = data[a[same]] == data[b[same]]
            open_ = open_[same]
            h[open_] += 1
        h[j < 0] = 0
        prefix[p], known[live], last[live] = h, h, j
    return order, prefix[order]


def first_strings(contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings of ``contexts``: context and start of the first of each class of equal strings, and the classes in order.

    Returns (context index, start, class of each of these, place in the concatenated contexts).
    """
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    size = np.array([len(c) for c in contexts], dtype=np.int64)
    begin, count = np.cumsum(size) - size, size - length + 1
    sa, _ = suffix_array(data)
    order, prefix = common_prefixes(data, sa, begin, count, length)
    run = np.cumsum(prefix < length) - 1
    first = np.full(run[-1] + 1, len(data))
    np.minimum.at(first, run, order)
    i = np.searchsorted(begin, first, side="right") - 1
    return i, first - begin[i], np.arange(len(first)), first


def _ranges(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers in sorted ``at``."""
    new = np.concatenate([[True], np.diff(at) != 1])
    return at[new], at[np.concatenate([new[1:], [True]])]


def _kept(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Ranges of starts (id, first, last) that are first occurrences in one shard; ``rows`` by id and start."""
    i, start, _, _ = first_strings(rows["context"].to_list(), length)
    start = start + rows["start"].to_numpy(dtype=np.int64)[i]
    order = np.lexsort((start, i))
    i, start = i[order], start[order]
    new = np.concatenate([[True], (np.diff(start) != 1) | (np.diff(i) != 0)])
    end = np.concatenate([new[1:], [True]])
    return pd.DataFrame({"id": rows["id"].to_numpy(dtype=np.int64)[i[new]], "first": start[new], "last": start[end]})


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted strings with the least (id, start) each, from runs that are sorted by string; binary search finds each string's place.

    Runs are merged two and two, so that each string is moved a few times only.
    """
    runs = list(runs)
    while len(runs) > 1:
        a, b = runs.pop(0), runs.pop(0)
        runs.append(_merge(*a, *b))
    return runs[0]


def _merge(keys, ids, starts, k, i, s) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, k)
    met = at < len(keys)
    met[met] = keys[at[met]] == k[met]
    old = at[met]
    less = (i[met] < ids[old]) | ((i[met] == ids[old]) & (s[met] < starts[old]))
    ids, starts = ids.copy(), starts.copy()
    ids[old[less]], starts[old[less]] = i[met][less], s[met][less]
    return tuple(np.insert(x, at[~met], y[~met]) for x, y in ((keys, k), (ids, i), (starts, s)))


def dealt_strings(texts: list[bytes], where: np.ndarray, place: np.ndarray, shards: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings at ``where`` of the concatenated texts, and the part of each by the place of the gram in it."""
    places = length - gram + 1
    parts = min(places, -(-shards // PART_SHARDS))
    more = -(-shards // (PART_SHARDS * places))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    part = place * parts // places * more
    if more > 1:
        weighted = np.concatenate([[np.uint64(0)], np.cumsum(byte_values()[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
        part = part + (mix((weighted[where + length] - weighted[where]) * _powers(_INVERSE, len(data))[where]) % np.uint64(more)).astype(np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(data, length)[where]
    return windows.view(f"S{length}").ravel(), part  # all have this length, so ends of zeros tell nothing


def first_occurrences(contexts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, first, last): ranges of starts whose strings occur there first.

    ``contexts`` has gram, shards (of the gram), id, start, context and place (of the gram in it).
    """
    shard = F.when(F.col("shards") > 1, F.pmod(F.xxhash64("id", "start"), F.col("shards"))).otherwise(0)
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.withColumn("shard", shard.cast("int")).repartition(n, "gram", "shard").sortWithinPartitions("gram", "shard", "id", "start")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for rows in _shards(frames):
            several = int(rows["shards"].iloc[0])
            if several == 1:
                yield _kept(rows.sort_values(["id", "start"]), length).assign(gram=0, part=-1, data=None, places=None)
                continue
            # A run of one gram's strings in suffix order, for each part.
            texts = rows["context"].to_list()
            i, start, _, where = first_strings(texts, length)
            strings, part = dealt_strings(texts, where, rows["place"].to_numpy(dtype=np.int64)[i] - start, several, length, gram)
            ids, starts = rows["id"].to_numpy(dtype=np.int64)[i], rows["start"].to_numpy(dtype=np.int64)[i] + start
            press = zstandard.ZstdCompressor(level=1)
            made = [(0, 0, 0, int(rows["gram"].iloc[0]), int(q), press.compress(strings[own].tobytes()), ids[own].tobytes() + starts[own].tobytes()) for q in np.unique(part) for own in [part == q]]
            yield pd.DataFrame(made, columns=["id", "first", "last", "gram", "part", "data", "places"])
        trim()

    found = materialise(dealt.mapInPandas(run, "id long, first long, last long, gram long, part int, data binary, places binary"))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        runs = []
        for d, places in zip(frame["data"], frame["places"]):
            x = np.frombuffer(places, dtype=np.int64).reshape(2, -1)
            runs.append((np.frombuffer(zstandard.ZstdDecompressor().decompress(d), dtype=f"S{length}"), x[0], x[1]))
        _, ids, starts = merge_runs(runs)
        order = np.lexsort((starts, ids))
        ids, starts = ids[order], starts[order]
        new = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(ids) != 0)])
        return pd.DataFrame({"id": ids[new], "first": starts[new], "last": starts[np.concatenate([new[1:], [True]])]})

    whole = found.filter("part < 0").select("id", "first", "last")
    merged = found.filter("part >= 0").groupBy("gram", "part").applyInPandas(merge, "id long, first long, last long")
    return whole.unionByName(merged)


def _shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in shards: whole grams together, up to SHARD_BYTES; each shard of a gram with several by itself."""
    rest = None
    for frame in frames:
        rows = frame.reset_index(drop=True) if rest is None else pd.concat([rest, frame], ignore_index=True)
        at, cut = _cut(rows, False)
        for a, b in cut:
            yield rows.iloc[a:b]
        rest = rows.iloc[at:]
    if rest is not None:
        yield from (rest.iloc[a:b] for a, b in _cut(rest, True)[1])


def _cut(rows: pd.DataFrame, last: bool) -> tuple[int, list[tuple[int, int]]]:
    """Where the rows left over begin, and bounds of the shards before; the last gram, and a small shard, wait for more rows unless ``last``."""
    gram, shard, several = rows["gram"].to_numpy(), rows["shard"].to_numpy(), rows["shards"].to_numpy() > 1
    ends = np.flatnonzero((gram[1:] != gram[:-1]) | (shard[1:] != shard[:-1])) + 1
    if last and len(rows):
        ends = np.append(ends, len(rows))
    weight = np.concatenate([[0], np.cumsum([len(c) for c in rows["context"]])])
    alone = np.append(np.flatnonzero(several), len(rows))
    at, out = 0, []
    while (k := int(np.searchsorted(ends, at, side="right"))) < len(ends):
        end = int(ends[k])
        if not several[at]:
            full = int(np.searchsorted(weight[ends], weight[at] + SHARD_BYTES, side="right")) - 1
            stop = int(alone[np.searchsorted(alone, at)])
            if full == len(ends) - 1 and stop >= ends[-1] and not last:
                break
            end = min(max(end, int(ends[max(full, k)])), stop)
        out.append((at, end))
        at = end
    return at, out


def removed_ranges(stretches: list[tuple[int, int]], kept: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Byte ranges (end exclusive) covered by the strings that start in ``stretches`` but not in ``kept``."""
    if not stretches:
        return []
    top = max(b for _, b in stretches) + 2
    starts = np.zeros(top, dtype=np.int64)
    for sign, ranges in ((1, stretches), (-1, kept)):
        for a, b in ranges:
            starts[a] += sign
            starts[b + 1] -= sign
    gone = np.flatnonzero(np.cumsum(starts) > 0)
    if not len(gone):
        return []
    far = np.flatnonzero(np.diff(gone) > length)
    return [(int(gone[a]), int(gone[b]) + length) for a, b in zip([0, *(far + 1)], [*far, len(gone) - 1])]


class _Known:
    """Contexts that a task has met again, the most frequent ones, each with an occurrence that went on as it is."""

    def __init__(self):
        self.rows = np.empty((6, 0), dtype=np.int64)  # sort key, gram, context, id, start, times

    def later(self, at: np.ndarray, *fields: np.ndarray) -> np.ndarray:
        """Those of ``at`` whose context is known from an earlier text, or place in it."""
        key, known = _key(fields[0][at], fields[1][at]), self.rows
        place = np.minimum(np.searchsorted(known[0], key), max(0, known.shape[1] - 1))
        if not known.shape[1]:
            return at[:0]
        g, c, i, a = (f[at] for f in fields)
        found = known[:, place]
        return at[(found[1] == g) & (found[2] == c) & ((i > found[3]) | ((i == found[3]) & (a > found[4])))]

    def add(self, at: np.ndarray, times: np.ndarray, *fields: np.ndarray) -> None:
        new = np.stack([_key(fields[0][at], fields[1][at]), *(f[at].astype(np.int64) for f in fields), times])
        rows = np.concatenate([self.rows, new], axis=1)
        rows = rows[:, np.lexsort(rows[[4, 3, 2, 1, 0]])]
        same = (rows[:3, 1:] == rows[:3, :-1]).all(axis=0)
        begin = np.flatnonzero(np.concatenate([[True], ~same])[: rows.shape[1]])
        in_all = np.add.reduceat(rows[5], begin) if len(begin) else rows[5]
        rows = rows[:, begin]  # of each context the earliest
        rows[5] = in_all
        if rows.shape[1] > REMEMBERED:
            rows = rows[:, np.sort(np.argsort(-rows[5], kind="stable")[:REMEMBERED])]
        self.rows = rows


def _key(gram: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(gram.view(np.uint64) ^ mix(context.view(np.uint64))).view(np.int64)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row of ``docs``.

    Bytes covered by a string of ``length`` bytes that also starts earlier
    (in a row with a smaller id, or earlier in the same text) are removed;
    ``kept_sha256`` is the digest of what
    remains, ``spans`` are the removed byte ranges. Null counts as the empty text. Of equal texts all
    but those with the smallest id go, if long enough; rows equal in id and
    text get equal results, and of different texts under one id, strings at
    equal starts both stay. Null ids come last.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    rows = materialise(own.select("__id", "id", size.alias("n_bytes"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key")))
    first = rows.groupBy("key").agg(F.min("id").alias("id"))

    def squeeze(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for frame in frames:
            raw = [t.encode("utf-8", "surrogatepass") for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "key": [hashlib.sha256(r).digest() for r in raw], "z": [press.compress(r) for r in raw]})

    pressed = own.filter(size >= length).select("id", "text").mapInPandas(squeeze, "id long, key binary, z binary")
    texts = materialise(pressed.join(first, ["id", "key"]).dropDuplicates(["id", "key"]))  # one row for each text

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press, known = zstandard.ZstdDecompressor(), _Known()
        for frame in frames:
            for some in _parcels(frame, press):
                i, a, b, g, c, place = anchors(some["text"].to_list(), length, gram)
                ids, g, c = some["id"].to_numpy(dtype=np.int64)[i], (g >> np.uint64(1)).astype(np.int64), c.view(np.int64)
                # Of equal contexts seen in this task all but the first are settled; they go on spread evenly, under negative grams.
                order = np.lexsort((a, ids, c, g))
                again = np.flatnonzero((g[order][1:] == g[order][:-1]) & (c[order][1:] == c[order][:-1])) + 1
                settled = order[again]
                alone = np.ones(len(g), dtype=bool)
                alone[settled] = False
                settled = np.concatenate([settled, known.later(np.flatnonzero(alone), g, c, ids, a)])
                first = np.setdiff1d(again - 1, again)
                known.add(order[first], np.diff(np.append(np.searchsorted(again, first), len(again))), g, c, ids, a)
                g[settled] = -1 - (mix(ids[settled].view(np.uint64) * np.uint64(31) + a[settled].astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
                c[settled] = 0
                yield pd.DataFrame({"gram": g, "context": c, "id": ids, "start": a.astype(np.int32), "more": (b - a).astype(np.int32), "place": place.astype(np.int32)})
        trim()

    filed = texts.select("id", "z").mapInPandas(file, "gram long, context long, id long, start int, more int, place int")
    by = Window.partitionBy("gram").orderBy("context", "id", "start")
    all_ = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = filed.withColumns({"n": F.count("*").over(all_), "leads": (F.col("gram") >= 0) & F.coalesce(F.lag("context").over(by) != F.col("context"), F.lit(True))}).filter("n > 1 OR gram < 0")
    shards = F.ceil(F.sum(F.col("leads").cast("int")).over(all_) / SHARD_CONTEXTS).cast("int")
    repeated = materialise(marked.withColumn("shards", shards).select("id", "start", "more", "place", "leads", F.when(F.col("leads"), F.col("gram")).alias("gram"), F.when(F.col("leads"), F.col("shards")).alias("shards")))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for frame in frames:
            for at in range(0, len(frame), 500):
                out = []
                some = frame.iloc[at : at + 500]
                for key, z, parts in zip(some["id"], some["z"], some["parts"]):
                    t = press.decompress(z)
                    out += [(p["gram"], p["shards"], key, p["start"], t[p["start"] : p["start"] + p["more"] + length], p["place"]) for p in parts]
                yield pd.DataFrame(out, columns=["gram", "shards", "id", "start", "context", "place"])
        trim()

    leads = repeated.filter("leads").groupBy("id").agg(F.collect_list(F.struct("gram", "shards", "start", "more", "place")).alias("parts"))
    contexts = texts.join(leads, "id").select("id", "z", "parts").mapInPandas(cut, "gram long, shards int, id long, start int, context binary, place int")
    kept = materialise(first_occurrences(contexts, length, gram))

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for frame in frames:
            out = []
            for key, hashed, z, had, stay in zip(frame["id"], frame["key"], frame["z"], frame["had"], frame["stay"]):
                t = press.decompress(z)
                ranges = removed_ranges(*([(int(p) >> 16, (int(p) >> 16) + (int(p) & 0xFFFF)) for p in x] if x is not None else [] for x in (had, stay)), length)
                parts = [t[a:b] for a, b in zip([0, *(b for _, b in ranges)], [*(a for a, _ in ranges), len(t)])]
                out.append((key, hashed, [[int(a), int(b)] for a, b in ranges], sum(b - a for a, b in ranges), hashlib.sha256(b"".join(parts)).hexdigest()))
            yield pd.DataFrame(out, columns=["id", "key", "spans", "n_removed", "kept_sha256"])

    # A range of starts as one number: the first, and how many follow (fewer than 2**16 share a minimizer).
    packed = lambda first, more: F.shiftleft(first.cast("long"), 16).bitwiseOR(more.cast("long"))
    had = repeated.groupBy("id").agg(F.collect_list(packed(F.col("start"), F.col("more"))).alias("had"))
    stay = kept.groupBy("id").agg(F.collect_list(packed(F.col("first"), F.col("last") - F.col("first"))).alias("stay"))
    done = texts.join(had, "id", "left").join(stay, "id", "left").select("id", "key", "z", "had", "stay")
    done = done.mapInPandas(finish, "id long, key binary, spans array<array<bigint>>, n_removed long, kept_sha256 string")
    joined = rows.join(done, ["id", "key"], "left")
    short = F.col("n_bytes") < length
    copy = F.col("spans").isNull() & ~short
    plain = F.when(short, F.lower(F.hex("key"))).otherwise(F.sha2(F.lit(b""), 256))
    return joined.select(
        F.col("__id").alias(doc_id),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", plain).alias("kept_sha256"),
        F.when(copy, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.coalesce("spans", F.array().cast("array<array<bigint>>"))).alias("spans"),
    )


def _parcels(frame: pd.DataFrame, press) -> Iterator[pd.DataFrame]:
    ids, texts, size = [], [], 0
    for i, z in zip(frame["id"], frame["z"]):
        t = press.decompress(z)
        if texts and size + len(t) > PARCEL:
            yield pd.DataFrame({"id": ids, "text": texts})
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t)
    if texts:
        yield pd.DataFrame({"id": ids, "text": texts})


def op2_suffix_array_dedup(spark, sf_dir):
    return deduplicate(table(spark, sf_dir, "documents")).drop("spans")
