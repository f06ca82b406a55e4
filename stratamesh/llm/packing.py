"""Best-fit packing by a configuration linear program.

Token counts of pieces form a histogram of at most 4096 lengths, whatever the
number of pieces; all planning works on it. Lengths are grouped upwards into
classes of 32 tokens. The covering program over configurations (multisets of
classes that fit one sequence) is solved by multiplicative weights: classes
hold weights, a knapsack dynamic program prices the best configuration, and
its classes' weights shrink; the solution is scaled so that every class is
covered. It is rounded to whole sequences, whose last slot takes the
longest piece that fits, and the program is solved anew for what is left, until a
seventh of the tokens or so remains. This residue goes best-fit, longest first,
into the gaps of these sequences and into new ones. The plan is a list of
(exact lengths, number of sequences) and pieces find their places by rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table, worker_state

CAPACITY = 4096
END_ID = 1
#: Tokens of a class; pricing rounds of a solution at most; accuracy aimed at; tokens that a programmed sequence may leave free;
#: share of the tokens that goes best-fit in the end.
CLASS, ROUNDS, ACCURACY, GAP, RESIDUE = 32, 1500, 0.4, 2, 0.15
#: Pieces of one length are ranked in so many parts at least, and in more once a part would hold more than PART_ROWS,
#: so that a hot length is neither one task nor a long one.
PARTS, PART_ROWS = 64, 200_000
#: Entries of a worker's cache of encoded words, and the longest word kept there.
CACHE_WORDS, CACHE_LENGTH = 600_000, 64


def encoder(path: str | None = None):
    """text -> its ids as little-endian unsigned 32-bit, the end id last; null counts as empty.

    The tokenizer lower-cases, drops white space and never joins across it, so
    words are encoded apart. Encoded words are kept for later tasks of the
    same worker, up to CACHE_WORDS of them; later words are encoded anew each time.
    """
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("word_bpe_49k.json")
    held = worker_state()
    if ("tokenizer", path) not in held:
        held["tokenizer", path], held["words", path] = Tokenizer.from_file(path), {"": b""}
    own, words = held["tokenizer", path], held["words", path]
    beyond_latin = re.compile("[^\x00-\u024f]").search

    def encode_word(word: str) -> bytes:
        return np.array(own.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def look_up(word: str) -> bytes:
        if len(word) > CACHE_LENGTH:
            return encode_word(word)
        if word[-1] in ".," and len(word) > 1 and word[-2].isascii() and word[-2].isalnum():  # punctuation is a token of its own after a letter or digit
            return (words.get(word[:-1]) or keep(word[:-1])) + (words.get(word[-1]) or keep(word[-1]))
        return keep(word)

    def keep(word: str) -> bytes:
        ids = encode_word(word)
        if len(words) < CACHE_WORDS:
            words[word] = ids
        return ids

    end, get = np.array([END_ID], dtype="<u4").tobytes(), words.get

    def encode(text: str | None) -> bytes:
        text = text or ""
        if not beyond_latin(text):  # elsewhere lower case can hang on the neighbours
            text = text.lower()
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        out = [get(w) for w in parts]
        if None in out:
            out = [look_up(w) if ids is None else ids for w, ids in zip(parts, out)]
        return b"".join(out) + end

    return encode


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for frame in frames:
            out = []
            for key, t in zip(frame["__id"], frame["__text"]):
                ids = encode(t if isinstance(t, str) else None)
                out += [(key, k, k * capacity, len(part := ids[4 * capacity * k : 4 * capacity * (k + 1)]) // 4, zlib.crc32(part)) for k in range(-(-len(ids) // (4 * capacity)))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    return own.mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def price(value: np.ndarray) -> np.ndarray:
    """Unbounded knapsack: how often each class of 1 to n units stands in the best filling of n units; ``value`` by class, entry 0 unused."""
    n = len(value) - 1
    best, took = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
    for room in range(1, n + 1):
        reach = value[1 : room + 1] + best[room - 1 :: -1]
        k = int(reach.argmax())
        best[room], took[room] = reach[k], k + 1
    count = np.zeros(n + 1, dtype=np.int64)
    room = n
    while room > 0 and best[room] > 0:
        count[took[room]] += 1
        room -= int(took[room])
    return count


def solve(demand: np.ndarray, rounds: int = ROUNDS, accuracy: float = ACCURACY) -> list[tuple[np.ndarray, float]]:
    """Configurations of classes and how many sequences get each, by multiplicative weights; ``demand`` by class.

    Rounds end once each class is covered so often that its weight says nothing more; the mean then covers all.
    """
    present = demand > 0
    if not present.any():
        return []
    weight = np.where(present, 1.0, 0.0)
    used: dict[bytes, float] = defaultdict(float)
    covered = np.zeros(len(demand))
    enough = np.log(1 + present.sum()) / accuracy**2
    for _ in range(rounds):
        chosen = np.minimum(price(np.where(present, weight / np.maximum(demand, 1), 0.0)), demand)
        gain = chosen / np.maximum(demand, 1)
        t = 1.0 / gain.max()  # the longest step that covers no class more than once
        used[chosen.tobytes()] += t
        covered += gain * t
        weight = np.where(present, np.exp(accuracy * (covered[present].min() - covered)), 0.0)
        if covered[present].min() >= enough:
            break
    for c in np.flatnonzero(present & (covered == 0)):  # after few rounds: a class in no configuration gets one of its own
        own = np.zeros(len(demand), dtype=np.int64)
        own[c] = min(demand[c], (len(demand) - 1) // c)
        used[own.tobytes()] += float(demand[c] / own[c])
        covered[c] = 1.0
    least = float(covered[present].min())
    return [(np.frombuffer(k, dtype=np.int64), x / least) for k, x in used.items()]


class _Stock:
    """Pieces that are left, by exact length and by class."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.class_of = -(-np.arange(capacity + 1) // CLASS)
        self.lengths = sorted(int(x) for x in np.flatnonzero(self.left))
        self.capacity = capacity

    def demand(self) -> np.ndarray:
        return np.bincount(self.class_of, weights=self.left, minlength=-(-self.capacity // CLASS) + 1).astype(np.int64)

    def longest(self, most: int, taken: dict[int, int]) -> int:
        """The longest length up to ``most`` of which more than ``taken`` are left, or 0."""
        at = bisect.bisect_right(self.lengths, most) - 1
        while at >= 0 and self.left[self.lengths[at]] <= taken.get(self.lengths[at], 0):
            at -= 1
        return self.lengths[at] if at >= 0 else 0

    def take(self, config: np.ndarray, n: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Up to ``n`` sequences of this configuration, in runs of equal lengths; the last slot takes the longest piece that fits."""
        slots = [int(c) for c in np.flatnonzero(config)[::-1] for _ in range(int(config[c]))]
        while n > 0:
            need: dict[int, int] = {}
            room = self.capacity
            for c in slots[:-1]:
                length = self.longest(min(c * CLASS, room), need)
                if length <= (c - 1) * CLASS:  # the class is used up
                    return
                need[length] = need.get(length, 0) + 1
                room -= length
            length = self.longest(room, need)
            if length <= (slots[-1] - 1) * CLASS or room - length > GAP:
                return
            need[length] = need.get(length, 0) + 1
            times = min(n, *(int(self.left[x]) // k for x, k in need.items()))
            for x, k in need.items():
                self.left[x] -= times * k
                if not self.left[x]:
                    del self.lengths[bisect.bisect_left(self.lengths, x)]
            yield tuple(x for x, k in need.items() for _ in range(k)), times
            n -= times


def programmed(stock: _Stock, rounds: int = ROUNDS) -> Iterator[tuple[tuple[int, ...], int]]:
    """Sequences that the rounded program gives, and those of the program for what it leaves, until RESIDUE is left or nothing comes."""
    in_all = least = int((stock.left * np.arange(len(stock.left))).sum())
    while least > RESIDUE * in_all:
        solution = sorted(solve(stock.demand(), rounds), key=lambda c: -c[1])
        # What covers every class covers most of them too often: as many sequences as the tokens need.
        share = min(1.0, least / (stock.capacity * sum(x for _, x in solution)))
        before = least
        for config, x in solution:  # a configuration of less than one sequence is taken once while half of the tokens wait
            if least > RESIDUE * in_all and (x * share >= 1 or least > before / 2):
                for lengths, n in stock.take(config, max(1, int(x * share))):
                    least -= n * sum(lengths)
                    yield lengths, n
        if before == least:
            return


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of sequences) for a histogram of lengths of 1 to ``capacity``."""
    stock = _Stock(histogram, capacity)
    bins: dict[int, list[list]] = defaultdict(list)  # gap -> [lengths, number of sequences]
    for lengths, n in programmed(stock, rounds):
        bins[capacity - sum(lengths)].append([lengths, n])
    left = stock.left
    gaps = sorted(bins)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):  # new sequences, each with as many of this length as fit
                per = min(n, capacity // length)
                made = n // per
                _put(bins, gaps, capacity - per * length, (length,) * per, made)
                n -= per * made
                continue
            gap = gaps[at]
            lengths, m = bins[gap].pop()
            if not bins[gap]:
                del bins[gap], gaps[at]
            k = min(m, n)
            _put(bins, gaps, gap - length, (*lengths, length), k)
            if m > k:
                _put(bins, gaps, gap, lengths, m - k)
            n -= k
    return [(tuple(b[0]), b[1]) for gap in sorted(bins) for b in bins[gap]]


def _put(bins: dict, gaps: list[int], gap: int, lengths: tuple[int, ...], n: int) -> None:
    if gap not in bins:
        bisect.insort(gaps, gap)
    bins[gap].append([lengths, n])


def runs(groups: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For ranks of a length from ``first`` on: the sequence of the first, and the offset there."""
    out, placed, base = [], defaultdict(int), 0
    for lengths, n in groups:
        offset = 0
        for length in lengths:
            out.append((length, placed[length], base, offset))
            placed[length] += n
            offset += length
        base += n
    out.sort()
    return dict(zip(("length", "first", "base", "offset"), np.array(out, dtype=np.int64).reshape(-1, 4).T))


def place(made: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, part_rows: int = PART_ROWS) -> DataFrame:
    """``made`` (a table of pieces) with sequence_id and offset.

    Every piece is placed once; offsets of a sequence leave no gap; an empty table stays empty.
    """
    sizes = dict(made.groupBy("length").count().toPandas().itertuples(index=False))  # capacity rows at most
    parts = [max(PARTS, -(-int(sizes.get(k + 1, 0)) // part_rows)) for k in range(capacity)]
    most = max(parts)
    parts_of = F.element_at(F.split(F.lit(",".join(map(str, parts))), ",").cast("array<long>"), F.col("length").cast("int"))
    part = F.pmod(F.xxhash64("doc_id", "piece"), parts_of).cast("int")
    counts = made.select("length", part.alias("part")).groupBy("length", "part").count().toPandas()  # capacity x PARTS rows, and one for each PART_ROWS pieces
    counts = counts.sort_values(["length", "part"])
    before = (counts.groupby("length")["count"].cumsum() - counts["count"]).to_numpy(dtype=np.int64)
    key = (counts["length"] * most + counts["part"]).to_numpy(dtype=np.int64)
    at = runs(plan({int(k): int(v) for k, v in sorted(sizes.items())}, capacity, rounds))
    start = (at["length"] << 44) + at["first"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length = frame["length"].to_numpy(dtype=np.int64)
            rank = frame.pop("__rank").to_numpy(dtype=np.int64) - 1
            rank = rank + before[np.searchsorted(key, length * most + frame.pop("__part").to_numpy(dtype=np.int64))] if len(frame) else rank
            k = np.searchsorted(start, (length << 44) + rank, side="right") - 1
            yield frame.assign(sequence_id=at["base"][k] + rank - at["first"][k], offset=at["offset"][k])

    ranked = made.withColumn("__part", part).withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__part").orderBy("doc_id", "piece")))
    schema = made.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInPandas(run, schema)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all rows of ``docs`` with their places.

    A null text counts as empty: one piece that holds the end id. Texts longer
    than ``capacity`` are cut, others stay whole. Repeated rows are packed as
    often as they stand. Other columns of ``docs`` are not carried along.
    """
    return place(materialise(pieces(docs, doc_id, text, path, capacity)), capacity)


def op8_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
