"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items (questions and answers) are normalised to lower-case words, and
words to numbers. Every run of 13 words of an item holds one of its anchors, runs of five
words that begin at each ninth word; anchors, and items of fewer than 13 words as a whole, are the
patterns of one automaton over word numbers, so that it has fewer nodes than the benchmark has words. Each document is
normalised the same way and scanned once; around an anchor the neighbouring
words are compared with the item's. Hits are mapped from words to the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, materialise, table, worker_state

WINDOW = 13
#: Words of an anchor, at most.
ANCHOR = 5
#: An automaton holds patterns of at most so many benchmark bytes (some 450 MB of a worker); a larger benchmark is scanned for in several passes.
AUTOMATON_BYTES = 32_000_000
#: Bytes to a word's bytes or to spaces: lower-cased, all ASCII but 0-9 and a-z blank.
WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in FOLD)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, as UTF-8; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


def parts_of(items: Iterator[tuple[str, str | None]], most: int = AUTOMATON_BYTES) -> Iterator[list[tuple[str, str]]]:
    """Runs of items (id, text) of bounded size; at least one, even if empty."""
    part, held = [], 0
    for item_id, text in items:
        part.append((str(item_id), text or ""))
        held += len(part[-1][1])
        if held >= most:
            yield part
            part, held = [], 0
    yield part


def original_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in code points of the original text, of each word."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    blank = np.frombuffer(raw.tobytes().translate(WORDS), dtype=np.uint8) == 32
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    point = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])  # code points before each byte
    return point[np.flatnonzero(edge == -1)], point[np.flatnonzero(edge == 1)]


def scanner(items: list[tuple[str, str]], n: int = WINDOW):
    """text -> (number of words, ranges of words that were hit, ids of the items found)."""
    import ahocorasick

    m = min(ANCHOR, n)
    stride = n - m + 1
    vocabulary: dict[bytes, int] = {}
    sequences: dict[bytes, list[str]] = {}  # items of the same words are one
    for item_id, text in items:
        numbers = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], dtype=np.int32)
        if len(numbers):
            sequences.setdefault(numbers.tobytes(), []).append(item_id)
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    flat, owner, ids = [np.full(n, -1, dtype=np.int32)], [np.full(n, -1, dtype=np.int32)], []
    places: dict[tuple, list[int]] = {}
    at = n
    for raw, own in sequences.items():
        numbers = np.frombuffer(raw, dtype=np.int32)
        size = len(numbers)
        words = numbers.tolist()
        for a in range(0, size - m + 1, stride) if size >= n else (0,):
            places.setdefault(tuple(words[a : a + m] if size >= n else words), []).append(at + a)
        flat += [numbers, np.full(n, -1, dtype=np.int32)]
        owner.append(np.full(size + n, len(ids), dtype=np.int32))
        ids.append(own)
        at += size + n
    joined, owners = np.concatenate(flat), np.concatenate(owner)
    whole = np.array([len(s) // 4 for s in sequences], dtype=np.int64)
    for key, found in places.items():
        machine.add_word(key, (len(key), np.array(found, dtype=np.int64)))
    if places:
        machine.make_automaton()
    number = vocabulary.get
    around = np.arange(1, stride)

    def scan(text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        words = words_of(text)
        if not words or not places:
            return len(words), [], set()
        sequence = [number(w, 0) for w in words]  # 0 is in no item
        doc, cover, found = None, None, set()
        for end, (length, spots) in machine.iter(tuple(sequence)):
            start = end - length + 1
            if doc is None:
                doc = np.concatenate([np.full(n, -2), sequence, np.full(n, -2)])
                cover = np.zeros(len(words) + 1, dtype=np.int64)
            left = (joined[spots[:, None] - around] == doc[n + start - around]).cumprod(axis=1).sum(axis=1)
            right = (joined[spots[:, None] + length - 1 + around] == doc[n + end + around]).cumprod(axis=1).sum(axis=1)
            size = whole[owners[spots]]
            good = np.where(size >= n, (left + length + right >= n) & (length == m), size == length)
            if good.any():
                left, right = np.where(size >= n, left, 0)[good], np.where(size >= n, right, 0)[good]
                cover[start - left.max()] += 1
                cover[end + right.max() + 1] -= 1
                for k in np.unique(owners[spots[good]]).tolist():
                    found.update(ids[k])
        if not found:
            return len(words), [], found
        hit = np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]]).astype(np.int8)
        edge = np.diff(hit)
        return len(words), list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())), found

    return scan


def find(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", text: str = "text", n: int = WINDOW, most: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with n_words, n_items, items (sorted ids), hits (word index ranges, end exclusive), spans and n_hit.

    ``spans`` are the hits as code points of the original text. Null and empty texts have no words and no hits; empty benchmark items are
    ignored, repeated ones count once for each id; columns of ``docs`` with the names of results are replaced.
    """
    kept = docs.drop("n_words", "n_hit", "items", "hits", "spans", "n_items")
    ranges = F.lit(None).cast("array<array<long>>")
    out = kept.withColumns({"n_words": F.lit(0).cast("long"), "hits": ranges, "spans": ranges, "items": F.lit(None).cast("array<string>")})
    rows = benchmark.select(F.col(item).cast("string"), item_text).orderBy(item, item_text).toLocalIterator()
    for k, part in enumerate(parts_of(((r[0], r[1]) for r in rows), most)):  # each of bounded size
        held = docs.sparkSession.sparkContext.broadcast(part)
        out = (materialise(out) if k else out).mapInPandas(_pass(held, text, n), out.schema)
    size = F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h[1] - h[0]), F.lit(0).cast("long"))
    return out.withColumns({"n_hit": size, "n_items": F.size("items").cast("long")})


def _pass(held, text: str, n: int):
    name = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = worker_state()  # one automaton for all tasks of a worker
        if state.get("scanner", (None,))[0] != name:
            state["scanner"] = (name, scanner(held.value, n))
        scan = state["scanner"][1]
        for frame in frames:
            n_words, hits, spans, items = [], [], [], []
            for t, had, known in zip(frame[text], frame["hits"], frame["items"]):
                t = t if isinstance(t, str) else None
                size, found, ids = scan(t)
                found = _union(found, had if had is not None else ())
                n_words.append(size)
                hits.append([list(r) for r in found])
                items.append(sorted(ids.union(known if known is not None else ())))
                if found:
                    first, last = original_spans(t)
                    spans.append([[int(first[a]), int(last[b - 1])] for a, b in found])
                else:
                    spans.append([])
            yield frame.assign(n_words=n_words, hits=hits, spans=spans, items=items)

    return run


def _union(ranges: list[tuple[int, int]], more) -> list[tuple[int, int]]:
    """Sorted ranges that cover the same as all of these."""
    out: list[tuple[int, int]] = []
    for a, b in sorted([*ranges, *((int(a), int(b)) for a, b in more)]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contaminated(found: DataFrame):
    """At least a twentieth of the words was hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op5_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    joined = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(joined, 256).alias("items_sha256"), contaminated(found).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH b AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, least(n, {WINDOW}) AS m, array_to_string(w[i:i + least(n, {WINDOW}) - 1], ' ') AS s
  FROM b, unnest(range(1, n - least(n, {WINDOW}) + 2)) AS t(i)),
d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
dw AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM d, (SELECT DISTINCT m FROM bw), unnest(range(1, n - m + 2)) AS t(i)),
h AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, s)),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, i + k AS p FROM h, unnest(range(0, m)) AS u(k)) GROUP BY doc_id),
hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
