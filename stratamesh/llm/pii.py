"""Personal data: patterns, and a skip-chain conditional random field.

Patterns find the base spans. Mentions (tokens with an @, runs of digits)
are the nodes of a conditional random field for each document: node potentials
from shape and context, chain potentials between neighbours, skip potentials
between distant mentions that repeat or resemble each other. Base spans are
observed; loopy belief propagation carries their labels to mentions that the
patterns miss, such as a phone number given again without its prefix.
All potentials are trained together, by pseudo-likelihood, on a bounded sample of
documents that the patterns label; the features that decide the patterns are withheld from half
of the nodes, and mentions that repeat or resemble a labelled one without a label of their own are left out.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

KINDS = ("email", "ip", "card", "phone")
#: At most so many documents with mentions train the field.
SAMPLE_DOCS = 4000
#: Mentions that training takes at most, of whole documents.
SAMPLE_MENTIONS = 20 * SAMPLE_DOCS
#: A mention without a base span becomes one at this marginal probability.
CERTAIN = 0.9
BUCKETS = 32
#: Messages may take so many rounds and four for each node; they have settled when none changes by more.
ROUNDS, SETTLED = 100, 1e-9
DAMPING = 0.5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").match
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a run of digits is looked at once: no start inside it can do better
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NUMBER = re.compile(r"(?<![\w@.])[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9]){6,}(?![\w@])")
_PART = re.compile(r"[^\x20]+")
_AT = re.compile(r"[^\s@<>(),;]+@[^\s@<>(),;]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = []
    at, after = text.find("@"), 0
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN(text, at)):
            out.append((0, start, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label): base spans, and candidates that overlap none, by start; label 0 is open, 1 + kind observed."""
    found = [(a, b, 1 + k) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    open_ = [m.span() for m in _AT.finditer(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            if sum(c.isdigit() for c in m[0]) <= 19:
                open_.append(m.span())
            else:  # several numbers in a row
                open_ += [(m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m[0]) if sum(c.isdigit() for c in p[0]) >= 7]
    starts, ends, last = [a for a, _ in taken], [0], 0
    for _, b in taken:
        ends.append(max(ends[-1], b))
    for a, b in sorted(open_):
        if a >= max(last, ends[bisect.bisect_left(starts, b)]):  # after all base spans that start before its end
            found.append((a, b, 0))
            last = b
    return sorted(found)


def keys(mention: str) -> list[str]:
    """What repeated (first) and similar (second) mentions have in common."""
    if "@" in mention:
        name = mention.strip(".,:;!?\"'").lower()
        return ["@" + name, "@~" + name.split("@")[0]]
    digits = _NOT_DIGIT.sub("", mention)
    return ["#" + digits, "#~" + digits[-7:]]


def node_features(text: str, start: int, end: int) -> np.ndarray:
    """Shape (withheld at will in training) and context of a mention."""
    m = text[start:end]
    digits = _NOT_DIGIT.sub("", m)
    n = len(digits)
    before = text[max(0, start - 40) : start].lower().split()
    out = np.zeros(12 + BUCKETS, dtype=np.float32)
    out[:12] = [1, "@" in m, m.startswith("+"), "." in m.partition("@")[2], m.count(".") == 3 and "@" not in m, 13 <= n <= 19 and luhn(digits), n < 9, 9 <= n < 13, n >= 13, " " in m, "-" in m, "(" in m]
    if before:
        out[12 + zlib.crc32(before[-1].strip(".,:;").encode("utf-8", "surrogatepass")) % BUCKETS] = 1
    return out


#: Features that decide the patterns.
DECIDING = [2, 3, 4, 5]


def links(texts_keys: list[list[str]]) -> list[tuple[int, int, int]]:
    """(node, node, sort) of one document: 0 neighbours, 1 repeated, 2 similar; each mention joins the last one of its key."""
    out = [(i, i + 1, 0) for i in range(len(texts_keys) - 1)]
    seen: dict[str, int] = {}
    for j, own in enumerate(texts_keys):
        met = set()
        for sort, key in enumerate(own, 1):
            if (i := seen.get(key)) is not None and i not in met:
                out.append((i, j, sort))
                met.add(i)
            seen[key] = j
    return out


#: Steps of the training, their length and momentum, and the weight of the penalty on squares.
STEPS, RATE, MOMENTUM, PENALTY = 400, 0.5, 0.9, 1e-4


def train(docs: list[tuple[str, list[tuple[int, int, int]]]]) -> dict[str, np.ndarray]:
    """Log potentials of nodes, and of neighbours, repeated and similar mentions, from texts with their mentions.

    They are fitted together: the likelihood of each node's label given those of the nodes it is linked with. An open
    mention counts as no personal data, unless it repeats or resembles a labelled one: then it says nothing. Of the
    repeated mentions every other one is shown as a similar one, since it is one too and there are few others.
    """
    n_labels = len(KINDS) + 1
    x, y, beside, repeats = [], [], [], 0
    for text, nodes in docs:
        own = links([keys(text[a:b]) for a, b, _ in nodes])
        silent = {u for i, j, sort in own if sort for u, v in ((i, j), (j, i)) if not nodes[u][2] and nodes[v][2]}
        around = np.zeros((len(nodes), 4, n_labels), dtype=np.float32)  # labels before, after, repeated, similar
        for i, j, sort in own:
            if sort == 1:
                sort, repeats = 1 + repeats % 2, repeats + 1
            for u, v, place in ((j, i, sort + bool(sort)), (i, j, sort + 1)):
                if v not in silent:
                    around[u, place, nodes[v][2]] += 1
        for i, (a, b, label) in enumerate(nodes):
            if i not in silent:
                x.append(node_features(text, a, b))
                y.append(label)
                beside.append(around[i])
    node, pair = np.zeros((12 + BUCKETS, n_labels)), np.zeros((3, n_labels, n_labels))
    if not x:
        node[0, 0] = 4.0
        return {"node": node, "pair": pair}
    xs, ys, near = np.array(x, dtype=np.float64), np.eye(n_labels)[np.array(y)], np.array(beside, dtype=np.float64)
    hidden = np.random.default_rng(9).random(len(xs)) < 0.5
    xs[np.ix_(hidden, DECIDING)] = 0
    ahead = [np.zeros_like(node), np.zeros_like(pair)]
    for _ in range(STEPS):
        z = xs @ node + near[:, 0] @ pair[0] + near[:, 1] @ pair[0].T + near[:, 2] @ pair[1] + near[:, 3] @ pair[2]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        off = (ys - p / p.sum(axis=1, keepdims=True)) / len(xs)
        same = [near[:, 2].T @ off, near[:, 3].T @ off]
        slope = [xs.T @ off - PENALTY * node, np.stack([near[:, 0].T @ off + off.T @ near[:, 1], *(m + m.T for m in same)]) - PENALTY * pair]
        ahead = [MOMENTUM * v + RATE * g for v, g in zip(ahead, slope)]
        node, pair = node + ahead[0], pair + ahead[1]
    return {"node": node, "pair": pair}


def propagate(node: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Marginals by loopy max-stable sum-product until messages settle; ``node``: log potentials, ``edges``: rows of (node, node, sort).

    Where loops keep messages from settling, it ends after ``rounds``, or once each has had time to cross all nodes.
    """
    n, k = node.shape
    if len(edges):
        src = np.concatenate([edges[:, 0], edges[:, 1]])
        dst = np.concatenate([edges[:, 1], edges[:, 0]])
        table_ = np.concatenate([pair[edges[:, 2]], pair[edges[:, 2]].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))])
        message = np.zeros((len(src), k))
        for _ in range(rounds or ROUNDS + 4 * n):
            total = node.copy()
            np.add.at(total, dst, message)
            cavity = total[src] - message[back]
            new = cavity[:, :, None] + table_
            top = new.max(axis=1, keepdims=True)
            new = np.log(np.exp(new - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - message).max()
            message = DAMPING * message + (1 - DAMPING) * new
            if change < SETTLED:
                break
        node = node.copy()
        np.add.at(node, dst, message)
    p = np.exp(node - node.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def spans(text: str | None, model: dict[str, np.ndarray]) -> tuple[list, list]:
    """Base spans and all spans of one text, each as (kind, start, end) by kind and start."""
    if not isinstance(text, str) or not text:
        return [], []
    base = base_spans(text)
    if "@" not in text and not _DIGIT.search(text):
        return base, base
    nodes = mentions(text, base)
    if all(label for *_, label in nodes):
        return base, base
    x = np.array([node_features(text, a, b) for a, b, _ in nodes], dtype=np.float64)
    potential = x @ model["node"]
    # What a kind cannot do without: @, three dots, the check digit, nine digits.
    potential[x[:, 1] == 0, 1] = potential[x[:, 4] == 0, 2] = potential[x[:, 5] == 0, 3] = -30.0
    potential[(x[:, 6] == 1) | (x[:, 1] == 1), 4] = -30.0
    for i, (*_, label) in enumerate(nodes):
        if label:  # observed
            potential[i] = -30.0
            potential[i, label] = 30.0
    own = [keys(text[a:b]) for a, b, _ in nodes]
    marginal = propagate(potential, np.array(links(own), dtype=np.int64).reshape(-1, 3), model["pair"])
    more = [(int(m.argmax()) - 1, a, b) for m, (a, b, label) in zip(marginal, nodes) if not label and m.argmax() and m.max() >= CERTAIN]
    return base, sorted(base + more)


def model_of(docs: DataFrame, text: str = "text", most: int = SAMPLE_DOCS, most_mentions: int = SAMPLE_MENTIONS) -> dict[str, np.ndarray]:
    """The field trained on at most ``most`` of the documents with an @ or seven digits, picked by a hash of the text.

    If these have more than ``most_mentions`` mentions, only the first documents by the hash that have no more together, but at least one.
    """
    rich = docs.select(F.col(text).alias("t")).filter(F.col("t").contains("@") | F.col("t").rlike("[0-9]([^0-9]?[0-9]){6}"))
    picked = rich.select(F.xxhash64("t").alias("h")).distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if picked is None:
        return train([])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # only what training needs, cut to the mentions' surroundings
        for frame in frames:
            out = []
            for h, t in zip(frame["h"], frame["t"]):
                for a, b, label in mentions(t, base_spans(t)):
                    out.append((h, a, b, label, t[max(0, a - 40) : b]))
            yield pd.DataFrame(out, columns=["h", "a", "b", "label", "near"])

    rows = rich.withColumn("h", F.xxhash64("t")).filter(F.col("h") <= picked).dropDuplicates(["h"]).mapInPandas(run, "h long, a int, b int, label int, near string")
    by: dict[int, list] = defaultdict(list)
    rows = materialise(rows)
    sizes, total, last = rows.groupBy("h").count().orderBy("h").collect(), 0, None  # ``most`` at most
    for h, n in sizes:
        total += n
        if total > most_mentions and last is not None:
            break
        last = h
    for h, a, b, label, near in rows.filter(F.col("h") <= last).orderBy("h", "a").collect() if sizes else []:
        by[h].append((a, b, label, near))
    texts = []
    for _, nodes in sorted(by.items()):
        whole, at = "", []
        for a, b, label, near in nodes:
            at.append((len(whole) + len(near) - (b - a), len(whole) + len(near), label))
            whole += near + "\n"
        texts.append((whole, at))
    return train(texts)


def find(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with base and spans, arrays of (kind, start, end); both are empty for null and empty texts.

    Rows stay as they are; columns of these two names are replaced.
    """
    kind = "array<struct<kind:int,start:int,end:int>>"
    out = docs.drop("base", "spans").withColumns({"base": F.lit(None).cast(kind), "spans": F.lit(None).cast(kind)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [spans(t, model) for t in frame[text]]
            named = [[[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in pair] for pair in both]
            yield frame.assign(base=[p[0] for p in named], spans=[p[1] for p in named])

    return out.mapInPandas(run, out.schema)


def redact(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with each span of its texts replaced by the kind in angle brackets; spans that overlap become one, of the first kind."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for t in frame[text]:
                found = sorted((a, b, k) for k, a, b in spans(t, model)[1])
                if found:
                    parts, last = [], 0
                    for a, b, k in found:
                        if a >= last:
                            parts += [t[last:a], f"<{KINDS[k].upper()}>"]
                        last = max(last, b)
                    t = "".join(parts) + t[last:]
                out.append(t)
            yield frame.assign(**{text: out})

    return docs.mapInPandas(run, docs.schema)


def _said(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def op9_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = model_of(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, t in zip(frame["doc_id"], frame["text"]):
                base, found = spans(t, model)
                n = [sum(k == kind for k, *_ in base) for kind in range(4)]
                out.append((key, *n, hashlib.sha256(_said(base).encode()).hexdigest(), _said(found), len(found)))
            yield pd.DataFrame(out, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
