"""Language identification as inference of a multilingual mixture.

Each language is a distribution over hashed letter trigrams. A document's
words come from a mixture of languages: expectation-maximisation estimates its
proportions from the words' trigram likelihoods. The language set is chosen by
penalised likelihood (half the log of the word count for each language),
dropping the smallest share and estimating again while that pays. The likelihood
is concave in the proportions, so its slope bounds what more rounds could gain: estimation ends
when that is next to nothing, and is not begun for documents where one language cannot be beaten.
The language with the largest share is the prediction, its share the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, fold_id, table

UNKNOWN = "und"
SIZE = 1 << 16
#: The model is fitted on about so many labelled documents of each language at most, picked by a hash of the id.
SAMPLE_DOCS = 5000
SMOOTH = 0.5
#: Rounds before the first look, rounds at most, and the log likelihood that more of them could still gain.
FIRST_ROUNDS, ROUNDS, CLOSE = 8, 500, 0.01
PARCEL = 1_000_000
#: ASCII letters are lower-cased, other ASCII is blank.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in FOLD)
_LETTERS = re.compile(r"[^\W\d_]").finditer


def has_letter(text: str | None) -> bool:
    return isinstance(text, str) and any(m[0].isalpha() for m in _LETTERS(text))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all words with a space at each end; the first trigram of each word; the first word of each text."""
    lines = [b" ".join(t.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()) for t in texts]
    data = np.frombuffer(b" " + b" ".join(lines) + b"  ", dtype=np.uint8)
    x = data.astype(np.uint32)
    h = ((x[:-2] * np.uint32(0x1F123BB5) + x[1:-1]) * np.uint32(0x5BD1E995) + x[2:]) * np.uint32(0x9E3779B1)
    blank = data == 32
    inside = ~blank[1:-1]  # a trigram whose middle is a blank belongs to no word
    ids = (h >> np.uint32(16))[inside]
    start = blank[:-2][inside]
    first_of_word = np.flatnonzero(start)
    words = np.cumsum([0, *(line.count(b" ") + bool(line) for line in lines)])
    return ids, first_of_word, words


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their log probabilities of trigrams, from the rows of ``docs`` with a language and text."""
    rows = docs.select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(key).alias("h")).filter("l IS NOT NULL AND t IS NOT NULL")
    share = 1 << 30
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return [], np.zeros((0, SIZE), dtype=np.float32)
    bound = F.lit(share)
    for name, n in counts.items():
        if n > most:
            bound = F.when(F.col("l") == name, F.lit(int(share * most / n))).otherwise(bound)
    sample = rows.filter(F.pmod("h", F.lit(share)) < bound)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, own in frame.groupby("l"):
                total = np.zeros(SIZE, dtype=np.int64)
                for part in parcels(own["t"]):
                    total += np.bincount(grams(part)[0], minlength=SIZE)
                at = np.flatnonzero(total)
                yield pd.DataFrame({"l": name, "gram": at, "n": total[at]})

    found = sample.mapInPandas(count, "l string, gram int, n long").groupBy("l", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts)
    n = np.zeros((len(names), SIZE))
    n[[names.index(x) for x in found["l"]], found["gram"]] = found["n"]
    return names, np.log((n + SMOOTH) / (n.sum(axis=1, keepdims=True) + SMOOTH * SIZE)).astype(np.float32)


def parcels(texts, size: int = PARCEL) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def estimate(like: np.ndarray, first: np.ndarray, allowed: np.ndarray, share: np.ndarray | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each document, and how much more rounds could add to it at most.

    ``like``: likelihoods of words, ``allowed``: languages of documents, ``share``: where to begin.
    """
    size = np.diff(np.append(first, len(like)))
    share = allowed / allowed.sum(axis=1, keepdims=True) if share is None else share
    total, gap = np.zeros(len(size)), np.zeros(len(size))
    open_, own = np.arange(len(size)), like  # documents that go on, and their words
    for k in range(rounds + 1):
        n = size[open_]
        q = own * np.repeat(share[open_], n, axis=0)
        sums = np.maximum(q.sum(axis=1, keepdims=True), 1e-30)
        begin = np.cumsum(n) - n
        total[open_] = np.add.reduceat(np.log(sums[:, 0]), begin)
        slope = np.add.reduceat(own / sums, begin)  # of the log likelihood by each proportion
        gap[open_] = np.maximum((slope * allowed[open_]).max(axis=1) - n, 0)
        if k == rounds:
            break
        share[open_] = np.add.reduceat(q / sums, begin) / n[:, None]
        if rounds > FIRST_ROUNDS and k % 8 == 7:
            on = gap[open_] > CLOSE
            if not on.all():
                own, open_ = own[np.repeat(on, n)], open_[on]
                if not len(open_):
                    break
    return share, total, gap


def infer(texts: list[str], log_p: np.ndarray) -> np.ndarray:
    """Language proportions of texts that have a letter each; zero for languages outside the chosen set."""
    ids, first_gram, first_word = grams(texts)
    log_like = np.stack([np.add.reduceat(p[ids], first_gram) for p in log_p], axis=1)
    top = log_like.max(axis=1, keepdims=True)
    like = np.exp(log_like - top).astype(np.float32)
    first, size = first_word[:-1], np.diff(first_word)
    single = np.add.reduceat((log_like - top).astype(np.float64), first)  # each language alone
    n_lang = len(log_p)
    penalty = 0.5 * np.log(np.maximum(size, 2))
    chosen = np.eye(n_lang)[single.argmax(axis=1)]
    best = single.max(axis=1) - penalty
    share, total, gap = estimate(like, first, np.ones((len(texts), n_lang)), rounds=FIRST_ROUNDS)
    open_ = np.flatnonzero(total + gap - 2 * penalty > best)  # a set of two or more can only win there
    allowed, share = np.ones((len(open_), n_lang)), share[open_]
    words = np.concatenate([np.arange(first_word[d], first_word[d + 1]) for d in open_]) if len(open_) else first[:0]
    while len(open_):
        share, total, _ = estimate(like[words], np.cumsum(size[open_]) - size[open_], allowed, share)
        value = total - penalty[open_] * allowed.sum(axis=1)
        win = value > best[open_]
        best[open_[win]], chosen[open_[win]] = value[win], share[win]
        keep = allowed.sum(axis=1) > 2
        words = words[np.repeat(keep, size[open_])]
        open_, allowed, share = open_[keep], allowed[keep], share[keep]
        if len(open_):
            allowed[np.arange(len(open_)), np.where(allowed > 0, share, np.inf).argmin(axis=1)] = 0
            share = allowed / allowed.sum(axis=1, keepdims=True)
    return chosen


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and languages (``name:share``, largest first).

    Null texts and texts without a letter are ``und`` with score 0, as are all
    texts if nothing was learned; equal shares go to the alphabetically first
    language. Rows stay as they are; columns with the names of results are replaced.
    """
    names, log_p = model
    out = docs.drop("lang_pred", "score", "languages").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "languages": F.lit("")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].to_list()
            at = [i for i, t in enumerate(texts) if has_letter(t)] if names else []
            lang_pred, score, languages = [UNKNOWN] * len(texts), [0.0] * len(texts), [""] * len(texts)
            done = 0
            for part in parcels(texts[i] for i in at):
                for i, share in zip(at[done : done + len(part)], infer(part, log_p)):
                    order = np.argsort(-share, kind="stable")
                    lang_pred[i], score[i] = names[order[0]], float(min(1.0, share[order[0]]))
                    languages[i] = ",".join(f"{names[k]}:{share[k]:.3f}" for k in order if share[k] > 0)
                done += len(part)
            yield frame.assign(lang_pred=lang_pred, score=score, languages=languages)

    return out.mapInPandas(run, out.schema)


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(fold_id(F.col("doc_id"), 5) != 0))
    rows = docs.select("doc_id", (fold_id(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "languages")
