"""Toxic documents and spans by a linear-chain conditional random field.

Chains are whole sentences; every word is in one, and all chains of a batch are walked together. A word's features are its hashed core and beginnings, and the cores
before and after it. Labels come by document, so tokens are labelled first: a word whose core or beginning is over-represented in toxic documents, beyond chance, is toxic where
it stands in a toxic document; all other tokens are clean. The field is fitted to those tags by AdaGrad on the log likelihood,
from a bounded number of labelled rows (``most`` of :func:`fit_toxicity`).

With two states, forward and backward messages are single odds, and a word's marginal is the product of the two. A
document's score is a logistic function of its largest marginal and its expected number of toxic words, fitted on
labelled documents; the offending spans are the words whose marginal is one half or more, neighbours joined.

Cases: a null or empty text has no words and gets the score of a text without toxic words; a null label is not learned from, a repeated one counts once, and if
one class is missing every score is the share of label 1 (one half without labels); repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .packing import chunks
from .quality import MAX_TRAIN, labelled_sample
from .text import tidy, words_of

BUCKETS = 1 << 16
STEPS = 80
RATE = 0.5
DECAY = 1e-4
#: Chains without a toxic token that the field is fitted from, for each one with; and at least this many.
CLEAN_RATIO, CLEAN_LEAST = 4, 2000
#: A core or beginning is toxic if it stands in at least so many toxic documents, its share of toxic documents is this many times theirs of all,
#: and that is no chance finding among all of them, by this margin in the logarithm.
LEAST_DOCS, LEAST_LIFT, MARGIN = 3, 3.0, 0.0

_EDGES = b".,;:!?\"'()[]{}<>|*#$%&@^~=+-_/\\"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Lengths of the word beginnings that are features and units: inflected forms share them.
BEGINNINGS = (5, 6, 7)
#: Features of the word itself; two more are its core as the neighbour before and after.
_OWN = 1 + len(BEGINNINGS)


def core_of(word: bytes) -> str:
    """The word without signs at its edges."""
    return (word.strip(_EDGES) or word).decode(errors="replace").lower()


def units_of(core: str) -> list[str]:
    """A core and its beginnings, marked; a beginning as long as the core is left out."""
    return ["=" + core, *(f"{n}{core[:n]}" for n in BEGINNINGS if len(core) > n)]


def features(vocabulary: list[bytes]) -> np.ndarray:
    """For each word the buckets of its core, its beginnings, and its core as a neighbour before and after."""
    out = np.empty((len(vocabulary), _OWN + 2), np.int64)
    for k, word in enumerate(vocabulary):
        core = core_of(word)
        out[k] = [crc32(x.encode()) % BUCKETS for x in ("=" + core, *(f"{n}{core[:n]}" for n in BEGINNINGS), "<" + core, ">" + core)]
    return out


def chains(row: np.ndarray, word: np.ndarray, ends_sentence: np.ndarray) -> np.ndarray:
    """Index of the first word of each chain."""
    n = len(row)
    if not n:
        return np.empty(0, np.int64)
    first = np.ones(n, bool)
    first[1:] = (row[1:] != row[:-1]) | ends_sentence[word[:-1]]
    return np.flatnonzero(first)


@dataclass
class Field:
    """Feature weights, and transition weights as exp(w) by [before, after]; ``start`` is the first word's bias."""

    weights: np.ndarray
    transition: np.ndarray
    start: float

    def emissions(self, word: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of each word by its own features and its neighbours'."""
        by_word = self.weights[buckets]
        own = by_word[:, :_OWN].sum(1)[word]
        before, after = np.zeros(len(word)), np.zeros(len(word))
        before[1:], after[:-1] = by_word[word[:-1], _OWN], by_word[word[1:], _OWN + 1]
        before[first] = 0
        after[first[1:] - 1] = 0
        return np.clip(own + before + after, -30, 30)

    def messages(self, odds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward odds, with the word's own, and backward odds, without."""
        t = self.transition
        forward, backward = odds.copy(), np.ones(len(odds))
        size = np.diff(np.append(first, len(odds)))
        order = np.argsort(-size, kind="stable")
        at, size = first[order], size[order]
        forward[at] *= np.exp(self.start)
        last = at + size - 1
        steps = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(steps), "left")  # chains longer than s
        for s in range(1, steps):
            i = at[: alive[s]] + s
            before = forward[i - 1]
            forward[i] *= (t[0, 1] + before * t[1, 1]) / (t[0, 0] + before * t[1, 0])
            j = last[: alive[s]] - s
            after = odds[j + 1] * backward[j + 1]
            backward[j] = (t[1, 0] + after * t[1, 1]) / (t[0, 0] + after * t[0, 1])
        return forward, backward

    def marginals(self, word: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        forward, backward = self.messages(np.exp(self.emissions(word, buckets, first)), first)
        both = forward * backward
        return both / (1 + both)


def fit_field(word: np.ndarray, buckets: np.ndarray, first: np.ndarray, tags: np.ndarray, steps: int = STEPS) -> Field:
    """Maximises the tags' log likelihood, less ``DECAY`` times the squared weights."""
    field = Field(np.zeros(BUCKETS), np.ones((2, 2)), 0.0)
    n = len(word)
    inner = np.ones(n, bool)
    inner[first] = False
    follow = np.flatnonzero(inner)  # words that have one before them in their chain
    seen, seen_t = np.full(BUCKETS, 1e-4), np.full(5, 1e-4)
    log_t = np.zeros((2, 2))
    observed = np.array([[np.sum((tags[follow - 1] == a) & (tags[follow] == b)) for b in (0, 1)] for a in (0, 1)], float)
    for _ in range(steps):
        odds = np.exp(field.emissions(word, buckets, first))
        forward, backward = field.messages(odds, first)
        both = forward * backward
        error = tags - both / (1 + both)
        own = sum(np.bincount(buckets[word, k], error, BUCKETS) for k in range(_OWN))
        own += np.bincount(buckets[word[follow - 1], _OWN], error[follow], BUCKETS) + np.bincount(buckets[word[follow], _OWN + 1], error[follow - 1], BUCKETS)
        # Expected pairs: message up to the word before, the transition, and all that comes after.
        into = odds[follow] * backward[follow]
        pair = np.stack([np.ones(len(follow)) * field.transition[0, 0], into * field.transition[0, 1], forward[follow - 1] * field.transition[1, 0], forward[follow - 1] * into * field.transition[1, 1]])
        expected = (pair / pair.sum(0)).sum(1).reshape(2, 2)
        g = own - DECAY * n * field.weights / 100
        gt = np.append((observed - expected).ravel(), error[first].sum())
        seen += g * g
        seen_t += gt * gt
        field.weights += RATE * g / np.sqrt(seen)
        step = RATE * gt / np.sqrt(seen_t)
        log_t += step[:4].reshape(2, 2)
        field.transition = np.exp(np.clip(log_t - log_t[0, 0], -10, 10))
        field.start = float(np.clip(field.start + step[4], -10, 10))
    return field


@dataclass
class ToxicityModel:
    """The field, and the logistic weights of a constant, the largest marginal's log odds, and the log of the expected number."""

    field: Field | None
    logistic: np.ndarray

    def marginals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The row and the marginal of every word, in order."""
        row, word, vocabulary = words_of(texts)
        word = word.astype(np.int64)
        if self.field is None or not len(row):
            return row, np.zeros(len(row))
        ends = np.fromiter((w[-1] in b".!?" for w in vocabulary), bool, len(vocabulary))
        return row, self.field.marginals(word, features(vocabulary), chains(row, word, ends))

    def scores(self, row: np.ndarray, marginal: np.ndarray, rows: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(row, marginal, rows) @ self.logistic, -30, 30)))


def summary(row: np.ndarray, marginal: np.ndarray, rows: int) -> np.ndarray:
    """What a document's score is made from. Both parts leave out marginals below 1 %, so that length alone isn't toxic."""
    most = np.full(rows, 0.01)
    strong = marginal > 0.01
    np.maximum.at(most, row[strong], np.minimum(marginal[strong], 0.99))
    number = np.bincount(row[strong], marginal[strong], rows)
    return np.column_stack([np.ones(rows), np.log(most / (1 - most)), np.log1p(number)])


def toxic_units(row: np.ndarray, unit: np.ndarray, kinds: int, toxic: np.ndarray) -> np.ndarray:
    """Which units count as toxic, by the documents they stand in."""
    pair = np.unique(row * max(kinds, 1) + unit)
    of, what = pair // max(kinds, 1), pair % max(kinds, 1)
    bad = np.bincount(what[toxic[of]], minlength=kinds)
    every = np.bincount(what, minlength=kinds)
    prior = float(np.clip(toxic.mean(), 1e-6, 1 - 1e-6))
    share = np.clip(bad / np.maximum(every, 1), 1e-9, 1 - 1e-9)
    # How unlikely so many toxic documents of these are by chance, as a log, against as many tries as there are words.
    surprise = every * (share * np.log(share / prior) + (1 - share) * np.log((1 - share) / (1 - prior)))
    least = np.log(max(kinds, 1)) + MARGIN
    chosen = (bad >= LEAST_DOCS) & (share >= min(LEAST_LIFT * prior, 0.5 + prior / 2)) & (surprise > least)
    # Near copies of one toxic document share all their words: documents count for as many as their words, taken together, make.
    edges = np.searchsorted(of, np.arange(len(toxic) + 1))
    for k in np.flatnonzero(chosen).tolist():
        mine = of[what == k]
        words = [what[edges[d] : edges[d + 1]] for d in mine[toxic[mine]].tolist()]
        distinct = len(np.unique(np.concatenate(words))) / np.mean([len(w) for w in words])
        chosen[k] = surprise[k] * min(1.0, distinct / len(words)) > least
    return chosen


def fit(texts: pa.Array, toxic: np.ndarray, seed: int = 5, clean_ratio: int = CLEAN_RATIO) -> ToxicityModel:
    """A model of labelled texts; deterministic for the same rows in the same order. For ``clean_ratio`` see :func:`fit_toxicity`."""
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    constant = np.array([np.log(share / (1 - share)), 0.0, 0.0])
    if len(set(toxic.tolist())) < 2:
        return ToxicityModel(None, constant)
    toxic = toxic > 0
    row, word, vocabulary = words_of(texts)
    word = word.astype(np.int64)
    # Words count by their cores, so that punctuation doesn't split them, and by their beginnings.
    number: dict[str, int] = {}
    units = [[number.setdefault(u, len(number)) for u in units_of(core_of(w))] for w in vocabulary]
    size = np.fromiter(map(len, units), np.int64, len(units))
    start, flat = np.cumsum(size) - size, np.concatenate(units)
    pair = np.unique(row * len(vocabulary) + word)
    each = size[pair % len(vocabulary)]
    at = np.arange(each.sum()) + np.repeat(start[pair % len(vocabulary)] - (np.cumsum(each) - each), each)
    chosen = toxic_units(np.repeat(pair // len(vocabulary), each), flat[at], len(number), toxic)
    bad = np.logical_or.reduceat(chosen[flat], start)
    tags = (bad[word] & toxic[row]).astype(float)
    first = chains(row, word, np.fromiter((w[-1] in b".!?" for w in vocabulary), bool, len(vocabulary)))
    size = np.diff(np.append(first, len(word)))
    number = np.add.reduceat(tags, first) if len(first) else np.empty(0)
    hit, miss = np.flatnonzero(number > 0), np.flatnonzero(number == 0)
    rng = np.random.default_rng(seed)
    miss = rng.permutation(miss)[: max(CLEAN_LEAST, clean_ratio * len(hit))]
    mine = np.sort(np.concatenate([hit, miss]))
    begins = np.cumsum(size[mine]) - size[mine]
    take = np.arange(size[mine].sum()) + np.repeat(first[mine] - begins, size[mine])
    buckets = features(vocabulary)
    model = ToxicityModel(fit_field(word[take], buckets, begins, tags[take]), constant)
    x = summary(row, model.field.marginals(word, buckets, first), len(toxic))
    model.logistic = _logistic(x, toxic.astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def offending(text: str, marginal: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Spans (code points, end exclusive) of words whose marginal is ``least`` or more, neighbours joined."""
    if not len(marginal) or marginal.max() < least:
        return []
    out: list[tuple[int, int]] = []
    before = -2
    for k, m in enumerate(_WORD.finditer(text)):
        if marginal[k] >= least:
            out.append((out.pop()[0], m.end()) if before == k - 1 and out else (m.start(), m.end()))
            before = k
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: F.Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN, clean_ratio: int = CLEAN_RATIO) -> ToxicityModel:
    """A model of at most ``most`` labelled rows, those with the smallest hashes of their ids; toxic words that stand in fewer than ``LEAST_DOCS`` toxic ones of them aren't learned.

    All chains with a toxic word are learned from, and a seeded choice of ``clean_ratio`` times as many without, at least ``CLEAN_LEAST``.
    """
    table = labelled_sample(docs, labels, label, learn, [text_col], id_col, most)
    texts = table.column(text_col).combine_chunks()
    return fit(texts if len(table) else pa.array([], pa.string()), table.column("__label").to_numpy(), clean_ratio=clean_ratio)


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``score`` and ``spans`` (array of start, end), which replace columns of those names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "spans")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts = part.column(1)
                row, marginal = shared.value.marginals(texts)
                score = shared.value.scores(row, marginal, len(texts))
                spans: list[list[dict[str, int]]] = [[] for _ in range(len(texts))]
                for k in np.unique(row[marginal >= 0.5]).tolist():
                    a, b = np.searchsorted(row, [k, k + 1])
                    spans[k] = [{"start": s, "end": e} for s, e in offending(texts[k].as_py(), marginal[a:b])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(spans, span)], names=["row", "score", "spans"])

    used = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"))
    of = ArrayType(StructType().add("start", "integer").add("end", "integer"))
    schema = StructType().add("row", used.schema["row"].dataType).add("score", "double", False).add("spans", of)
    return used.mapInArrow(tidy(run), schema).select("row.*", "score", "spans")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    model = fit_toxicity(docs, labels, fold != 0)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans")
    return with_toxicity(docs, model, keep=["doc_id"]).select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans)
