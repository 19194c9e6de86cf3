"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel counts common subsequences of four characters of two words; one that spreads over ``s`` characters weighs ``DECAY**s``,
and up to ``GAP`` characters may be inserted, so ``idi*ot`` keeps most of what it shares with ``idiot``. A word carries marks at both
ends; words over 30 characters are taken in overlapping windows, and single letters in a row (``i d i o t``) also as one word.

Training is on the words of labelled sentences: a sentence has its document's label, a clean document's words are all clean, and
of a toxic document's words the one with the highest decision value is its witness; witnesses and the machine are fitted in
turn. Decisions are linear in the landmarks' kernel values, so they fold into one weight for each hashed subsequence: scoring a
word costs ten look-ups for each character. A document's score is the calibrated decision of its worst word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import map_batches, mix

LENGTH, GAP, DECAY = 4, 2, 0.7
BITS = 18
WINDOW, STRIDE = 30, 15
SHAPES = [(0, *rest) for rest in combinations(range(1, LENGTH + GAP), LENGTH - 1)]
INSERTED = "abcdefghijklmnopqrstuvwxyz0123456789"
DECAYS = DECAY ** np.arange(1, 17)
STRIP = ".,;:!?\"'()[]{}<>%*$#&|~`^_/\\+=@-"
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")
LONG_RUN = re.compile(r"(\w)\1{2,}")
#: Distinct words whose decisions a task remembers.
CACHE_WORDS = 300_000
#: Labelled documents of each label that training reads at most, chosen by a hash of their ids.
MAX_LABELLED = 1500


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    words = low.split()
    if " " in low:
        words += ["".join(m.split()) for m in SPACED.findall(low)]
    return words


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, hashed subsequence, weight) of all words, each pair once and sorted, weights scaled to a kernel of 1 with itself."""
    size = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(words)), size)
    packed = []
    for shape in SHAPES:
        at = np.flatnonzero(np.arange(len(code)) + shape[-1] < end)
        h = np.zeros(len(at), np.uint64)
        for o in shape:
            h = h * np.uint64(0x100000001B3) + code[at + o] + np.uint64(1)
        key = (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)
        packed.append((owner[at] << (BITS + 4)) | (key << 4) | shape[-1])
    packed = np.sort(np.concatenate(packed))
    pair = packed >> 4
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    weight = np.add.reduceat(DECAYS[packed & 15], first) if len(pair) else np.zeros(0)
    where, key = pair[first] >> BITS, pair[first] & ((1 << BITS) - 1)
    norm = np.sqrt(np.bincount(where, weight**2, minlength=len(words)))
    return where, key, weight / norm[where]


def windows(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Marked windows of words, and the word each comes from. No character is left out."""
    out, of = [], []
    for i, w in enumerate(words):
        w = w.strip(STRIP)
        if not w:
            continue
        forms = [w]
        if not w.isalnum() or LONG_RUN.search(w):  # also without inner marks and with long runs of a letter as one
            forms.append(LONG_RUN.sub(r"\1", "".join(filter(str.isalnum, w))))
        for form in forms:
            form = f"\x02{form}\x03"
            for a in range(0, max(1, len(form) - WINDOW + STRIDE), STRIDE) if len(form) > WINDOW else (0,):
                out.append(form[a : a + WINDOW])
                of.append(i)
    return out, np.array(of, np.int64)


class Machine:
    """Decisions of words: weights of hashed subsequences, a bias, and the calibration of a document's worst word."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset

    def decide(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), -np.inf)
        parts, of = windows(words)
        if parts:
            where, key, weight = subsequences(parts)
            value = np.bincount(where, weight * self.weights[key], minlength=len(parts)) + self.bias
            np.maximum.at(out, of, value)
        return np.maximum(out, min(self.bias, -1.0))

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * worst + self.offset)))


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps; the last weight is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        active = y * (z @ w) < 1
        za, c = z[active], cost[active]
        new = np.linalg.solve(ridge + 2 * (za * c[:, None]).T @ za, 2 * (za * c[:, None]).T @ y[active])
        done = np.allclose(new, w, atol=1e-6)
        w = new
        if done:
            break
    return w


def _kernel(parts: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of words with landmarks, over the landmarks' subsequences."""
    lw, lk, lv = subsequences(landmarks)
    columns, index = np.unique(lk, return_inverse=True)
    dense = np.zeros((len(columns), len(landmarks)), np.float32)
    np.add.at(dense, (index, lw), lv)
    out = np.zeros((len(parts), len(landmarks)), np.float32)
    for a in range(0, len(parts), 4000):
        some = parts[a : a + 4000]
        where, key, weight = subsequences(some)
        pos = np.minimum(np.searchsorted(columns, key), len(columns) - 1)
        hit = columns[pos] == key
        w, p, v = where[hit], pos[hit], weight[hit].astype(np.float32)
        for b in range(0, len(w), 20_000):
            rows = w[b : b + 20_000]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            out[a + rows[first]] += np.add.reduceat(dense[p[b : b + 20_000]] * v[b : b + 20_000, None], first, axis=0)
    return out


def fit(texts: list[str | None], toxic: list[int], landmarks: int = 160, rounds: int = 4, seed: int = 7) -> Machine:
    """Fits a machine on labelled documents in the driver; its caller bounds their number. Without documents of both labels it
    holds everything for clean."""
    docs, same = [], {}
    for text in texts:
        found, _ = windows(list(dict.fromkeys(words_of(text))))
        docs.append([same.setdefault(w, w) for w in dict.fromkeys(found)])  # one string for each distinct word
    y = np.array(toxic)
    clean = Counter(w for d, t in zip(docs, toxic, strict=True) if not t for w in d)
    suspects = [[w for w in d if w not in clean and len(w) > LENGTH] for d, t in zip(docs, toxic, strict=True) if t]
    suspects = [s for s in suspects if s]
    if not suspects or not clean:
        return Machine(np.zeros(1 << BITS), -1.0, 1.0, -3.0)
    rng = np.random.default_rng(seed)
    pool = sorted(w for w in clean if len(w) > LENGTH)
    sampled = [pool[i] for i in rng.permutation(len(pool))[:20_000]]
    # First witnesses: the word of a toxic document that most toxic documents share, unless many words come with it in just the
    # same documents, as in copies; documents without one wait for the next turn.
    holders: dict[str, list[int]] = {}
    for i, some in enumerate(suspects):
        for w in set(some):
            holders.setdefault(w, []).append(i)
    alike = Counter(map(tuple, holders.values()))
    share = {w: len(h) / alike[tuple(h)] for w, h in holders.items()}
    best = [max(some, key=lambda w: (share[w], w)) for some in suspects]
    strong = Counter({w: round(n) for w, n in share.items() if n >= max(3, len(suspects) / 100)})
    witness = [w for w in best if share[w] >= 2] or [w for w in best if share[w] >= max(map(share.__getitem__, best))]
    hard: list[str] = []
    machine = None
    for _ in range(rounds):
        positive = Counter(witness) | strong
        for w, n in positive.most_common(48):  # what inserting a character makes of them
            for place in rng.integers(2, max(3, len(w) - 1), 2).tolist():
                positive[w[:place] + INSERTED[rng.integers(len(INSERTED))] + w[place:]] += max(1, n // 12)
        top = [w for w, _ in positive.most_common(landmarks // 2)]
        marks = list(dict.fromkeys([*top, *hard[: landmarks // 4], *sampled]))[:landmarks]
        parts = [*positive, *dict.fromkeys(hard + sampled)]
        target = np.array([1.0] * len(positive) + [-1.0] * (len(parts) - len(positive)))
        count = np.array([positive[w] for w in positive], float)
        cost = np.concatenate([np.sqrt(count) * 4, np.ones(len(parts) - len(positive))])
        kmm = _kernel(marks, marks).astype(float)
        value, vector = np.linalg.eigh((kmm + kmm.T) / 2 + 1e-6 * np.eye(len(marks)))
        root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
        w = _svm(_kernel(parts, marks) @ root, target, cost)
        alpha = root @ w[:-1]
        lw, lk, lv = subsequences(marks)
        weights = np.zeros(1 << BITS)
        np.add.at(weights, lk, lv * alpha[lw])
        machine = Machine(weights, float(w[-1]), 1.0, 0.0)
        # The next witnesses, and the clean words that come nearest to them.
        decided = {}
        for words in (pool, sorted({x for s in suspects for x in s})):
            for a in range(0, len(words), 4000):
                some = words[a : a + 4000]
                where, key, weight = subsequences(some)
                decided.update(zip(some, (np.bincount(where, weight * weights[key], minlength=len(some)) + w[-1]).tolist(), strict=True))
        witness = [max(s, key=lambda x: (decided[x], x)) for s in suspects]
        hard = sorted(pool, key=lambda x: -decided[x])[:3000]
    worst = np.array([max((decided.get(x, min(machine.bias, -1.0)) for x in d), default=min(machine.bias, -1.0)) for d in docs])
    machine.slope, machine.offset = _platt(worst, y)
    return machine


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with Platt's smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        r = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(r * x * x).sum() + 1e-3, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, **options) -> Machine:
    """Fits on at most ``max_labelled`` documents of each label, those with the smallest hashes of their ids; rows without a label
    are left out, and of repeated labels of a document the larger counts."""
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = marked.where("_toxic = 1").orderBy(*order).limit(max_labelled).unionByName(marked.where("_toxic = 0").orderBy(*order).limit(max_labelled))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    found = sorted((r[0], r[1], r[2]) for r in rows.select("_id", F.coalesce("_text", F.lit("")), "_toxic").collect())
    return fit([r[1] for r in found], [r[2] for r in found], **options)


def _worst(machine: Machine):
    """A function from texts to the decisions of their worst words, which remembers words it has met."""
    known: dict[str, float] = {}
    floor = min(machine.bias, -1.0)

    def worst(texts: list[str | None]) -> np.ndarray:
        found = [set(words_of(t)) for t in texts]
        if len(known) > CACHE_WORDS:
            known.clear()
        fresh = list(set().union(*found).difference(known))
        known.update(zip(fresh, machine.decide(fresh).tolist(), strict=True))
        return np.array([max(map(known.__getitem__, f), default=floor) for f in found])

    return worst


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``score``, 0 to 1, from its whole text alone. Null and empty texts, and texts without words,
    get the score of the lowest decision; ids may repeat; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worst = _worst(machine)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.record_batch([part.column(0), pa.array(machine.probability(worst(part.column(1).to_pylist())), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.transform(map_batches, run, "id long, score double").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, machine: Machine, reject_from: float, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score is under ``reject_from``."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worst = _worst(machine)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield part.filter(pa.array(machine.probability(worst(part.column(place).to_pylist())) < reject_from))

    return docs.transform(map_batches, run, docs.schema)
