"""Toxicity scores over deobfuscated text.

A noisy channel writes words with look-alike signs, split by signs or spaces,
or with repeated letters.  Each doubtful word becomes a lattice of what its
characters may stand for, and a Viterbi search finds the likeliest reading
under a character trigram model counted over the whole corpus.  Short words in a
row share one lattice, in which each space may be kept or dropped.  Restored words
then give evidence: log odds of word beginnings in toxic against other labelled
documents.  A logistic curve over the strongest evidence gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import ready

#: Symbols of the character model: 0 is a word's border, the last one any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåçèéêëìíîïñòóôõöøùúûüýÿßœæ"
BASE = 64
OTHER = BASE - 1
SYMBOL = {c: i + 1 for i, c in enumerate(LETTERS)} | {" ": 0}

#: What a sign may stand for (fixed values).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t",
    "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
    "(": "c", "<": "c", "#": "h", "%": "x", "£": "l", "¡": "i", "*": "aeiou",
}
#: Signs that may stand between the letters of one word.
BETWEEN = set(".-_*~/\\,:'’`·|+^")

SUBSTITUTED, DROPPED, REPEATED = -2.5, -2.0, -1.5
#: Two or more words of at most three characters in a row.
SHORT_RUN = re.compile(r"(?<!\S)\S{1,3}(?:\s+\S{1,3})+(?!\S)")
DOUBLE = re.compile(r"(.)\1")
#: What may be written at a place of a lattice: letters, cost, and the letters' symbols.
Arc = tuple[str, float, tuple[int, ...]]
#: Words, runs and evidence that a task remembers at most.
REMEMBERED = 200_000

#: Labelled rows that the classifier is fitted on at most: those whose ids hash lowest.
SAMPLE = 20_000
#: Shortest and longest word beginning, and the least rows that count as evidence.
SHORTEST, LONGEST, LEAST = 4, 8, 5
#: Weight of the prior in a feature's odds, in rows.
PRIOR = 5.0
#: Score from which a document counts as toxic.
THRESHOLD = 0.7


def _codes() -> np.ndarray:
    """Symbol of every character of the basic plane."""
    codes = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            codes[i] = SYMBOL.get(low if len(low) == 1 else c, OTHER)
    return codes


_CODES: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    if not _CODES:
        _CODES.append(_codes())
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _CODES[0][np.minimum(points, 0xFFFF)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a task's texts."""
    total = np.zeros(BASE ** 3, np.int64)
    for batch in batches:
        for text in batch.column(0):
            if text.is_valid:
                s = symbols(" " + text.as_py() + " ").astype(np.int64)
                g = (s[:-2] * BASE + s[1:-1]) * BASE + s[2:] if len(s) > 2 else s[:0]
                total += np.bincount(g, minlength=BASE ** 3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])],
                                     names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities [before last, last, next] counted over all of ``docs``.

    What reaches the driver is bounded by the alphabet: 64 cubed counts.
    """
    rows = (docs.select("text").mapInArrow(_count, "gram int, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros(BASE ** 3)
    counts[rows["gram"].to_numpy(int)] = rows["n"].to_numpy(float)
    counts = counts.reshape(BASE, BASE, BASE)
    pairs = counts.sum(0)
    single = (pairs.sum(0) + 1) / (pairs.sum() + BASE)
    double = (pairs + 20 * single) / (pairs.sum(1, keepdims=True) + 20)
    triple = (counts + 20 * double[None]) / (counts.sum(2, keepdims=True) + 20)
    return np.log(triple).astype(np.float32)


@lru_cache(maxsize=10_000)
def arc(out: str, cost: float) -> Arc:
    return out, cost, tuple(SYMBOL.get(c, OTHER) for c in out)


@lru_cache(maxsize=10_000)
def arcs_of(c: str, n: int, inside: bool) -> tuple[Arc, ...]:
    """What ``n`` times one character may stand for, with other characters on both sides or not."""
    arcs: list[Arc] = []
    if c.isalpha():
        arcs.append(arc(c if n == 1 else c * 2, 0.0 if n < 3 else REPEATED * (n - 2) ** 0.5))
        if n > 1:
            arcs.append(arc(c, REPEATED * (n - 1) ** 0.5))
    for x in LOOKALIKES.get(c, ""):
        arcs.append(arc(x, SUBSTITUTED))
        if n > 1:
            arcs.append(arc(x * 2, SUBSTITUTED))
    if c in BETWEEN and inside or not arcs:
        arcs.append(arc("", DROPPED))
    return tuple(arcs)


def readings(word: str) -> list[tuple[Arc, ...]]:
    """The lattice: per run of one character, what it may stand for and its cost."""
    runs: list[tuple[str, int]] = []
    last, n = word[:1], 0
    for c in word:
        if c == last:
            n += 1
        else:
            runs.append((last, n))
            last, n = c, 1
    if n:
        runs.append((last, n))
    end = len(runs) - 1
    return [arcs_of(c, n, 0 < i < end) for i, (c, n) in enumerate(runs)]


def likeliest(lattice: list[tuple[Arc, ...]], model: list[float]) -> str:
    """What the best path through a lattice writes, from border to border.

    Places without choice, where one state is left, need no table of states.
    """
    states: dict[int, tuple[float, str]] = {}
    x, s, path, alone = 0, 0.0, "", True
    for arcs in lattice:
        if alone and len(arcs) == 1:
            out, cost, codes = arcs[0]
            s += cost
            for c in codes:
                x = x * BASE + c
                s += model[x]
                x %= BASE * BASE
            path += out
            continue
        new: dict[int, tuple[float, str]] = {}
        for state, (score, before) in [(x, (s, path))] if alone else states.items():
            for out, cost, codes in arcs:
                x, s = state, score + cost
                for c in codes:
                    x = x * BASE + c
                    s += model[x]
                    x %= BASE * BASE
                if x not in new or new[x][0] < s:
                    new[x] = (s, before + out)
        states, alone = new, len(new) == 1
        if alone:
            (x, (s, path)), = new.items()
    if alone:
        return path
    return max(((s + model[x * BASE], p) for x, (s, p) in states.items()), key=lambda t: t[0])[1]


def decode(word: str, model: list[float]) -> str:
    """Likeliest letters behind a lower-case word."""
    return likeliest(readings(word), model)


def decode_run(words: list[str], model: list[float]) -> list[str]:
    """Likeliest words behind lower-case words in a row, whose spaces may be dropped."""
    lattice: list[tuple[Arc, ...]] = []
    for i, word in enumerate(words):
        if i:
            lattice.append((arc(" ", 0.0), arc("", DROPPED)))
        core = word if word.isalnum() else trimmed(word)
        if core:
            before, _, after = word.partition(core)
            ends = [[(*[arc(x, SUBSTITUTED) for x in LOOKALIKES.get(c, "")], arc("", 0.0)) for c in part]
                    for part in (before, after)]
            lattice += [*ends[0], *readings(core), *ends[1]]
        else:
            lattice += [(*[a for a in arcs if a[0]], arc("", DROPPED)) for arcs in readings(word)]
    return likeliest(lattice, model).split()


def trimmed(word: str) -> str:
    """The word without signs at its ends that stand for no letter there."""
    i, j = 0, len(word)
    while j and not word[j - 1].isalnum() and word[j - 1] not in "$@":
        j -= 1
    while j > 1 and word[j - 1] in "$@" and word[j - 2] in "$@":
        j -= 1
    while i < j and not word[i].isalnum() and word[i] not in "$@":
        i += 1
    return word[i:j]


@dataclass
class Reader:
    """Restores words; equal words are decoded once per task."""

    model: np.ndarray
    known: dict[str, str] = field(default_factory=dict)
    runs: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.flat = self.model.ravel().tolist()

    def restore(self, word: str) -> str:
        if word in self.known:
            return self.known[word]
        core = word if word.isalpha() else trimmed(word)
        if core.isalpha() and not DOUBLE.search(core):
            out = core
        elif not any(c.isalpha() or c in LOOKALIKES for c in core):
            out = ""
        else:
            out = decode(core, self.flat)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known[word] = out
        return out

    def joined(self, run: str) -> list[str]:
        if run in self.runs:
            return self.runs[run]
        out = decode_run(run.split(), self.flat)
        if len(run) <= 40:
            if len(self.runs) > REMEMBERED:
                self.runs.clear()
            self.runs[run] = out
        return out

    def words(self, text: str | None) -> set[str]:
        """Distinct restored words, also those that short words in a row stand for."""
        low, known = (text or "").lower(), self.known
        found = {known[w] if w in known else self.restore(w) for w in set(low.split())}
        for run in SHORT_RUN.findall(low):
            found.update(self.joined(run))
        found.discard("")
        return found


def beginnings(word: str) -> Iterator[str]:
    """A word's features: its beginnings, and itself with an end mark."""
    for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield word[:n]
    if len(word) >= 3:
        yield word + "$"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _features(model: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a feature, toxic and other, of a task's rows."""
    reader, counts = Reader(model), (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            counts[bool(toxic)].update({f for w in reader.words(text.as_py()) for f in beginnings(w)})
    names = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([counts[1][f] for f in names], pa.int64()),
         pa.array([counts[0][f] for f in names], pa.int64())], names=["feature", "t", "n"])


@dataclass
class Classifier:
    """Counts of evidence and the curve over it; bounded by the fitted sample."""

    counts: dict[str, tuple[int, int]]
    toxic: int
    other: int
    curve: tuple[float, float] = (1.0, -4.0)
    weights: dict[str, float] = field(default_factory=dict)
    seen: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def weight(self, t: int, n: int) -> float:
        share = (self.toxic + 1) / (self.toxic + self.other + 2)
        return math.log((t + PRIOR * share) / (n + PRIOR * (1 - share)) * (1 - share) / share)

    def strongest(self, words: set[str], own: int | None = None) -> tuple[float, list[str]]:
        """Sum of the three strongest words' evidence, and the words with any.

        own: the label of a row that is among the counted ones; its own share
        is taken out.
        """
        found = []
        for word in words:
            best = self.seen.get(word) if own is None else None
            if best is None:
                best = self.evidence(word, own)
            if best > 1:
                found.append((best, word))
        found.sort(reverse=True)
        return sum(x for x, _ in found[:3]), [w for _, w in found]

    def evidence(self, word: str, own: int | None) -> float:
        """That of a word's strongest feature; remembered for rows that are not among the counted ones."""
        best = 0.0
        for f in beginnings(word) if word[:SHORTEST] in self.heads else ():
            if own is None:
                best = max(best, self.weights.get(f, 0.0))
            elif c := self.counts.get(f):
                t, n = c[0] - (own == 1), c[1] - (own == 0)
                if t + n >= LEAST:
                    best = max(best, self.weight(t, n))
        if own is None:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            self.seen[word] = best
        return best

    def __post_init__(self) -> None:
        self.weights = {f: w for f, (t, n) in self.counts.items() if (w := self.weight(t, n)) > 1}
        self.heads = {f.rstrip("$")[:SHORTEST] for f in self.counts}

    def score(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a * evidence + b))))


def _evidence(model: np.ndarray, classifier: Classifier,
              batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader(model)
    for batch in batches:
        labels = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([classifier.strongest(reader.words(t.as_py()), y)[0]
                       for t, y in zip(batch.column(0), labels)], pa.float64()),
             pa.array(labels, pa.int32())], names=["x", "y"])


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on evidence, by Newton steps with a small ridge."""
    a, b = 0.5, -2.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        w = p * (1 - p)
        g = np.array([((y - p) * x).sum() - 0.01 * a, (y - p).sum() - 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample: int = SAMPLE) -> Classifier:
    """Fitted on at most ``sample`` labelled rows; ``labels`` has doc_id, toxic.

    Rows without label or id are not learnt from.  Without toxic rows there is
    no evidence and every score is low.
    """
    chosen = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic")
              .distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "text", F.col("toxic").cast("int").alias("toxic"))
    sums = {r["toxic"]: r["count"] for r in chosen.groupBy(
        (F.col("toxic") == 1).cast("int").alias("toxic")).count().collect()}
    counted = (rows.mapInArrow(partial(_features, model), "feature string, t long, n long")
               .groupBy("feature").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
               .where(f"t + n >= {LEAST}"))
    toxic, other = sums.get(1, 0), sums.get(0, 0)
    share = (toxic + 1) / (toxic + other + 2)
    odds = math.e * share / (1 - share)
    kept = counted.where(F.col("t") + PRIOR * share > odds * (F.col("n") + PRIOR * (1 - share))).collect()
    out = Classifier({r["feature"]: (r["t"], r["n"]) for r in kept}, toxic, other)
    if toxic and other:
        seen = rows.mapInArrow(partial(_evidence, model, out), "x double, y int").toPandas()
        out.curve = curve(seen["x"].to_numpy(float), (seen["y"].to_numpy() == 1).astype(float))
    return out


def _score(model: np.ndarray, classifier: Classifier,
           batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader(model)
    for batch in batches:
        scores, words = [], []
        for text in batch.column(1):
            x, found = classifier.strongest(reader.words(text.as_py()))
            scores.append(classifier.score(x))
            words.append(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores, pa.float64()), pa.array(words, pa.list_(pa.string()))],
            names=["doc_id", "score", "evidence"])


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1) and evidence.

    evidence lists the restored words that speak for label 1, strongest first.
    Null and empty texts have no evidence and get the curve's lowest score.
    ``labels`` (doc_id, toxic) is what may be learnt from; labels of ids that
    are not in ``docs`` add nothing.  Repeated rows are scored alike.  Only
    doc_id and text are read, and only text is an input of the score.
    """
    ready(docs.sparkSession)
    model = character_model(docs)
    classifier = fit(docs, labels, model, sample)
    return docs.select("doc_id", "text").mapInArrow(
        partial(_score, model, classifier), "doc_id long, score double, evidence array<string>")
