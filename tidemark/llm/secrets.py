"""Secret scans: base patterns, then automata inferred from what they found.

One pass over the texts finds the base spans and all candidates: runs of
credential characters, as long as the shortest labelled credential, that are not
inside a base span.  Of the
labelled credentials a bounded sample is spelled in character classes and put
into a prefix tree per kind; states whose futures do not differ significantly
are merged, which leaves a small probabilistic automaton.  Every candidate is
scored by its likelihood under the automata against that of ordinary candidates,
a chain of symbol pairs counted over all of them, and one that is as likely as
labelled credentials are becomes a ``format`` span.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import ready, stored

#: Base kinds in the order that spans of one start follow (fixed values).
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Shortest credential of an assignment, hence shortest candidate.
SHORTEST = 6
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")

#: Labelled credentials of a kind that are learnt from at most.
SAMPLE = 2_000
#: Significance of a difference between two states.
ALPHA = 0.05
#: Share of held-back credentials that may score below the threshold.
BELOW = 0.05

FOUND = ("doc_id long, kinds array<string>, starts array<int>, ends array<int>, secrets array<string>,"
         " candidate_starts array<int>, candidates array<string>")
PAIRS = "pair string, n long"
SPANS = "doc_id long, kinds array<string>, starts array<int>, ends array<int>, scores array<double>"


#: The symbol of each ASCII character: digit, hex letter or other letter of either case; signs stand for themselves.
SYMBOLS = {i: "0" if c.isdigit() else "a" if c in "abcdef" else "z" if c.islower()
           else "A" if c in "ABCDEF" else "Z" if c.isupper() else c for i, c in enumerate(map(chr, range(128)))}


def spelled(text: str) -> str:
    """One symbol per character; credentials and candidates are ASCII."""
    return text.translate(SYMBOLS)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, secret) of the base patterns, ordered by start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign", m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= SHORTEST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    out += [(m.start(), m.end(), "hex", m.group()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, spans: list[tuple[int, int, str, str]]) -> list[tuple[int, str]]:
    """Runs of credential characters, but those inside one base span."""
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][0] <= m.start():
            reach = max(reach, spans[at][1])
            at += 1
        if reach < m.end():
            out.append((m.start(), m.group()))
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, ints = pa.list_(pa.string()), pa.list_(pa.int32())
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py() or ""
            spans = base_spans(text)
            rest = candidates(text, spans)
            rows.append(([s[2] for s in spans], [s[0] for s in spans], [s[1] for s in spans], [s[3] for s in spans],
                         [c[0] for c in rest], [c[1] for c in rest]))
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(list(x), t) for x, t in zip(columns, (words, ints, ints, words, ints, words))]],
            names=["doc_id", "kinds", "starts", "ends", "secrets", "candidate_starts", "candidates"])


@dataclass
class Automaton:
    """States with counts of what follows; built as a prefix tree, then merged."""

    follow: list[dict[str, int]] = field(default_factory=lambda: [{}])
    count: list[Counter] = field(default_factory=lambda: [Counter()])
    ends: list[int] = field(default_factory=lambda: [0])

    def add(self, word: str) -> None:
        q = 0
        for c in word:
            self.count[q][c] += 1
            if c not in self.follow[q]:
                self.follow[q][c] = len(self.follow)
                self.follow.append({})
                self.count.append(Counter())
                self.ends.append(0)
            q = self.follow[q][c]
        self.ends[q] += 1

    def total(self, q: int) -> int:
        return self.ends[q] + sum(self.count[q].values())

    def differ(self, n: int, of: int, m: int, among: int) -> bool:
        """Hoeffding's bound on two observed shares."""
        if not of or not among:
            return False
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(of) + 1 / math.sqrt(among))
        return abs(n / of - m / among) > bound

    def compatible(self, a: int, b: int) -> bool:
        """No significant difference in any common future."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self.total(x), self.total(y)
            if self.differ(self.ends[x], n, self.ends[y], m):
                return False
            for c in self.count[x].keys() | self.count[y].keys():
                if self.differ(self.count[x][c], n, self.count[y][c], m):
                    return False
                if c in self.follow[x] and c in self.follow[y]:
                    todo.append((self.follow[x][c], self.follow[y][c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree below ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            self.ends[x] += self.ends[y]
            self.count[x].update(self.count[y])
            for c, z in self.follow[y].items():
                if c in self.follow[x]:
                    todo.append((self.follow[x][c], z))
                else:
                    self.follow[x][c] = z

    def merged(self) -> "Automaton":
        """Each state next to the settled ones joins a compatible one or settles."""
        settled, queue = [0], deque((0, c) for c in sorted(self.follow[0]))
        while queue:
            q, c = queue.popleft()
            state = self.follow[q].get(c)
            if state is None or state in settled:
                continue
            for s in settled:
                if self.compatible(s, state):
                    self.follow[q][c] = s
                    self.fold(s, state)
                    queue.extend((s, x) for x in sorted(self.follow[s]) if self.follow[s][x] not in settled)
                    break
            else:
                settled.append(state)
                queue.extend((state, x) for x in sorted(self.follow[state]))
        number = {s: i for i, s in enumerate(settled)}
        return Automaton([{c: number[z] for c, z in self.follow[s].items() if z in number} for s in settled],
                         [self.count[s] for s in settled], [self.ends[s] for s in settled])

    def likelihood(self, word: str) -> float:
        """Log likelihood of the word and its end, smoothed a little."""
        q, out = 0, 0.0
        for c in word:
            out += math.log((self.count[q][c] + 0.01) / (self.total(q) + 0.2))
            q = self.follow[q].get(c, q)
        return out + math.log((self.ends[q] + 0.01) / (self.total(q) + 0.2))


@dataclass
class Formats:
    """Automata of the labelled kinds, the background, and a threshold for each."""

    automata: dict[str, Automaton] = field(default_factory=dict)
    background: Counter = field(default_factory=Counter)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, kind: str, word: str) -> float:
        """Log odds a character against a chain of ordinary candidates' symbols."""
        s = spelled(word)
        plain = sum(math.log((self.background[x + y] + 0.5) / (self.background[x] + 12))
                    for x, y in zip("^" + s, s + "$"))
        return (self.automata[kind].likelihood(s) - plain) / (len(s) + 1)

    def judge(self) -> Callable[[str], float | None]:
        """The highest score of a spelled word if it reaches its kind's threshold, else null.

        All logarithms are taken here, once for each pair and each state's symbol.
        """
        symbols = sorted({*SYMBOLS.values(), "$"})
        plain = {x + y: math.log((self.background[x + y] + 0.5) / (self.background[x] + 12))
                 for x in ["^", *symbols] for y in symbols}
        kinds = []
        for kind, a in self.automata.items():
            steps = [{c: (math.log((a.count[q][c] + 0.01) / (a.total(q) + 0.2)), a.follow[q].get(c, q))
                      for c in symbols} for q in range(len(a.follow))]
            ends = [math.log((a.ends[q] + 0.01) / (a.total(q) + 0.2)) for q in range(len(a.follow))]
            kinds.append((steps, ends, self.thresholds[kind]))

        def best(word: str) -> float | None:
            ordinary, n, top = sum(map(plain.__getitem__, map(add, "^" + word, word + "$"))), len(word) + 1, None
            for steps, ends, threshold in kinds:
                q, out = 0, 0.0
                for c in word:
                    share, q = steps[q][c]
                    out += share
                score = (out + ends[q] - ordinary) / n
                if score >= threshold and (top is None or score > top):
                    top = score
            return top

        return best


def symbol_pairs(word: str) -> Iterator[str]:
    """Neighbouring symbols of a spelled word, its borders included."""
    s = spelled(word)
    return map("".join, zip("^" + s, s + "$"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair counts of a task's candidates."""
    count: Counter = Counter()
    for batch in batches:
        for word in batch.column(0).to_pylist():
            count.update(symbol_pairs(word))
    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())],
                                     names=["pair", "n"])


def pair_counts(words: DataFrame) -> dict[str, int]:
    """Symbol pairs of all distinct words; bounded by the square of the symbols."""
    rows = words.distinct().mapInArrow(_pairs, PAIRS).groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return {r["pair"]: r["n"] for r in rows}


def learnt(labelled: dict[str, list[str]], pairs: dict[str, int]) -> Formats:
    """Every second credential is learnt from; the others set the threshold."""
    out = Formats(background=Counter(pairs))
    for pair, n in pairs.items():
        out.background[pair[0]] += n
    for kind, words in labelled.items():
        if len(words) < 20:
            continue
        tree = Automaton()
        for word in words[::2]:
            tree.add(spelled(word))
        out.automata[kind] = tree.merged()
        held = sorted(out.score(kind, w) for w in words[1::2])
        out.thresholds[kind] = max(0.5, held[int(len(held) * BELOW)])
    return out


def _judge(formats: Formats, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # many words are spelled alike
    best = lru_cache(400_000)(formats.judge())
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            spans = [(a, b, k, 1.0) for a, b, k in zip(r["starts"], r["ends"], r["kinds"])]
            for at, word in zip(r["candidate_starts"], r["candidates"]):
                score = best(spelled(word))
                if score is not None:
                    spans.append((at, at + len(word), "format", score))
            spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
            rows.append(([s[2] for s in spans], [s[0] for s in spans], [s[1] for s in spans], [s[3] for s in spans]))
        columns = list(zip(*rows)) or [()] * 4
        types = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(list(x), t) for x, t in zip(columns, types)]],
            names=["doc_id", "kinds", "starts", "ends", "scores"])


def secret_spans(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id and its spans as parallel arrays.

    kinds, starts, ends (code points, end exclusive) and scores (1 for base spans,
    log odds a character for ``format`` spans), by start, then kind.  Null and
    empty texts have none.  Equal texts have equal spans.  A kind with fewer than
    20 labelled credentials gets no automaton.  Only doc_id and text are read.
    """
    ready(docs.sparkSession)
    found = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, FOUND), "secrets")
    pairs = found.select(F.explode(F.arrays_zip("kinds", "secrets")).alias("x")).select("x.kinds", "x.secrets")
    labelled = {}
    for kind in KINDS[:3]:
        rows = (pairs.where(F.col("kinds") == kind).select("secrets").distinct()
                .orderBy(F.xxhash64("secrets"), "secrets").limit(sample).collect())
        labelled[kind] = [r["secrets"] for r in rows]
    pairs = pair_counts(found.select(F.explode("candidates").alias("c")))
    return found.mapInArrow(partial(_judge, learnt(labelled, pairs)), SPANS)


def written(kinds: list[str], starts: list[int], ends: list[int]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in zip(kinds, starts, ends))


def digest(kinds: list[str], starts: list[int], ends: list[int]) -> str:
    return hashlib.sha256(written(kinds, starts, ends).encode()).hexdigest()
