"""Secret scan by grammar inference.

Base patterns give labelled credentials. For each kind a prefix tree of a bounded
sample of them (the `sample` distinct values with the smallest hashes, over all
documents) is generalised into a probabilistic automaton over characters:

1. States of one depth merge where end and transition frequencies agree within
   Hoeffding's bound, all the way down. States with few visits have little to
   say against that, so random characters become one path per depth, while
   lengths, literal prefixes and fixed separators keep their states.
2. What is left has the visits of a whole depth in few states. Only now states
   of different depths may merge (into loops, for formats of any length), and
   only with at least `visits` visits on both sides: a state that few values
   reach keeps its depth.

The other side is a trigram model of characters whose counts are of all
unlabelled runs of all documents. Every run of 6 or more characters of
`[A-Za-z0-9+/_.=-]` in every text is scored by the log-likelihood ratio of each
kind's automaton to that model: first its pieces between `.`, `/` and `=`, and
where none is accepted, the run itself. A kind's limit is the ratio at which
a credential is `odds` times as probable as a plain run, given how many runs and
labelled credentials the documents hold; it is never less than half of what
nearly all labelled values of the sample's other half reach.

Cases: null text is empty and has no span; positions are code points, end
exclusive; repeated rows are separate; without labelled credentials of a kind
nothing is added for it; what overlaps a base span is not added; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, scratch, strings, table

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_PIECE = re.compile(r"[A-Za-z0-9+_-]{6,}")
_SHORTEST = 6


@dataclass(frozen=True)
class SecretConfig:
    sample: int = 1500  # labelled values of each kind that are learned from; documented bound
    longest: int = 256  # longer values are not learned from
    alpha: float = 0.01  # of Hoeffding's bound
    visits: int = 200  # of both states, where depths differ
    odds: float = 100.0  # of a credential to a plain run, for a span to be added
    unlabelled: float = 0.1  # credentials without a label that are expected for each one with
    usual: float = 0.02  # share of labelled values that may be atypical
    typical: float = 0.5  # of the ratio that all other labelled values reach is the least for a span


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base matches, by start and kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out)


def credential(text: str, span: tuple[int, int, int]) -> str:
    """The secret itself within a base span."""
    part = text[span[0] : span[1]]
    if span[2]:
        return part
    m = _ASSIGN.match(part)
    return m[2] if m else part


_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *"+/_.=-")
ALPHABET = "".join(_CLASSES)
_CLASS = {c: k for k, own in enumerate(_CLASSES) for c in own}
_END = len(_CLASSES)  # the class of a word's end


class Automaton:
    """A deterministic probabilistic automaton: a prefix tree with merged states. State 0 is the first."""

    floor = 0.05  # visits that each class has in advance

    def __init__(self, words: list[str], cfg: SecretConfig = SecretConfig()):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.end, self.total = [0], [0]
        for w in words:
            s = 0
            for c in w:
                self.total[s] += 1
                self.count[s][c] = self.count[s].get(c, 0) + 1
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.end.append(0)
                    self.total.append(0)
                s = self.next[s][c]
            self.total[s] += 1
            self.end[s] += 1
        self.bound = math.sqrt(0.5 * math.log(2.0 / cfg.alpha))
        self._merge_depths()
        self._keep(self._reachable())
        self._merge_loops(cfg.visits)
        self._keep(self._reachable())
        self._steps: dict[tuple[int, str], tuple[float, int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_steps": {}}

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _disagree(self, a: int, b: int) -> bool:
        """Whether the frequencies of two states themselves differ."""
        n, m = self.total[a], self.total[b]
        if self._differ(self.end[a], n, self.end[b], m):
            return True
        return any(self._differ(self.count[a].get(c, 0), n, self.count[b].get(c, 0), m) for c in self.count[a].keys() | self.count[b].keys())

    def _compatible(self, a: int, b: int, visits: int = 1, known: set[tuple[int, int]] | None = None) -> bool:
        """Whether two states agree and, along equal symbols, the states below them that have enough visits. known: pairs that don't; those found on the way join it."""
        todo, above = [(a, b)], {(a, b): None}
        while todo:
            pair = todo.pop()
            a, b = pair
            if a == b or min(self.total[a], self.total[b]) < visits:
                continue
            if known is not None and pair in known or self._disagree(a, b):
                while known is not None and pair is not None:
                    known.add(pair)
                    pair = above[pair]
                return False
            for c in self.next[a].keys() & self.next[b].keys():
                below = (self.next[a][c], self.next[b][c])
                if below not in above:
                    above[below] = pair
                    todo.append(below)
        return True

    def _add(self, a: int, b: int) -> None:
        self.total[a] += self.total[b]
        self.end[a] += self.end[b]
        for c, n in self.count[b].items():
            self.count[a][c] = self.count[a].get(c, 0) + n

    def _fold(self, into: int, tree: int) -> None:
        """Add a subtree to a state and, along equal symbols, below it."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self._add(a, b)
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge_depths(self) -> None:
        """Merge within each depth, from the first on: afterwards a depth has no two compatible states."""
        level = [0]
        while level:
            waiting = sorted(((r, c) for r in level for c in self.next[r]), key=lambda x: (-self.total[self.next[x[0]][x[1]]], x))
            level = []
            for r, c in waiting:
                state = self.next[r][c]
                for other in level:
                    if self._compatible(other, state):
                        self.next[r][c] = other
                        self._fold(other, state)
                        break
                else:
                    level.append(state)

    def _merge_loops(self, visits: int) -> None:
        """Merge states of different depths that have enough visits to tell."""
        kept: list[int] = []
        gone: dict[int, int] = {}
        apart: set[tuple[int, int]] = set()

        def now(s: int) -> int:
            while s in gone:
                s = gone[s]
            return s

        for s in range(len(self.next)):
            if s in gone or self.total[s] < visits:
                continue
            for other in kept:
                if other not in gone and self._compatible(other, s, visits, apart):
                    todo = [(other, s)]
                    while todo:
                        a, b = map(now, todo.pop())
                        if a == b:
                            continue
                        gone[b] = a
                        self._add(a, b)
                        for c, child in self.next[b].items():
                            if c in self.next[a]:
                                todo.append((self.next[a][c], child))
                            else:
                                self.next[a][c] = child
                    for own in self.next:
                        for c in own:
                            own[c] = now(own[c])
                    break
            else:
                kept.append(s)

    def _reachable(self) -> list[int]:
        """States by their distance from the first."""
        order, met = [0], {0}
        for s in order:
            for c in sorted(self.next[s]):
                if self.next[s][c] not in met:
                    met.add(self.next[s][c])
                    order.append(self.next[s][c])
        return order

    def _keep(self, order: list[int]) -> None:
        at = {s: k for k, s in enumerate(order)}
        self.next = [{c: at[t] for c, t in self.next[s].items()} for s in order]
        self.count, self.end, self.total = ([x[s] for s in order] for x in (self.count, self.end, self.total))

    def chance(self, s: int, c: str | None) -> float:
        """Probability of a character, or of the end (None), in a state.

        Counts are smoothed by the state's character classes, which weigh as
        much as the state has seen different characters: little at a literal,
        much where characters are random.
        """
        n, weight = self.total[s], len(self.count[s]) + (self.end[s] > 0)
        if c is None:
            k, seen, size = _END, self.end[s], 1
            of_class = seen
        else:
            k, seen = _CLASS[c], self.count[s].get(c, 0)
            size, of_class = len(_CLASSES[k]), sum(self.count[s].get(x, 0) for x in _CLASSES[k])
        share = (of_class + self.floor) / (n + self.floor * (_END + 1)) / size
        return (seen + weight * share) / (n + weight)

    def step(self, s: int, c: str) -> tuple[float, int]:
        """Bits of a character and the state after it: for one that the state has not seen, where most of its values go."""
        if (s, c) not in self._steps:
            to = self.next[s].get(c)
            if to is None:
                to = self.next[s][max(self.count[s], key=lambda x: (self.count[s][x], x))] if self.count[s] else s
            self._steps[s, c] = (math.log2(self.chance(s, c)), to)
        return self._steps[s, c]

    def bits(self, word: str) -> float:
        """Log-likelihood of a word, in bits."""
        s, out = 0, 0.0
        for c in word:
            more, s = self.step(s, c)
            out += more
        return out + math.log2(self.chance(s, None))


_N = len(ALPHABET) + 1
_CODE = np.zeros(256, np.uint8)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, _N, dtype=np.uint8)
_CODES = _CODE.tobytes()


def run_counts(text: str) -> tuple[np.ndarray, int]:
    """Counts of (before, character, next) over the runs of a text, 0 for what is outside, and the number of runs."""
    code = _CODE[np.frombuffer(f"\n\n{text}\n".encode("utf-8", "surrogatepass"), np.uint8)]
    inside = code > 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    short = end - start < _SHORTEST
    turn = np.zeros(len(code) + 1, np.int8)
    turn[start[short]] = 1
    turn[end[short]] -= 1
    code[np.cumsum(turn[:-1], dtype=np.int8) > 0] = 0
    out = np.zeros(_N**3, np.int64)
    for a in range(2, len(code), 1 << 20):
        z = code[a : a + (1 << 20)].astype(np.int32)
        y, x = (code[a - k : a - k + len(z)].astype(np.int32) for k in (1, 2))
        x[y == 0] = 0
        out += np.bincount(((x * _N + y) * _N + z)[(y > 0) | (z > 0)], minlength=_N**3)
    return out, int((~short).sum())


_GROUP = np.array([0, *(_CLASS[c] + 1 for c in ALPHABET)])


class Plain:
    """Trigrams of characters, interpolated with bigrams, trigrams of character classes and single characters.

    What a ten-thousandth of all runs (or three) or fewer have is discounted, so
    that a rare run, or one that many copies repeat, can't explain itself.
    """

    rare, weight = 1e-4, 50.0

    def __init__(self, counts: np.ndarray, runs: int):
        n, rare, w = counts.reshape(_N, _N, _N).astype(float), max(3.0, self.rare * runs), self.weight
        pair, one = n.sum(0), n.sum((0, 1))
        groups = np.zeros((_END + 1,) * 3)
        np.add.at(groups, (_GROUP[:, None, None], _GROUP[None, :, None], _GROUP[None, None, :]), n)
        n, pair, of = np.maximum(n - rare, 0), np.maximum(pair - rare, 0), np.maximum(groups - rare, 0)
        group = np.bincount(_GROUP, one, _END + 1)
        of = (of + w * (group + 1) / (group.sum() + _END + 1)) / (of.sum(2, keepdims=True) + w)
        within = (one + 1) / (group + np.bincount(_GROUP, minlength=_END + 1))[_GROUP]
        base = of[_GROUP[:, None, None], _GROUP[None, :, None], _GROUP[None, None, :]] * within
        base = (pair + w * base) / (pair.sum(1, keepdims=True) + w)
        self.table = np.log2((n + w * base) / (n.sum(2, keepdims=True) + w)).astype(np.float32).ravel()
        self._flat: list[float] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_flat": []}

    def bits(self, word: str) -> float:
        if not self._flat:
            self._flat = self.table.tolist()
        flat, x, y, out = self._flat, 0, 0, 0.0
        for z in word.encode().translate(_CODES):
            out += flat[(x * _N + y) * _N + z]
            x, y = y, z
        return out + flat[(x * _N + y) * _N]


@dataclass
class SecretModel:
    kinds: list[Automaton | None]
    plain: Plain
    limits: list[float]
    rejected: set[str] = field(default_factory=set)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rejected": set()}

    def score(self, value: str) -> list[float]:
        """Log-likelihood ratio of each kind, in bits."""
        ground = self.plain.bits(value)
        return [-math.inf if a is None else a.bits(value) - ground for a in self.kinds]

    def best(self, value: str) -> tuple[float, int]:
        """How far the best kind's ratio is above its limit, and the kind."""
        ground = self.plain.bits(value)
        if -ground < min(self.limits):  # no automaton has more than 0 bits
            return -math.inf, 0
        return max((-math.inf if a is None else a.bits(value) - ground - limit, k) for k, (a, limit) in enumerate(zip(self.kinds, self.limits, strict=True)))

    def spans(self, run: str) -> list[tuple[int, int, int]]:
        """(start, end, kind) within a run: those of its pieces that are accepted, or else itself without dots around it."""
        a = len(run) - len(run.lstrip("."))
        whole = run.strip(".")
        parts = [(*self.best(m[0]), m.start(), m.end()) for m in _PIECE.finditer(run)]
        if all(over < 0 for over, *_ in parts):
            parts = [(*self.best(whole), a, a + len(whole))] if len(whole) >= _SHORTEST else []
        return [(a, e, k) for over, k, a, e in parts if over >= 0]

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of a text that overlap no base span. Runs that gave none are remembered, as words repeat."""
        fresh = set(_RUN.findall(text)) - self.rejected
        if not fresh:
            return []
        if len(self.rejected) > 1 << 19:
            self.rejected.clear()
        found = {run: self.spans(run) for run in fresh}
        self.rejected.update(run for run, own in found.items() if not own and len(run) <= 64)
        if not any(found.values()):
            return []
        starts, reach = [b[0] for b in base], []  # reach: the furthest end of the base spans up to each
        for b in base:
            reach.append(max(b[1], reach[-1] if reach else 0))

        def free(a: int, e: int) -> bool:
            before = bisect_right(starts, e - 1)
            return not before or reach[before - 1] <= a

        return [(m.start() + a, m.start() + e, k) for m in _RUN.finditer(text) for a, e, k in found.get(m[0], ()) if free(m.start() + a, m.start() + e)]


def value_hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"), 9) >> 1


#: Kinds of the rows that the fit gathers, beside the kinds of credentials: trigram counts, counts of labelled values and of runs.
_TRIGRAM, _LABELLED, _RUNS = 10, 20, 30


def _gather(cfg: SecretConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict[str, int]] = [{} for _ in KINDS]
        labelled, runs, grams = [0] * len(KINDS), 0, np.zeros(_N**3, np.int64)

        def least(k: int) -> list[tuple[int, str]]:  # a task hands on no more than the sample can use
            return sorted((h, v) for v, h in own[k].items())[: cfg.sample]

        for batch in batches:
            rest = []
            for t in strings(batch.column(0)).to_pylist():
                at, base = 0, base_spans(t)
                for a, e, k in base:
                    labelled[k] += 1
                    v = credential(t, (a, e, k))
                    if len(v) <= cfg.longest:
                        own[k][v] = value_hash(v)
                    if e > at:
                        rest.append(t[at : max(at, a)])
                        at = e
                rest.append(t[at:])
            more, n = run_counts("\n".join(rest))
            grams, runs = grams + more, runs + n
            for k in range(len(KINDS)):
                if len(own[k]) > 2 * cfg.sample:
                    own[k] = {v: h for h, v in least(k)}
        rows = [(k, v, h, 1) for k in range(len(KINDS)) for h, v in least(k)] + [(_LABELLED + k, "", 0, n) for k, n in enumerate(labelled)] + [(_RUNS, "", 0, runs)]
        rows += [(_TRIGRAM, "", int(i), int(grams[i])) for i in np.flatnonzero(grams)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["kind", "value", "key", "n"])

    return run


def fit(spark: SparkSession, docs: DataFrame, text: str = "text", cfg: SecretConfig = SecretConfig()) -> SecretModel:
    """Automata of the labelled credentials of docs, and the model of all else. To the driver: the samples and at most 69**3 counts."""
    path = scratch(spark, "labelled")
    docs.select(F.col(text).alias("text")).mapInArrow(_gather(cfg), "kind int, value string, key long, n long").write.parquet(path)
    seen = spark.read.parquet(path)
    words = [[r[0] for r in seen.where(F.col("kind") == k).groupBy("key", "value").agg(F.count(F.lit(1))).orderBy("key", "value").limit(cfg.sample).select("value").collect()] for k in range(len(KINDS))]
    sums = seen.where(F.col("kind") >= _TRIGRAM).groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, key, n = (sums.column(c).to_numpy() for c in ("kind", "key", "n"))
    grams = np.zeros(_N**3)
    grams[key[kind == _TRIGRAM]] = n[kind == _TRIGRAM]
    total = {k: int(n[kind == k].sum()) for k in (_RUNS, *(_LABELLED + k for k in range(len(KINDS))))}
    drop_path(spark, path)
    return build(words, Plain(grams, total[_RUNS]), total[_RUNS], [total[_LABELLED + k] for k in range(len(KINDS))], cfg)


def build(words: list[list[str]], plain: Plain, runs: int, labelled: list[int], cfg: SecretConfig = SecretConfig()) -> SecretModel:
    """One half of the values makes the automata, the other half and the counts their limits."""
    model = SecretModel([Automaton(w[::2], cfg) if w else None for w in words], plain, [math.inf] * len(words))
    for k, own in enumerate(words):
        if own:
            prior = math.log2(max(1, runs) / (labelled[k] * cfg.unlabelled))
            held = sorted(model.score(w)[k] for w in own[1::2])
            # Plain counts hold unlabelled credentials but no labelled ones, so these ratios are the larger ones.
            least = cfg.typical * held[int(len(held) * cfg.usual)] if held else 0.0
            model.limits[k] = max(prior + math.log2(cfg.odds), least, 0.0)
    return model


def scan(spark: SparkSession, docs: DataFrame, model: SecretModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), a row for each row of docs."""
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digest, listed = [], []
            for t in strings(batch.column(1)).to_pylist():
                base = base_spans(t)
                for k in range(3):
                    counts[k].append(sum(b[2] == k for b in base))
                digest.append(hashlib.sha256(written(base).encode()).hexdigest())
                listed.append(written(sorted(base + m.added(t, base))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array(listed)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, e, k in spans)


def op3_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(spark, docs, fit(spark, docs))
