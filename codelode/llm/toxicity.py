"""Toxicity scores: a learned lexicon matched through Levenshtein automata, weighed by context.

The lexicon is learned: words and word stems that labelled toxic documents hold far
more often than the others. Its trie is intersected with a Levenshtein automaton;
the product is determinized lazily, so a word costs one dictionary probe per
letter until it dies, and misspelled terms are found at one edit (two for long
terms). Each hit gets a score of the words around it: paired quotation marks and the distance
to reporting words separate quoting from abuse. A logistic regression over exact, stem and
misspelled hits, weighed by that score, gives the document's score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.language_id import held_out
from codelode.llm.shingles import WordHashes, ascii_words, mix, shingle_hashes
from codelode.llm.workers import kept
from codelode.session import ship

# Characters around words, marks of quotation and words that report speech.
EDGES = ".,;:!?\"'()[]{}<>«»“”„‘’…*_-–—/\\|#"
OPENING, CLOSING = "\"“„«‘", "\"”“»’"
REPORTING = frozenset("said says wrote called quote quoted quotes term word reported sagte schrieb nannte zitat dit écrit appelé citation dijo escribió llamó cita".split())
MISS, EXACT, STEM, NEAR = 0, 1, 2, 3
WINDOW = 6
FEATURES = 8
Lexicon = dict[str, int]


class Automaton:
    """Lazy deterministic product of a lexicon trie and a Levenshtein automaton."""

    def __init__(self, lexicon: Lexicon, states: int = 200_000):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]  # edits allowed at the end of a whole word, or -1
        self.stem: list[int] = [-1]  # likewise where a stem ends
        self.allow: list[int] = [0]  # most edits that any term below allows
        for term, kind in lexicon.items():
            edits = 0 if len(term) < 5 else 1 if len(term) < 9 else 2
            if kind == STEM:
                edits = 0 if len(term) < 7 else 1
            node = 0
            self.allow[0] = max(self.allow[0], edits)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.allow.append(0)
                node = self.children[node][letter]
                self.allow[node] = max(self.allow[node], edits)
            ends = self.stem if kind == STEM else self.word
            ends[node] = max(ends[node], edits)
        self.limit = states
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.found: list[int] = []
        self.start = self._state({(0, 0)})

    def _state(self, raw: set[tuple[int, int]]) -> int:
        """The id of the closure of a set of (trie node, edits); -1 if it is dead."""
        best: dict[int, int] = {}
        todo = list(raw)
        while todo:
            node, edits = todo.pop()
            if edits > self.allow[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]  # a letter left out
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            hits = [STEM if e == 0 else NEAR for n, e in key if self.stem[n] >= e]
            self.found.append(min(hits, default=MISS))
        return self.ids[key]

    def _next(self, state: int, letter: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            out.add((node, edits + 1))  # a letter too many
            for other, child in self.children[node].items():
                out.add((child, edits + (other != letter)))
        return self._state(out)

    def match(self, word: str) -> int:
        """MISS, EXACT (a term), STEM (starts with a stem) or NEAR (within the allowed edits)."""
        if len(self.sets) > self.limit:
            self.reset()
        state, seen = self.start, MISS
        for letter in word:
            following = self.step[state].get(letter)
            if following is None:
                following = self._next(state, letter)
                self.step[state][letter] = following
            if following < 0:
                return seen
            state = following
            if self.found[state] and (seen == MISS or self.found[state] < seen):
                seen = self.found[state]
        whole = min((EXACT if e == 0 else NEAR for n, e in self.sets[state] if self.word[n] >= e), default=MISS)
        return min(x for x in (whole, seen) if x) if whole or seen else MISS


class Matches(dict):
    """Raw token -> kind of match; emptied at ``limit`` entries."""

    def __init__(self, lexicon: Lexicon, limit: int = 400_000):
        super().__init__()
        self.automaton = Automaton(lexicon)
        self.limit = limit

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        word = token.strip(EDGES)
        kind = self[token] = self.automaton.match(word) if word else MISS
        return kind


def quotation(tokens: list[str]) -> list[bool]:
    """Which tokens stand between a pair of quotation marks: an opening mark and the next closing one after it.

    A mark at the start of a token opens, one at its end closes; a mark that is never closed quotes nothing.
    """
    out = [False] * len(tokens)
    start = -1
    for at, token in enumerate(tokens):
        if start < 0 and token[0] in OPENING:
            start = at
        bare = token.rstrip(".,;:!?")
        if start >= 0 and bare[-1:] and bare[-1] in CLOSING and (at > start or len(bare) > 1):
            out[start : at + 1] = [True] * (at + 1 - start)
            start = -1
    return out


def context(tokens: list[str], at: int, inside: bool) -> float:
    """How far the words around a hit quote or report it: 1 between quotation marks, less the farther a reporting word stands before it, 0 for none."""
    if inside:
        return 1.0
    for back in range(1, min(WINDOW, at) + 1):
        if tokens[at - back].strip(EDGES) in REPORTING:
            return 1.0 - (back - 1) / WINDOW
    return 0.0


def document_features(text: str | None, matches: Matches) -> list[float]:
    """Weights of exact, stem and misspelled hits, each split by its context into abuse and quotation; their share of the words; whether there are any."""
    tokens = (text or "").lower().split()
    kinds = list(map(matches.__getitem__, tokens))
    counts = [0.0] * 6
    hits = 0
    if any(kinds):
        inside = quotation(tokens)
        for at, kind in enumerate(kinds):
            if kind:
                share = context(tokens, at, inside[at])
                counts[(kind - 1) * 2] += 1 - share
                counts[(kind - 1) * 2 + 1] += share
                hits += 1
    return [*(float(np.log1p(x)) for x in counts), hits / max(1, len(tokens)), float(hits > 0)]


_WORD = re.compile(r"[^\W\d_]+")


def _terms(text: str) -> set[str]:
    """Words of three letters or more, and their stems of four to eight letters marked by a star."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) >= 3}
    return words | {w[:n] + "*" for w in words for n in range(4, min(8, len(w) - 1) + 1)}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bad, good = Counter(), Counter()
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            (bad if toxic else good).update(_terms(text.as_py()))
    terms = [*bad]
    if terms:
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms), pa.array([bad[x] for x in terms], pa.int64()), pa.array([good[x] for x in terms], pa.int64())], names=["term", "a", "b"]
        )
    other = [x for x in good if x not in bad]
    for at in range(0, len(other), 50_000):
        part = other[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([0] * len(part), pa.int64()), pa.array([good[x] for x in part], pa.int64())], names=["term", "a", "b"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a hash of the eight smallest shingle hashes, which only near copies share."""
    words = kept("words", WordHashes)
    for batch in batches:
        least = [int(mix(s[:8]).sum(dtype=np.uint64).view(np.int64)) if len(s := shingle_hashes(words.of(ascii_words(x.as_py())), 5)) else 0 for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, pa.int64())], names=["toxic", "text", "least"])


def learn_lexicon(rows: DataFrame, most: int = 5000) -> Lexicon:
    """Terms of labelled rows (toxic, text) that mark toxic ones: EXACT for words, STEM for stems.

    A term must be in 0.5 % of the toxic rows and four of them, and at least 40
    times as frequent there as elsewhere. Of a stem and the stems and words that it
    covers, the shortest of equal purity stays. At most ``most`` terms reach the driver.
    """
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    na, nb = size.get(1, 0), size.get(0, 0)
    if not na:
        return {}
    counts = rows.select("toxic", "text").mapInArrow(_counted, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rich = counts.where((F.col("a") >= max(4.0, 0.005 * na)) & (F.col("a") / na >= 40 * (F.col("b") + 0.5) / max(nb, 1)))
    found = {r["term"]: r["a"] for r in rich.orderBy(F.desc("a"), "term").limit(most).collect()}
    lexicon: Lexicon = {}
    for term in sorted(found, key=lambda x: (len(x.rstrip("*")), x)):
        stem = term.endswith("*")
        word = term.rstrip("*")
        if any(lexicon.get(word[:n]) == STEM for n in range(4, len(word) + 1)):
            continue
        if stem:
            # a stem earns its place if it gathers more rows than any single word under it
            under = max((a for t, a in found.items() if not t.endswith("*") and t.startswith(word)), default=0)
            longer = max((a for t, a in found.items() if t.endswith("*") and len(t) > len(term) and t.startswith(word)), default=0)
            if found[term] <= 1.15 * under or found[term] <= 1.02 * longer:
                continue
        lexicon[word] = STEM if stem else max(EXACT, lexicon.get(word, 0))
    return lexicon


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights, bias last, by Newton's method with class-balanced rows and an L2 penalty on the weights."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = Matches(lexicon)
        for batch in batches:
            rows = [document_features(x.as_py(), matches) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def _scored(lexicon: Lexicon, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = Matches(lexicon)
        for batch in batches:
            x = np.array([document_features(t.as_py(), matches) for t in batch.column(2)]).reshape(-1, FEATURES)
            scores = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text, ...).

    Learns from ``labels`` (doc_id, toxic) of documents whose crc32(doc_id as text) mod
    3 is not 1, from a sample of about ``sample`` of them chosen by a hash of the id
    (all, if there are fewer), near copies counted once. Rows without a label, a text
    or an id teach nothing. Null and empty texts get the score of a text without
    hits, very long ones are read whole; of near copies and of an id's differing labels the least text and the greater
    label teach; rows that repeat an id, or have none, are scored like any other. With
    nothing to learn from, every score is 0. An empty table gives an empty result.
    Other columns are not read, so their names may clash.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    n = known.count()
    draw = (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) + 0.5) / 1_000_003
    known = known.where(draw <= min(1.0, sample / max(n, 1))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # about `sample` rows of 12 bytes, a stated bound
    taught = rows.where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id").select("toxic", "text")
    taught = taught.mapInArrow(_sketched, "toxic int, text string, least long")
    # of near copies the least text teaches, whichever task comes first
    taught = taught.groupBy("least", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    taught = taught.persist()
    lexicon = learn_lexicon(taught)
    fitted = taught.mapInArrow(_featured(lexicon), "toxic int, x array<double>").collect()
    taught.unpersist()
    weights = np.zeros(FEATURES + 1)
    weights[-1] = -30.0
    if fitted and lexicon:
        weights = fit_logistic(np.array([r["x"] for r in fitted]), np.array([r["toxic"] for r in fitted], float))
    out = rows.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_scored(lexicon, weights), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
