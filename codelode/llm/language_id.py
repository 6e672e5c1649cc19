"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector, drawn from a generator seeded by its code
point, so all workers agree without sharing state. A letter trigram is bound by
multiplying its three letters' vectors after permuting (rolling) the first by two
and the second by one place. A document bundles its trigram vectors, weighted by
their counts damped to a square root; a language's prototype bundles its training
documents, scaled to unit length. The prediction is the prototype of largest
cosine after the mean of all prototypes, which holds what languages share, has
been taken out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.workers import kept
from codelode.session import broadcast_if_small, materialize, ship

DIM = 1024
#: Trigram vectors kept per worker: 12,000 * 1024 * 4 bytes = 49 MB.
CACHED = 12_000
_SPACE = 32
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _letters.append(table)
    return _letters[0]


def trigram_codes(text: str) -> np.ndarray:
    """One code per letter trigram of the lower-cased text; every run of other characters is one space."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points = np.where(letter_table()[points], points, _SPACE)
    points = points[np.concatenate([[True], (points[1:] != _SPACE) | (points[:-1] != _SPACE)])]
    if len(points) < 3:
        return points[:0]
    return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]


class Profiles:
    """Trigram vectors, made on demand; the cache is emptied when full."""

    def __init__(self) -> None:
        self.letter: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.matrix = np.empty((CACHED, DIM), np.float32)

    def _letter(self, point: int) -> np.ndarray:
        if point not in self.letter:
            if len(self.letter) > 4096:
                self.letter.clear()
            self.letter[point] = np.random.default_rng(point).choice(np.array([-1, 1], np.int8), DIM)
        return self.letter[point]

    def _vector(self, code: int) -> np.ndarray:
        a, b, c = (self._letter((code >> shift) & 0x1FFFFF) for shift in (42, 21, 0))
        return np.roll(a, 2) * np.roll(b, 1) * c

    def bundle(self, text: str) -> np.ndarray:
        """The document's vector; zero if it has no letter."""
        codes, counts = np.unique(trigram_codes(text), return_counts=True)
        out = np.zeros(DIM, np.float32)
        weights = np.sqrt(counts).astype(np.float32)
        for at in range(0, len(codes), CACHED // 4):
            part = codes[at : at + CACHED // 4].tolist()
            fresh = [x for x in part if x not in self.row]
            if fresh:
                if len(self.row) + len(fresh) > CACHED:
                    self.row.clear()
                    fresh = part
                for code in fresh:
                    self.matrix[len(self.row)] = self._vector(code)
                    self.row[code] = len(self.row)
            out += weights[at : at + CACHED // 4] @ self.matrix[[self.row[x] for x in part]]
        return out


def profiles() -> Profiles:
    """This worker's profiles."""
    return kept("profiles", Profiles)


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    make = profiles()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            vector = make.bundle(text.as_py())
            norm = float(np.linalg.norm(vector))
            if norm:
                sums[lang] = sums.get(lang, 0) + vector / norm
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums)), pa.array([x.astype(np.float64) for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"]
        )


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, per_lang: int = 3000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, mean prototype, unit prototypes less the mean) from labelled documents that aren't held out.

    Fits on a sample, chosen by a hash of the id, of about ``per_lang`` documents of
    each language (all, if it has fewer). What reaches the driver is one vector
    per language and dimension, summed by executors first.
    """
    ship(docs.sparkSession)
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = materialize(rows.groupBy("lang").agg((F.lit(float(per_lang)) / F.count("*")).alias("share")), "shares")
    draw = (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) + 0.5) / 1_000_003
    drawn = rows.join(broadcast_if_small(shares), "lang").where(draw <= F.least("share", F.lit(1.0)))
    parts = drawn.select("lang", "text").mapInArrow(_bundled, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    by_lang = {r["lang"]: r["v"] for r in sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect()}
    langs = sorted(by_lang)
    if not langs:
        return [], np.zeros(DIM, np.float32), np.zeros((0, DIM), np.float32)
    proto = np.array([[x["x"] for x in by_lang[lang]] for lang in langs])
    proto /= np.linalg.norm(proto, axis=1, keepdims=True)
    mean = proto.mean(axis=0) if len(langs) > 1 else np.zeros(DIM)
    rest = proto - mean
    rest /= np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-12)
    return langs, mean.astype(np.float32), rest.astype(np.float32)


def _predicted(langs: list[str], mean: np.ndarray, rest: np.ndarray, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = profiles()
        for batch in batches:
            predicted, scores = [], []
            for value in batch.column(at):
                vector = make.bundle(value.as_py() or "")
                norm = float(np.linalg.norm(vector))
                if not norm or not langs:
                    predicted.append("und")
                    scores.append(0.0)
                    continue
                vector = vector / norm - mean
                cosine = rest @ (vector / max(float(np.linalg.norm(vector)), 1e-12))
                best = int(np.argmax(cosine))
                predicted.append(langs[best])
                scores.append(float(min(1.0, max(0.0, cosine[best]))))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(predicted, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return run


def identify_language(docs: DataFrame, per_lang: int = 3000, keep: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang, ...).

    Learns from ``docs`` itself. lang_pred is ``und``, with score 0, for a null text or one
    without a letter, or if nothing could be learned. Rows that repeat an id, or have
    none, are predicted like any other (a null id is not held out). An empty table
    gives an empty result. ``keep`` returns the columns of ``docs`` in place of
    (doc_id, held_out); columns of ``docs`` named lang_pred or score are then replaced.
    """
    langs, mean, rest = learn(docs.select("doc_id", "text", "lang"), per_lang)
    if keep:
        rows = docs.drop("lang_pred", "score")
    else:
        rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    at = rows.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, score double"
    out = rows.mapInArrow(_predicted(langs, mean, rest, at), schema)
    return out if keep else out.drop("text")
