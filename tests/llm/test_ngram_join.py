import random
import time

import pyarrow as pa
import pytest

from codelode.llm import components, ngram_join, workers
from codelode.llm.components import connected_components
from codelode.llm.ngram_join import Bands, bitmap, folded, ngram_jaccard_join, part_keys
from codelode.llm.shingles import WordHashes, ascii_words, shingle_hashes

from .conftest import prose


def brute(texts, k, num, den):
    sets = []
    for t in texts:
        w = ascii_words(t)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and den * inter >= num * len(sets[i] | sets[j]) and inter:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def families(seed, n):
    """Texts of many sizes with chains of ever more edited copies, around the threshold."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        words = prose(rng, rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 15, 20, 28, 40, 90, 200])).split()
        out.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            for _ in range(max(1, len(words) // rng.choice([10, 25, 60, 120]))):
                words[rng.randrange(len(words))] = rng.choice(["zzz", "yyy", "xxx", "www"])
            if rng.random() < 0.3:
                words.insert(rng.randrange(len(words) + 1), "vvv")
            out.append(" ".join(words) if rng.random() < 0.8 else " ".join(words).upper())
    return out[:n]


@pytest.mark.parametrize(("seed", "k", "num"), [(1, 4, 85), (2, 5, 80)])
def test_against_brute_force(make_docs, seed, k, num):
    texts = families(seed, 260)
    sizes, roots = brute(texts, k, num, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(make_docs(texts), k, num, 100).collect()}
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}


def test_linked_pairs_share_a_key():
    cut, words = Bands(85, 100, 1.5), WordHashes()
    texts = families(5, 500)
    sets = [shingle_hashes(words.of(ascii_words(t)), 4) for t in texts]
    keys = [set(part_keys(s, cut).tolist()) for s in sets]
    bits = [bitmap(s) for s in sets]
    linked = 0
    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if a and 100 * len(a & b) >= 85 * len(a | b):
                linked += 1
                assert keys[i] & keys[j]
            n = min(len(bits[i]), len(bits[j])) // 8
            apart = sum(int(x).bit_count() for x in folded(bits[i], n) ^ folded(bits[j], n))
            assert apart <= len(a ^ b)
    assert linked > 30


def test_awkward_rows(awkward, no_docs):
    rows = ngram_jaccard_join(awkward).collect()
    assert len(rows) == 11
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_shingles > 0, r.component_id))
    assert got[0] == [(False, 0)] and got[1] == [(False, 1)] and got[2] == [(False, 2)] and got[3] == [(True, 3)]
    assert got[4] == [(True, 4)] and got[5] == [(True, 4)] and got[6] == [(True, 4)] and got[7] == [(True, 7)] * 2 and got[None] == [(False, None)]
    assert ngram_jaccard_join(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_workers_word_cache_is_small(monkeypatch):
    """The signatures of 100,000 different words leave at most 65,536 of them in the worker."""
    monkeypatch.setattr(workers, "_kept", {})
    texts = [" ".join(f"w{i}" for i in range(at, at + 1000)) for at in range(0, 100_000, 1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], names=["doc_id", "text"])
    sizes = [n for out in ngram_join._signatures(4, 85, 100)(iter([batch])) for n in out.column("n_shingles").to_pylist()]
    assert sizes == [997] * 100 and 0 < len(workers._kept["words"]) <= 1 << 16


def test_few_edges_take_one_pass(spark, monkeypatch):
    """A path of 600 nodes in shuffled order: written, counted, and found by one task; the same from the rounds of many edges."""
    ids = random.Random(3).sample(range(10_000), 600)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    store = spark._jsparkSession.sharedState().statusStore()
    time.sleep(1)  # the store hears of a query after its end
    began = store.executionsCount()
    found = {tuple(r) for r in connected_components(edges).collect()}
    time.sleep(1)
    assert store.executionsCount() - began <= 3
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert found == {tuple(r) for r in connected_components(edges).collect()} == {(x, min(ids)) for x in ids}
