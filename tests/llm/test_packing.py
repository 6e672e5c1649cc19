import random
import zlib

import numpy as np
import pytest

from codelode.llm import packing, tokens

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.default_path(), "rb") as f:
        return tokens.PieceEncoder(f.read())


TEXTS = ["", " ", "a", "Hello, world", "  two  spaces ", "tab\there \n next", "line\n\n  indent", "it's we'll '' don't", "naïve café — 日本語 テキスト", "x" * 500, "a <|endoftext|> b<|endoftext|>", "1234 5,678.90", " nbsp em sp", "\x1c fs \x1f us", "emoji 🙂🙂 end", " lead", "trail ", "\n", "a\r\nb", "ﬁ ligature  \n x"]


def test_pieces_encode_like_whole_texts(encoder):
    rng = random.Random(1)
    alphabet = list("ab  \n\t.,'1é日  s🙂<|>-_")
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    whole = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == whole
    assert encoder.encode(texts) == whole  # from the cache


def test_ranked_and_piecewise_ids_are_those_of_whole_texts(encoder):
    """Every code point beside letters, digits, spaces and itself; both ways of encoding."""
    piecewise = tokens.PieceEncoder(encoder.tokenizer.to_str().encode())
    piecewise.ranked = None
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = TEXTS + ["".join(f"a{c}b {c} c{c} 1{c}2 {c}{c}  {c}\n " for c in chars[at : at + 64]) for at in range(0, len(chars), 64)]
    whole = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.ranked is not None and encoder.encode(texts) == whole
    assert not encoder.inner  # nothing is cached per word
    assert piecewise.encode(texts) == whole


def test_large_islands_get_all_generations(monkeypatch):
    size, made = triplets(random.Random(8), 1400, 2048)[:4096], []
    whole = packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *x: made.append(1) or whole(*x))
    few = packing.evolve(size, 2048, seed=1, population=4, generations=6)
    made.clear()
    bins = packing.evolve(size, 2048, seed=1)
    assert len(made) == 40 and sorted(i for b in bins for i in b) == list(range(4096))
    assert len(bins) < len(few) < len(packing.best_fit([], list(range(4096)), size, 2048))


def test_crossover_keeps_each_item_once():
    rng = random.Random(2)
    size = [rng.randrange(1, 1500) for _ in range(300)]
    one = packing.best_fit([], list(range(300)), size, 2048)
    two = [[i] for i in range(300)]
    child = packing.crossover(one, two, size, 2048, 0.3)
    for p in (one, child, packing.evolve(size, 2048, 1)):
        assert sorted(i for b in p for i in b) == list(range(300)) and all(sum(size[i] for i in b) <= 2048 for b in p)
    assert len(packing.evolve(size, 2048, 1)) <= len(one)


def triplets(rng, n, window):
    """Sizes of n full bins of three pieces each: best fit is far from the bound."""
    out = []
    for _ in range(n):
        a = rng.randrange(window * 38 // 100, window * 49 // 100)
        b = rng.randrange(window * 25 // 100, (window - a) // 2 + 1)
        out += [a, b, window - a - b]
    return out


def test_evolution_and_guests_gain_over_best_fit():
    rng = random.Random(6)
    fit, alone, met = 0, 0, 0
    for seed in range(4):
        size = triplets(rng, 60, 1000)
        fit += len(packing.best_fit([], list(range(180)), size, 1000))
        islands = [packing.evolve(size, 1000, seed=10 * seed + k) for k in range(2)]
        alone += min(map(len, islands))
        guests = [packing.ranked(x, size)[:18] for x in islands]
        after = [packing.evolve(size, 1000, seed=50 + seed, start=islands[k], guests=guests[1 - k]) for k in range(2)]
        assert all(sorted(i for b in x for i in b) == list(range(180)) for x in after)
        met += min(map(len, after))
    assert met <= alone < fit and met < fit - 4


def test_islands_of_hard_pieces(spark, make_docs, encoder, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 60)
    rng = random.Random(7)
    texts = [" ".join("word" for _ in range(x - 1)) for x in triplets(rng, 40, 100)]
    rows = check(packing.best_fit_packing(make_docs(texts), window=100), dict(enumerate(texts)), encoder, 100)
    plain = packing.best_fit([], list(range(len(texts))), rows.sort_values("doc_id")["length"].tolist(), 100)
    assert rows["sequence_id"].nunique() <= len(plain)


def check(rows, texts_by_id, encoder, window):
    rows = rows.toPandas()
    by_seq = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, g in by_seq:
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= window
    for doc, text in texts_by_id.items():
        ids = encoder.encode([text or ""])[0] + np.array([0], "<u4").tobytes()
        g = rows[rows["doc_id"] == doc].sort_values("piece")
        assert g["length"].sum() == len(ids) // 4 and g["piece"].tolist() == list(range(len(g)))
        assert all(x == window for x in g["length"][1:]) and (len(g) == 1 or len(ids) // 4 > window)
        for r in g.itertuples():
            assert zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    return rows


def test_round_trip_and_bound(spark, sf_dir, encoder):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = check(packing.best_fit_packing(docs), {r.doc_id: r.text for r in docs.collect()}, encoder, 2048)
    assert rows["sequence_id"].nunique() <= 1.01 * -(-rows["length"].sum() // 2048) + 1


def test_many_islands(make_docs, encoder, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 20)
    rng = random.Random(4)
    texts = [" ".join("word" for _ in range(rng.randrange(1, 90))) for _ in range(150)]
    rows = check(packing.best_fit_packing(make_docs(texts), window=64), dict(enumerate(texts)), encoder, 64)
    assert rows["sequence_id"].nunique() <= 1.05 * -(-rows["length"].sum() // 64) + 1


def test_awkward_rows(awkward, no_docs):
    rows = packing.best_fit_packing(awkward).toPandas()
    assert rows[rows["piece"] == 0].shape[0] == 11
    assert rows[rows["doc_id"] == 0]["length"].tolist() == [1]
    assert packing.best_fit_packing(no_docs).count() == 0
