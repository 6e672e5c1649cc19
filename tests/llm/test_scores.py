"""Language ID and toxicity: held-out accuracy, automata, awkward rows."""

import random
import zlib

import numpy as np

from codelode.llm import language_id, toxicity

from .conftest import prose

SYLLABLES = {"xx": ["ka", "ri", "to", "mon"], "yy": ["esch", "ung", "ver", "lich"], "zz": ["oua", "eau", "ille", "que"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages(make_docs):
    rng = random.Random(6)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(240)]
    docs = make_docs([speech(rng, x, rng.choice([6, 20, 200])) for x in langs], langs)
    rows = language_id.identify_language(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 240 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_ignores_held_out_labels(make_docs):
    rng = random.Random(6)
    langs = ["xx" if i % 2 else "yy" for i in range(120)]
    texts = [speech(rng, x, 30) for x in langs]
    wrong = ["zz" if zlib.crc32(str(i).encode()) % 3 == 1 else x for i, x in enumerate(langs)]
    a, b = (sorted(tuple(r) for r in language_id.identify_language(make_docs(texts, x)).collect()) for x in (langs, wrong))
    assert a == b


def test_language_awkward(awkward, no_docs, make_docs):
    rows = language_id.identify_language(awkward).collect()
    assert len(rows) == 11
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {0, 1, 2, None}
    assert language_id.identify_language(no_docs).count() == 0
    kept = language_id.identify_language(awkward, keep=True)
    assert kept.count() == 11 and "component_id" in kept.columns
    nothing = language_id.identify_language(make_docs(["abc", "1234"], [None, None])).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(7)
    terms = {"idiot": 1, "pathetic": 1, "worthless": 1, "scum": 1, "lowei": 2, "stupidx": 2}
    machine = toxicity.Automaton(terms)
    letters = "idotpahecwrlsumex"
    for _ in range(4000):
        word = list(rng.choice(list(terms)))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randrange(2)] = rng.choice(letters) if rng.random() < 0.7 else ""
        word = "".join(word)
        if not word:
            continue
        exact = any(k == 1 and word == t for t, k in terms.items())
        stem = any(k == 2 and word.startswith(t) for t, k in terms.items())
        near = any(k == 1 and distance(word, t) <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2) for t, k in terms.items())
        near |= any(k == 2 and len(t) >= 7 and any(distance(word[:n], t) <= 1 for n in range(len(word) + 1)) for t, k in terms.items())
        assert machine.match(word) == (1 if exact else 2 if stem else 3 if near else 0), word


def test_quotation():
    words = 'she said "you idiot" and left without a word to anyone in there'.split()
    at = [i for i, w in enumerate(words) if toxicity.quotation(words)[i]]
    assert 3 in at and not any(toxicity.quotation("you are an idiot and a fool".split()))
    # between two quotations is not quoted, and an open mark alone quotes nothing
    between = '"hello there" you idiot get lost "bye now"'.split()
    assert [i for i, q in enumerate(toxicity.quotation(between)) if q] == [0, 1, 6, 7]
    assert toxicity.context(between, 3, False) == 0 and not any(toxicity.quotation('"you idiot get lost'.split()))
    near, far = "he said you idiot".split(), "he said that it was you idiot".split()
    assert 1 > toxicity.context(near, 3, False) > toxicity.context(far, 6, False) > 0


def test_toxicity(spark, make_docs):
    rng = random.Random(8)
    bad = ["grumbo", "flarnix", "skoodle"]
    texts, toxic = [], []
    for i in range(600):
        words = prose(rng, rng.randrange(5, 80)).split()
        toxic.append(int(i % 6 == 0))
        if toxic[-1]:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
    texts += ["", None, "one flarnxi here grumbo", "plain text of nothing"]
    docs = make_docs(texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [i for i in range(600) if rows[i].held_out]
    assert np.mean([rows[i].predicted == toxic[i] for i in held]) >= 0.98
    assert all(rows[i].predicted == int(rows[i].score >= 0.7) and 0 <= rows[i].score <= 1 for i in rows)
    assert rows[600].predicted == rows[601].predicted == rows[603].predicted == 0 and rows[602].predicted == 1


def test_toxicity_awkward(spark, awkward, no_docs):
    labels = spark.createDataFrame([(4, 1, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(awkward, labels).count() == 11
    assert toxicity.score_toxicity(no_docs, labels).count() == 0
    assert {r.score < 1e-9 for r in toxicity.score_toxicity(awkward, labels.limit(0)).collect()} == {True}
