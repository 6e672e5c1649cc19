"""Clusters of paragraphs against brute force where one template has hundreds of variants."""

import random

from codelode.llm import substring_dedup

from .conftest import prose


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_variants_of_a_template(make_docs):
    rng = random.Random(8)
    template = prose(rng, 40).split()
    lines = []
    for i in range(300):
        words = list(template)
        words[5 + i % 30] = f"inner{i}"  # Jaccard below 0.8 to the others
        lines.append(" ".join(words))
        if i % 10 == 0:  # and one of 0.895 to a tenth of them
            lines.append(" ".join([f"x{i}", *words[1:-1], f"y{i}"]))
    sets = [shingles(x) for x in lines]
    parent = list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    expected = {}
    for i in range(len(lines)):
        expected.setdefault(root(i), set()).add(i)
    rows = substring_dedup.repeated_passages(make_docs(lines)).toPandas()
    rows = rows[rows.kind == "paragraph"]
    got = [set(g.doc_id) for _, g in rows.groupby("cluster_id")]
    assert sorted(map(sorted, got)) == sorted(sorted(x) for x in expected.values() if len(x) > 1)
