"""Vector search against brute force; page texts; substring dedup; token rollups."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import html_extraction as pages_
from codelode.llm import substring_dedup, token_counts, vector_search
from codelode.session import scratch_folder

from .conftest import prose


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, queries, k):
    ok = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in queries:
        if q in ok:
            scored = sorted((-float((ok[q] * v).sum()), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out[q] = [i for _, i in scored[:k]]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_exact_search(spark, scale):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.2 * rng.normal(size=16)).astype(np.float32).tolist(), 0) for i in range(1500)]
    if scale:
        rows = [(i, [float(np.float32(x * (1 + i % 5))) for x in v], 0) for i, v, _ in rows]
    rows += [(2000 + i, rows[7][1], 0) for i in range(60)]  # ties
    got = vector_search.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=20, factor=1.0, shard_rows=400, block_rows=16).toPandas()
    expected = brute(rows, [i for i, *_ in rows if i % 50 == 0], 20)
    assert {q: g.sort_values("rank").vec_id.tolist() for q, g in got.groupby("query_id")} == expected
    relaxed = vector_search.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=20, factor=1.05, shard_rows=400).toPandas()
    hits = sum(len(set(g.vec_id) & set(expected[q])) for q, g in relaxed.groupby("query_id"))
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 0), (20, None, 0), (40, [0.0, 0.0], 0), (60, [1.0, None], 0), (80, [float("nan"), 1.0], 0), (1, [2.0, 1.0], 0), (100, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0), (1, [2.0, 1.0], 0), (120, [], 0)]
    got = vector_search.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 4.0)]
    assert vector_search.nearest_neighbours(vectors(spark, [])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body class="page">
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy {0}</div><aside>Side</aside>
<article><h1>Title {0} &lt;x&gt;</h1><p>First  <b>bold</b>
 text&nbsp;{0}.<br>After<!-- gone --> it<p>Second &#233; {0}</p><form><input value="x"><label>Mail</label></form>
<ul><li>one<li>two {0}</ul><div class="share-buttons">Share</div><section id="comments"><p>Nice!</p></section><pre>a
  b</pre></article><footer>&copy; Site</footer></body></html>"""


def test_main_text():
    text = pages_.main_text(PAGE.format(7))
    assert text.split("\n\n") == ["Title 7 <x>", "First bold text 7. After it", "Second é 7", "one", "two 7", "a b"]
    for broken in ("", None, "<", "<p", "<!--", "<script>x", "&#99999999;", "</div></p>", "<p>" * 2000):
        assert isinstance(pages_.main_text(broken), str)
    assert pages_.main_text("just text &amp; more") == "just text & more"


def test_wrapper_inference():
    page = lambda n, extra="": f"<body><div class='top'>Welcome</div><div><h1>Head {n}</h1>{extra}<p>Body {n}</p></div><div>Fixed end</div></body>"
    wrapper = pages_.infer([page(1), page(2, "<p>more</p>"), page(3)])
    assert pages_.template_texts(wrapper) == ["Welcome", "Fixed end"]
    assert ("slot",) in wrapper and any(x[0] in ("maybe", "many") for x in wrapper)
    folded = pages_._fold(pages_.page_stream("<ul><li>a</li><li>b</li><li>c</li></ul>"))
    assert [x[0] for x in folded] == ["tag", "many", "tag"]
    text = pages_.main_text(page(4), frozenset(pages_.template_texts(wrapper)))
    assert text == "Head 4\n\nBody 4"


def test_pages(spark):
    rows = [(i, f"https://a.example.org/{i}", PAGE.format(i)) for i in range(12)] + [(50, None, PAGE.format(50)), (51, "https://a.example.org/51", None), (52, "no url", ""), (0, "https://a.example.org/0", PAGE.format(0)), (None, "https://b.example.org/", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = pages_.extract_main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert texts[3] == pages_.main_text(PAGE.format(3)) and texts[51] == "" and texts[52] == "" and texts[None] == "x"
    assert pages_.extract_main_text(df.limit(0)).count() == 0


def test_repeats(make_docs):
    rng = random.Random(2)
    para = [prose(rng, 60) for _ in range(4)]
    edited = para[0].split()
    edited[30] = "zzz"
    inline = prose(rng, 55)
    texts = [f"{prose(rng, 40)}\n{para[0]}\n{prose(rng, 30)}", f"{para[0]}\n{prose(rng, 50)}", f"{prose(rng, 25)}\n{' '.join(edited)}", f"{prose(rng, 45)} {inline} {prose(rng, 45)}", f"{prose(rng, 80)} {inline} {prose(rng, 20)}"]
    texts += [prose(rng, rng.randrange(30, 200)) for _ in range(40)]
    rows = substring_dedup.repeated_passages(make_docs(texts)).toPandas()
    assert set(rows.doc_id) == {0, 1, 2, 3, 4}
    lines = rows[rows.kind == "paragraph"]
    assert lines.cluster_id.nunique() == 1 and set(lines[lines.removed].doc_id) == {1, 2}
    assert (lines[lines.doc_id == 0].start_word.iloc[0], lines[lines.doc_id == 0].n_words.iloc[0]) == (40, 60)
    words = {i: re.split(r"\s+", t) for i, t in enumerate(texts)}
    for r in rows[rows.kind == "passage"].itertuples():
        run = " ".join(words[r.doc_id][r.start_word : r.start_word + r.n_words])
        assert run in inline
    assert rows[(rows.kind == "passage") & ~rows.removed].doc_id.tolist() == [3]


def test_repeats_awkward(awkward, no_docs):
    rows = substring_dedup.repeated_passages(awkward).toPandas()
    assert set(rows.doc_id) == {4, 5, 6} and set(rows[rows.removed].doc_id) == {5, 6}
    assert substring_dedup.repeated_passages(no_docs).count() == 0


def test_rollup(spark, make_docs):
    pytest.importorskip("public_tokenizers")
    root = scratch_folder(spark, "rollup-test")
    rollup = token_counts.TokenRollup(spark, root)
    docs = make_docs(["one two", "three", None, "", "four five six"], ["en", "en", None, "fr", "fr"]).withColumn("n_tokens", F.lit("clash"))
    totals = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert rollup.totals().count() == 0
    assert rollup.commit(0, docs.withColumn("op", F.lit("insert")))
    first = totals()
    assert first == {("src0", "en"): (1, 2), ("src1", "en"): (1, 1), ("src2", None): (1, 0), ("src0", "fr"): (1, 0), ("src1", "fr"): (1, 3)}
    changes = docs.where("doc_id = 0").withColumn("text", F.lit("one two three four")).withColumn("op", F.lit("revise"))
    changes = changes.union(docs.where("doc_id = 1").withColumn("op", F.lit("delete"))).union(docs.limit(1).withColumn("doc_id", F.lit(99).cast("long")).withColumn("op", F.lit("delete")))
    assert rollup.commit(1, changes) and not rollup.commit(1, changes) and not rollup.commit(0, docs.withColumn("op", F.lit("insert")))
    after = totals()
    assert after[("src0", "en")] == (1, 4) and ("src1", "en") not in after
    assert rollup.commit(2, docs.limit(0).withColumn("op", F.lit("insert"))) and totals() == after
    # the same insert again revises, it doesn't count twice; a null id counts each time
    again = docs.where("doc_id = 4").withColumn("op", F.lit("insert"))
    rollup.commit(3, again.union(again).union(again.withColumn("doc_id", F.lit(None).cast("long"))))
    assert totals()[("src1", "fr")] == (2, 6)


def test_rollup_against_a_dictionary(spark):
    pytest.importorskip("public_tokenizers")
    rollup = token_counts.TokenRollup(spark, scratch_folder(spark, "rollup-random"))
    rng, live, loose = np.random.default_rng(4), {}, {}
    for batch, (low, high) in enumerate([(0, 40), (40, 60), (10, 50), (100, 101), (0, 60), (30, 45)]):
        ids = sorted({int(x) for x in rng.integers(low, high, 25)})
        rows = [(i, " ".join("a" * int(rng.integers(0, 9))), f"s{rng.integers(3)}", [None, "en"][rng.integers(2)], ["insert", "revise", "delete"][rng.integers(3)]) for i in ids]
        rows.append((None, "a a", "s0", "en", "insert"))
        assert rollup.commit(batch, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, op string"))
        for i, text, source, lang, op in rows:
            if op == "delete":
                live.pop(i, None)
            elif i is None:
                loose[batch] = (source, lang, len(text.split()))
            else:
                live[i] = (source, lang, len(text.split()))
        expected = {}
        for source, lang, n in [*live.values(), *loose.values()]:
            docs, tokens = expected.get((source, lang), (0, 0))
            expected[source, lang] = (docs + 1, tokens + n)
        assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == expected


def test_rollup_query_equals_recount(spark, sf_dir):
    pytest.importorskip("public_tokenizers")
    from collections import Counter

    from codelode.llm import queries, tokens

    with open(tokens.default_path(), "rb") as f:
        encode = tokens.PieceEncoder(f.read()).encode
    n_docs, n_tokens = Counter(), Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "source", "lang").collect():
        n_docs[r.source, r.lang] += 1
        n_tokens[r.source, r.lang] += len(encode([r.text or ""])[0]) // 4
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in queries.op4_token_counts(spark, sf_dir).collect()}
    assert got == {k: (n_docs[k], n_tokens[k]) for k in n_docs}
