"""The host's wrapper decides the text of its pages, inside a marked article too."""

import random

from codelode.llm import html_extraction as pages_

from .conftest import prose


def page(rng, i, extra=""):
    paragraphs = "".join(f"<p>{prose(rng, 12)}</p>" for _ in range(2 + i % 4))
    return f"<body><article><h1>{prose(rng, 4)}</h1><div>Read us every day</div>{paragraphs}<p>Tell your friends</p>{extra}<h2>Terms</h2><ul><li>same item</li><li>{prose(rng, 3)}</li></ul></article></body>"


def test_wrapper_decides_in_the_article(spark):
    rng = random.Random(4)
    rows = [(i, f"https://a.example.org/{i}", page(rng, i, f"<blockquote>{prose(rng, 9)}</blockquote>" if i % 5 == 0 else "")) for i in range(40)]
    got = pages_.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()
    html = {i: x for i, _, x in rows}
    for r in got:
        expected = [b.text for b in pages_.blocks(html[r.page_id]) if b.text not in ("Read us every day", "Tell your friends")]
        assert r.text.split("\n\n") == expected  # the heading over the list and the item that comes again stay


def test_all_pages_take_part(spark):
    """A text that only the last pages change is no template, and a part of any length may be optional."""
    rows = [(i, f"https://a.example.org/{i}", f"<article><h1>Head {i}</h1><div>{'Stated' if i else 'Changed'} here</div><p>Body of {i} is long enough</p></article>") for i in range(30)]
    rows += [(100 + i, f"https://b.example.org/{i}", f"<article><h1>Head {i}</h1>{'<div><b>x</b></div><hr><section>y</section>' * (70 * (i % 2))}<p>Body of {i} is long enough</p><div>Fixed</div></article>") for i in range(6)]
    got = {r.page_id: r.text.split("\n\n") for r in pages_.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i][1] == ("Stated here" if i else "Changed here") for i in range(30))
    assert all("Fixed" not in got[100 + i] for i in range(6)) and len(got[101]) == 142


def test_copies_are_no_template():
    rng = random.Random(5)
    body = "".join(f"<p>{prose(rng, 20)}</p>" for _ in range(5))
    versions = [f"<article><h1>Title</h1>{body}<p>Version {i}</p></article>" for i in range(4)]
    assert pages_.main_text(versions[0], wrapper=pages_.infer(versions)) == pages_.main_text(versions[0])


def test_wrappers_merge():
    rng = random.Random(6)
    pages = [page(rng, i) for i in range(12)]
    halves = [pages_.read(pages_.dump(pages_.infer(x))) for x in (pages[:6], pages[6:])]
    assert pages_.template_texts(pages_.align(*halves)) == pages_.template_texts(pages_.infer(pages)) == ["Read us every day", "Tell your friends", "Terms"]


def test_pages_without_an_article_mark():
    items = "".join(f"<li>a long item of the list, number {i}</li>" for i in range(9))
    text = pages_.main_text(f"<body><nav>Home</nav><div><p>Intro</p><section><p>{'word ' * 60}</p></section><p>before</p><ul>{items}</ul><p>after</p></div></body>")
    parts = text.split("\n\n")
    assert parts[0] == "Intro" and parts[2] == "before" and parts[-1] == "after" and len(parts) == 13


def test_names_inside_an_article():
    rng = random.Random(9)
    head = '<h2 id="related-work">Prior</h2><section id="search-methods"><p>How</p></section><section id="legal-basis"><p>Law</p></section><p class="side note">Aside</p>'
    figure = "<figure><figcaption>Caption</figcaption></figure><p>Let <math><mi>x</mi></math> be</p>"
    one = pages_.main_text(f"<article>{head}{figure}<div class='share-buttons'>Share</div></article>")
    assert one.split("\n\n") == ["Prior", "How", "Law", "Aside", "Caption", "Let x be"]
    pages = [f"<article><p>{prose(rng, 30)}</p><div class='share'>Share this</div><div class='related'>{prose(rng, 5)}</div></article>" for _ in range(4)]
    text = pages_.main_text(pages[0], wrapper=pages_.infer(pages))
    assert len(text.split("\n\n")) == 2 and "Share this" not in text  # named only is no evidence
