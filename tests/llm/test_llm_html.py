"""Main text: messages against enumeration, held-out pages of other layouts, broken markup."""

import itertools
import random
from collections import Counter
from math import exp, isclose

import pytest
from pyspark.sql import functions as F
from tapewatch.llm import html_text as h


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
            f'<body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav><div class="ad">Buy this now.</div>'
            f'<article><h1>{title}</h1>{body}{extra}</article><footer>&copy; example</footer></body></html>')


@pytest.fixture(scope="module")
def model():
    counts = Counter()
    for i in range(60):
        counts.update(h.count_page(page(f"Title {i}", [f"Sentence {j} of the text, which goes on." * (1 + j) for j in range(i % 7)])))
    return h.Potentials.trained(counts)


def test_marginals_are_those_of_all_labelings(model, monkeypatch):
    monkeypatch.setattr(h, "MARKED", 5.0)
    monkeypatch.setattr(h, "KNOWN", 30.0)
    random.seed(1)
    for _ in range(25):
        nodes = [h.Node("html", -1)]
        for i in range(1, random.randint(2, 9)):
            at = random.randrange(i)
            nodes.append(h.Node(random.choice(["p", "div", "li", "article", "body", "h1"]), at, chars=random.randint(0, 300),
                                inside_main=nodes[at].tag == "article"))
        nodes[0].chars = 10
        total, content = 0.0, [0.0] * len(nodes)
        for y in itertools.product((0, 1), repeat=len(nodes)):
            w = sum(y[i] * (h.prior(n) + sum(model.evidence.get(f, 0.0) for f in h.node_features(n))) for i, n in enumerate(nodes))
            w += sum(model.pair[h.parent_kind(nodes[n.parent])][y[n.parent]][y[i]] for i, n in enumerate(nodes) if n.parent >= 0)
            total += exp(w)
            for i, v in enumerate(y):
                content[i] += v * exp(w)
        for got, c in zip(h.marginals(nodes, model), content):
            assert isclose(got, c / total, rel_tol=1e-6, abs_tol=1e-9)


@pytest.mark.parametrize("html,want", [
    (page("A &amp; B", ["One  two\n three", "Four<br>five"]), "A & B\nOne two three\nFour five"),
    ("<body><div class='menu'><a href=x>Menu</a></div><div class=story><h1>Head</h1><p>A long story that goes on and on for a while."
     "</p><p>It has an end.</p></div><div id=sidebar><p>Other things that are long enough to look like a story.</p></div></body>",
     "Head\nA long story that goes on and on for a while.\nIt has an end."),
    (page("T", ["Body text is here."], "<div class='comments'>" + "<p>What a great article, I like it very much.</p>" * 30 + "</div>"),
     "T\nBody text is here."),
    (page("T", ["Body text is here."], "<form><p>Your name</p><input></form><aside>Note</aside><script>if (a<b) x()</script>"),
     "T\nBody text is here."),
    (page("T", ["Body text is here."], "<ol id=commentlist><li>So true, I say, so true.</li></ol><p hidden>No</p><p style='display: none'>No</p>"
          "<p style='overflow:hidden'>Yes, this too.</p>"), "T\nBody text is here.\nYes, this too."),
    ("<article><h1>Open</h1><p><b>Bold<br><p>Next <i>one<p>Last", "Open\nBold\nNext one\nLast"),
    ("<article><ul><li>One<li>Two</ul><table><tr><td>A<td>B</table><p>An end", "One\nTwo\nA\nB\nAn end"),
    ("<article><p>Cut &am", "Cut &am"), ("<article><p>x <a href='a>b'>y</a> z</p><!-- <p>no</p> --></article>", "x y z"),
    ("<article><header><h1>The Title</h1></header><p>Text.</p></article><header>Site</header>", "The Title\nText."),
    ("no markup at all", "no markup at all"), ("<p>only a paragraph", "only a paragraph"),
    ("<div>Text that comes before it,<p>a paragraph within it that is of some length</p>and what comes after it.</div>",
     "Text that comes before it,\na paragraph within it that is of some length\nand what comes after it."),
    ("", ""), (None, ""), ("<", "<"), ("<html><body><nav>Menu</nav></body></html>", ""), ("</p></div>", ""),
])
def test_main_text(model, html, want):
    assert h.main_text(html, model) == want


def test_without_training():
    model = h.Potentials.trained({})
    assert h.main_text(page("T", ["Some text."]), model) == "T\nSome text."


def test_long_and_deep_pages(model):
    assert len(h.main_text("<article>" + "<p>word " * 20_000, model).split("\n")) == 20_000
    assert h.main_text("<div>" * 5 + "a deep text of some words, deep down", model) == "a deep text of some words, deep down"
    assert "deep" in h.main_text("<div>" * 5000 + "<article>deep down", model)
    assert h.main_text("<a href=\"" * 3000, model) == ""


def test_query_over_pages(spark, tmp_path):
    rows = [(i, f"u{i}", page(f"Title {i}", [f"Paragraph {j}, with words." for j in range(i % 5)])) for i in range(40)]
    rows += [(41, None, None), (None, "u", "<article><p>x"), (3, "u3", rows[3][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in h.op3_dom_messages(spark, str(tmp_path)).collect())
    want = Counter()
    for i, url, _ in rows:
        lines = ["x"] if i is None else [] if i == 41 else [f"Title {i}", *(f"Paragraph {j}, with words." for j in range(i % 5))]
        want[(i, url, "\n".join(lines), len("\n".join(lines)))] += 1
    assert got == want


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert h.extract(empty, h.train(empty)).count() == 0


STORY = "A paragraph of the story, which is long enough to be one and goes on for a while."


@pytest.mark.parametrize("name", ["related-work", "search", "response", "notice-of-changes", "header-files", "social-history"])
def test_generated_ids_of_headings(model, name):
    html = page("T", [STORY], f"<h2 id='{name}'>A heading</h2><p>{STORY}</p>")
    assert h.main_text(html, model) == f"T\n{STORY}\nA heading\n{STORY}"


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "with-sidebar", "has-header", "hasSidebar", "sidebar-layout",
                                  "overflow-hidden"])
def test_names_of_layouts(model, name):
    html = (f"<body><div class='{name}'><div class=menu><a href=x>Menu</a></div><div class=story><h1>Head</h1><p>{STORY}</p>"
            f"<p>{STORY}</p></div><div id=sidebar><p>{STORY}</p></div></div></body>")
    assert h.main_text(html, model) == f"Head\n{STORY}\n{STORY}"


def test_titles_captions_and_forms_without_main_element(model):
    caption = "<figure><img src=x><figcaption>A caption of it</figcaption></figure>"
    for html in (f"<body><div class=story><header><h1>Head</h1></header><p>{STORY}</p>{caption}</div><footer>End</footer></body>",
                 f"<body><header>Site</header><form id=page><nav><a href=x>Home</a></nav><div><h1>Head</h1><p>{STORY}</p>{caption}"
                 "</div><form><p>Your name</p></form><div class=footer>End</div></form></body>"):
        assert h.main_text(html, model) == f"Head\n{STORY}\nA caption of it"


@pytest.mark.parametrize("count", [1, 40])
def test_named_parts_stay_out(model, count):
    """However much they hold, beside the story and in it."""
    part = f"<div class=comments><h2>Comments</h2>{f'<div><p>{STORY * 3}</p></div>' * count}</div>"
    assert h.main_text(page("T", ["Body text is here."], part), model) == "T\nBody text is here."
    assert h.main_text(f"<body><div><h1>T</h1><p>{STORY}</p></div>{part}</body>", model) == f"T\n{STORY}"
    assert h.main_text(page("T", []).replace("Buy this now.", STORY * count), model) == "T"


@pytest.mark.parametrize("part", [
    "<section class=comments>{}</section>", "<div id=related>{}</div>", "<aside>{}</aside>", "<footer><div>{}</div></footer>", "{}"])
@pytest.mark.parametrize("count", [1, 40])
def test_articles_of_other_parts(model, part, count):
    """Comments and teasers that are articles: nested, beside the story, with and without a name of their own."""
    for name in ["", " class='comment even'"] if part != "{}" else [" class='comment even'"]:
        items = part.format(f"<article{name}><header>Ann</header><h3>Answer</h3><p>{STORY}</p></article>" * count)
        assert h.main_text(page("T", ["Body text is here."], items), model) == "T\nBody text is here."
        beside = page("T", ["Body text is here."]).replace("<footer>", f"{items}<footer>")
        assert h.main_text(beside, model) == "T\nBody text is here."
        assert h.count_page(beside)["1 tag article"] == 1
        assert h.main_text(f"<main><h1>T</h1><p>{STORY}</p>{items}</main>", model) == f"T\n{STORY}"


def test_names_of_the_article_itself(model):
    html = page("T", [STORY]).replace("<article>", "<article class='post has-comments tag-advertising category-social'>")
    assert h.main_text(html, model) == f"T\n{STORY}"


FACTS = "".join(f"<li>Fact {i}</li>" for i in range(5))
REFERENCES = "".join(f"<li><a href=x>Reference {i}</a></li>" for i in range(5))


@pytest.mark.parametrize("html,want", [
    (f"<body><div class=menu><a href=x>Menu</a></div><div><h1>Head</h1><p>{STORY}</p><ul>{FACTS}</ul><p>{STORY}</p></div></body>",
     ["Head", STORY, *(f"Fact {i}" for i in range(5)), STORY]),
    (page("T", [STORY], f"<ul>{REFERENCES}</ul>"), ["T", STORY, *(f"Reference {i}" for i in range(5))]),
    ("<article><p>Energy <math><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation>no</annotation></math> is here.</p></article>",
     ["Energy E=m is here."]),
    ("<article><p>One.</p><script src='a.js'/>var x=1;</script><p>Two.</p><script src='b.js'/><p>Three.</p></article>",
     ["One.", "Two.", "Three."]),
    (f"<article><h1>T</h1><p class=promo>{STORY}</p><p class=comment>{STORY}</p><p class=ad>Buy this now.</p><p>{STORY}</p></article>",
     ["T", STORY, STORY]),
    (f"<main><h1>T</h1><div class=notice-board><p>{STORY}</p><p>{STORY}</p></div></main>", ["T", STORY, STORY]),
    (f"<main><h1>T</h1><p>{STORY}</p><div class=notice><p>{STORY}</p></div></main>", ["T", STORY]),
    (f"<table><tr><td><a href=x>Home</a> <a href=y>Prod</a></td></tr><tr><td><h1>Head</h1><p>{STORY}</p></td></tr></table>",
     ["Head", STORY]),
    (f"<body><div><h1>Head</h1><p>{STORY}</p></div><div><p>All rights reserved.</p></div><p>&copy; 2020 Us</p></body>", ["Head", STORY]),
    ("<article><h1>Head</h1><p>All rights reserved, it says.</p></article>", ["Head", "All rights reserved, it says."]),
    (f"<body><div><h1>Head</h1><p>{STORY}</p></div><div class=discussion><p>{STORY}</p></div></body>", ["Head", STORY]),
    (f"<article><section id=discussion><h2>Discussion</h2><p>{STORY}</p></section></article>", ["Discussion", STORY]),
])
def test_layouts_that_training_does_not_show(model, html, want):
    assert h.main_text(html, model).split("\n") == want


def test_clashing_columns_are_replaced(spark, model):
    df = spark.createDataFrame([(1, "<article><p>x", "old", 99)], "page_id long, html string, text string, n_chars long")
    assert [tuple(r) for r in h.extract(df, model).collect()] == [(1, "x", 1)]
