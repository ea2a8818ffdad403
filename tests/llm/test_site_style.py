import math
import random
from collections import Counter

import pytest
from helpers import babble

from gullwatch.llm import site_style

RNG = random.Random(3)
WORDS = [f"w{i}" for i in range(400)]


def page(i, banner="Offers of the week", extra=""):
    body = "".join(f"<p>{babble(RNG, 12, WORDS)}" for _ in range(3))
    return f"""<html><head><title>T {i}</title><style>p{{x:y}}</style></head><body><div class="top-line">{banner}</div>
    <nav><ul><li>Home<li>About</ul></nav><div id="text"><h1>Title&nbsp;{i} &amp; more</h1>{body}</div>{extra}
    <script>var a="<p>no</p>";</script><div class="comments"><p>nice {i}</p></div><footer>&copy; us</footer></body></html>"""


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS removed", "1 AS place").repartition(3)


def test_template_goes_and_text_stays(spark):
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(12)]
    got = {r.page_id: r for r in site_style.extract(pages_of(spark, rows)).collect()}
    for i in range(12):
        lines = got[i].text.split("\n")
        assert lines[0] == f"Title {i} & more" and len(lines) == 4 and got[i].n_chars == len(got[i].text)


def test_both_ways_of_removal_agree(spark):
    rows = [(i, f"https://{h}.example/{i}", page(i)) for i in range(8) for h in "ab"]
    pages = pages_of(spark, rows)
    key = lambda df: sorted((r.page_id, r.url, r.text) for r in df.collect())
    assert key(site_style.extract(pages)) == key(site_style.extract(pages, max_places=0))


def test_copies_of_an_article_are_no_template(spark):
    rows = [(i, "http://b.example/", "<nav>x</nav><article class='a'><p>Same text <b>here<br>now</p></article>") for i in range(9)]
    assert {r.text for r in site_style.extract(pages_of(spark, rows)).collect()} == {"Same text here now"}


def test_importance_equals_plain_entropies(spark):
    rows = [(i, "http://a.example/", page(i % 9, banner=f"Offer {i % 2}", extra="<section><p>Share</p></section>" if i % 3 else "")) for i in range(14)]
    html = {}
    for _, _, source in rows:
        html.setdefault(site_style.Page(source).subject(), []).append(source)
    pages, texts, layouts, shares = Counter(), Counter(), Counter(), Counter()
    for sources in html.values():
        own_pages, own_texts, own_layouts, own_share = set(), set(), set(), {}
        for source in sources:
            p = site_style.Page(source)
            total = sum(len(t) for _, t in p.blocks)
            share = Counter()
            todo = [p.root]
            while todo:
                e = todo.pop()
                own_pages.add(e.place)
                own_layouts.add((e.place, tuple(c.style for c in e.children)))
                todo += e.children
            for owner, text in p.blocks:
                own_texts.update((e.place, text) for e in owner)
                for place in {e.place for e in owner}:
                    share[place] += len(text) / total
            for place in own_pages:
                own_share[place] = max(own_share.get(place, 0), share[place])
        pages.update(own_pages)
        texts.update(own_texts)
        layouts.update(own_layouts)
        shares.update(own_share)
    got = {r.place % (1 << 64): r for r in site_style.importances(site_style.feature_counts(pages_of(spark, rows))).collect()}

    def spread(counts, place):
        own = [c for (q, _), c in counts.items() if q == place]
        return 1 - min(1, sum(c * math.log(c) for c in own) / (sum(own) * math.log(pages[place]))) if own else None

    for place, r in got.items():
        assert r.pages == pages[place]
        if r.pages >= site_style.LEAST_PAGES:
            layout, text = spread(layouts, place), spread(texts, place)
            want = layout if text is None else (1 - site_style.BELOW) * layout + site_style.BELOW * text
            assert r.entropy == pytest.approx(want)
        else:
            assert r.entropy == 1.0
        if shares[place] / pages[place] >= site_style.BULK:
            assert r.importance == pytest.approx(r.entropy)
    assert len(got) == len([p for p in pages if pages[p]]) - 3  # all but the root, html and body


def story(i):
    return "".join(f"<p>{babble(RNG, 14, WORDS)} {i}</p>" for _ in range(5))


def test_the_tree_decides_without_names(spark):
    rows, want = [], {}
    for i in range(12):
        text = story(i)
        want[i] = site_style.Page(text).main_text(set())
        rows.append((i, "http://s.example/", f"<body><div><span>Home News Sport</span></div><article>{text}<div><b>Share this story</b></div><p>Read more stories here</p></article></body>"))
    got = {r.page_id: r.text for r in site_style.extract(pages_of(spark, rows)).collect()}
    assert got == want
    assert all(site_style.Page(source).main_text(set()) != want[i] for i, _, source in rows)  # the tree removes all of it


def test_a_name_alone_removes_nothing(spark):
    rows, want = [], {}
    for i in range(12):
        text = story(i)
        want[i] = site_style.Page(text).main_text(set())
        rows.append((i, "http://n.example/", f"<body><nav><a>Home</a></nav><div class='share-price notice'>{text}</div><article>Teaser</article><footer>us {i}</footer></body>"))
    assert {r.page_id: r.text for r in site_style.extract(pages_of(spark, rows)).collect()} == want
    forms = [(i, "http://f.example/", f"<body><form id='all'><div>{story(i)}</div><div class='menu'>Home</div></form></body>") for i in range(6)]
    assert all(len(r.text.split("\n")) == 5 for r in site_style.extract(pages_of(spark, forms)).collect())


def test_a_page_alone_goes_by_its_tags(spark):
    rows = [(1, "http://one.example/", "<body><nav><ul><li>Home</ul></nav><div class=ad>Buy now</div><article><h1>Short</h1></article><footer>&copy; us</footer></body>")]
    assert [r.text for r in site_style.extract(pages_of(spark, rows)).collect()] == ["Short"]


def test_markup():
    text = lambda h: site_style.Page(h).main_text(set())
    assert text("<div>a &lt;b&gt;<p>c<p>d<ul><li>x<li>y</ul>z</div>") == "a <b>\nc\nd\nx\ny\nz"
    assert text("<!-- <p>c</p> --><p title='a>b'>x</p></i></div>y<script>") == "x\ny"
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, ""), (2, "", "<p>a"), (2, "", "<p>a"), (None, "x", "<" * 3000), (3, "http://h/", "<div>" * 3000 + "deep"), (4, "//h/p", "plain & text")]
    got = site_style.extract(pages_of(spark, rows)).collect()
    assert sorted((r.page_id or 0, r.text[:12]) for r in got) == [(0, "<" * 12), (1, ""), (1, ""), (2, "a"), (2, "a"), (3, "deep"), (4, "plain & text")]
    assert site_style.extract(pages_of(spark, rows).limit(0)).count() == 0
