"""Template classes against brute force, and the slots that are extracted."""

import collections
import random

from braidwork.llm import op10_extract
from pyspark.sql import functions as F


def extracted(spark, pages, **options):
    df = spark.createDataFrame([(i, "http://h.io/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in op10_extract.extract(df, **options).collect()}


def test_short_slots_and_long_tokens(spark):
    # A headline far shorter than a tenth of the body, and a token over 160 characters around text that is the same on all pages.
    long = "k" * 200
    page = "<div class='page'><h1 class='title'>Headline {0}</h1><div class='%s'>Same on all</div><div class='body'>{1}</div></div>" % long
    got = extracted(spark, [page.format(i, f"word{i} " * 300) for i in range(4)])
    for i, text in got.items():
        assert text == f"Headline {i}\n\n" + " ".join([f"word{i}"] * 300)


def brute_classes(pages):
    """Exact occurrence vectors: {frozenset of tokens} of the elements on SUPPORT pages at least, and the texts on all."""
    counts = [collections.Counter((t, x) for _, t, x in op10_extract.events(*op10_extract.page_tokens(h or ""))) for h in pages]
    counts = [c for c in counts if any(x for _, x in c)]
    by = collections.defaultdict(set)
    for key in set().union(*counts):
        vector = tuple(c[key] for c in counts)
        have = sum(map(bool, vector))
        if have >= op10_extract.SUPPORT and (not key[1] or have == len(counts)):
            by[vector].add(key[0])
    return {frozenset(v) for v in by.values()}


def test_classes(spark):
    rng = random.Random(3)
    item = lambda: "<li><a href='/x'>%s</a></li>" % rng.choice(["one", "two", "three"])
    pages = [None, "", "<div></div>"]
    for i in range(9):
        extra = "<div class='sale'>Buy %d</div>" % i if i % 2 else ""
        body = "".join(f"<p>word{i} {k}<br>" for k in range(rng.randrange(1, 4))) + ("<blockquote>q</blockquote>" if i == 2 else "")
        pages.append(f"<body><nav><ul>{''.join(item() for _ in range(rng.randrange(1, 5)))}</ul></nav>{extra}<main><h1>H {i}</h1><div class='n'>The same everywhere</div>{body}</main><footer>f</footer></body>")
    pages += pages[-2:]  # rows that repeat do not cancel out
    df = spark.createDataFrame([(i % 10, "http://h.io/", h, "h.io", 5) for i, h in enumerate(pages)], "page long, url string, html string, host string, token int")
    found = op10_extract.templates(df).collect()
    got = collections.defaultdict(set)
    for x in found[0].template:
        got[x["class"]].add(x.token)
    assert len(found) == 1 and {frozenset(v) for v in got.values()} == brute_classes(pages)
    assert len(got) >= 3


def test_order(spark):
    # Two elements that change places on half of the pages are no template together; the others stay.
    a, b = "<div class='a'>x {0}</div>", "<div class='b'>y {0}</div>"
    pages = [f"<body><h1>{i}</h1>{(a + b if i % 2 else b + a).format(i)}<div class='z'>z {i}</div></body>" for i in range(6)]
    template = [{"class": 1, "at": k, "token": t} for k, t in enumerate(dict.fromkeys(t for _, t, x in op10_extract.events(*op10_extract.page_tokens(pages[1])) if not x))]
    assert not op10_extract.disordered(op10_extract.events(*op10_extract.page_tokens(pages[3])), template)
    assert len(op10_extract.disordered(op10_extract.events(*op10_extract.page_tokens(pages[2])), template)) == 1


def test_template_decides(spark):
    # In a content element: what is the same on all pages is template, whatever its name; an odd page takes nothing away.
    page = "<body><main><div class='x'>Read this first</div><h1>Title {0}</h1><p>Text {0}<p class='share-price'>Price {0}</main></body>"
    pages = [page.format(i) for i in range(4)] + [None, ""]
    got = extracted(spark, pages)
    assert got == {i: f"Title {i}\n\nText {i}\n\nPrice {i}" for i in range(4)} | {4: "", 5: ""}
    assert extracted(spark, pages, deduce=False)[0] == "Read this first\n\nTitle 0\n\nText 0\n\nPrice 0"
    # Copies of one page only: nothing tells what is template.
    assert extracted(spark, [page.format(1)] * 5)[2] == "Read this first\n\nTitle 1\n\nText 1\n\nPrice 1"


def test_menus_without_names(spark):
    page = "<body><div class='x1'><a href='/a'>Link {0}</a> <a>more</a></div><div class='x2'>Text {0} of the page</div><div class='left-sidebar'>s {0}</div></body>"
    assert extracted(spark, [page.format(i) for i in range(4)])[3] == "Text 3 of the page"


def test_names(spark):
    got = extracted(spark, ["<article class='related'><div class='post-header'><h1>T</h1></div><p class='share-price'>P<p>Q<button>b</button> R<div class='comments'>no</div></article><aside><article>no</article></aside>"])
    assert got[0] == "T\n\nP\n\nQ R"


def test_odd(spark):
    df = spark.createDataFrame([(None, None, "<p>a&amp;b", "t", 1), (1, "no scheme", "<p>x</p>" * 3, "t", 2)], "page_id long, url string, html string, template string, host int")
    assert {r.page_id: r.text for r in op10_extract.extract(df).collect()} == {None: "a&b", 1: "x\n\nx\n\nx"}
    assert op10_extract.extract(df.limit(0)).count() == 0
    long = "<p>" + "w " * 200_000 + "</p>" + "<div>" * 300 + "end"
    wide = df.select(F.lit(5).alias("page_id"), F.lit("http://a/").alias("url"), F.lit(long).alias("html")).limit(1)
    assert len(op10_extract.extract(wide).first().text) == 399_999 + 5


def test_salted_join(spark, monkeypatch):
    page = "<body><main><div>Same</div><p>Text {0}</main></body>"
    pages = [page.format(i) for i in range(30)]
    monkeypatch.setattr(op10_extract, "BROADCAST_TOKENS", 0)
    assert extracted(spark, pages) == {i: f"Text {i}" for i in range(30)}
