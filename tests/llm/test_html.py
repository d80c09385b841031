"""Template deduction against the same rules in plain Python, and pages whose names say nothing."""

import random
import re
import time
from collections import defaultdict

import pytest

from seqloom.llm import html_text


def brute(rows):
    """Texts of (page_id, url, html) rows, host by host in one place."""
    by, out = defaultdict(list), {}
    for i, url, page in rows:
        by[((re.match(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "") or [None, ""])[1] or "").lower()].append((i, page or ""))
    for pages in by.values():
        different = {p for _, p in pages}
        vectors, places, tags = defaultdict(dict), defaultdict(list), {}
        for p in different:
            found = html_text.page_tokens(p)
            for k, (h, tag) in enumerate(found):
                if h not in vectors or p not in vectors[h]:
                    places[h].append((k << 20) // len(found))
                vectors[h][p] = vectors[h].get(p, 0) + 1
                tags[h] = tag
        classes = defaultdict(list)
        for h, v in vectors.items():
            if len(different) >= html_text.PAGES and len(v) >= html_text.SHARE * len(different) and set(v.values()) == {1}:
                classes[frozenset(v)].append(h)
        ordered = sorted((sum(places[h]) / len(places[h]), h, tags[h]) for v in classes.values() if len(v) >= html_text.CLASS for h in v)
        template = html_text.Template([(h, tag) for _, h, tag in ordered]) if ordered else None
        if template:
            sums = defaultdict(lambda: [0, 0, -1])
            for _, p in pages:
                for place, plain, link, up in html_text.slot_sums(p, template):
                    v = sums[place]
                    sums[place] = [v[0] + plain, v[1] + link, max(v[2], up)]
            template.article = html_text.article_of([(k, *v) for k, v in sums.items()])
            template = template if template.article is not None else None
        out |= {i: html_text.main_text(p, template) for i, p in pages}
    return out


def got(spark, rows):
    schema = "page_id long, url string, html string, host string, template string, h long"
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema).repartition(4)).collect()}


def words(r, n):
    return " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(n))


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_against_brute_force(spark, broadcast, monkeypatch):
    monkeypatch.setattr(html_text, "TEMPLATE_ROWS", broadcast)
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rows += [(10_000 + i, u, p) for i, (_, u, p) in enumerate(rows[:9])] + [(20_000, None, "<p>x"), (20_001, rows[0][1], None), (20_002, rows[0][1], "")]
    assert got(spark, rows) == brute(rows)


def test_template_decides_where_names_say_nothing(spark):
    r = random.Random(6)
    rows, want = [], {}
    for i in range(12):
        title, lead, text, end = words(r, 4), words(r, 9), [words(r, 60) for _ in range(3)], words(r, 3)
        side, links = words(r, 12), "".join(f"<li><a href=/{k}>{words(r, 3)}</a></li>" for k in range(6))
        body = f"<div class=a1><p>Same line</p><span>{side}</span></div><div class=b2><ul>{links}</ul></div><div class=c3><h1>{title}</h1><p class=l>{lead}</p><div class=d4>" + "".join(f"<p>{t}</p>" for t in text) + f"<p>Share this page</p></div><div class=e5>{end}</div></div><div class=f6>{words(r, 8)}</div>"
        rows.append((i, "http://plain.example/x", f"<html><body>{body}</body></html>"))
        want[i] = "\n".join([title, lead, *text, end])
    assert got(spark, rows) == want
    assert all(html_text.main_text(p, html_text.Template()) != want[i] for i, _, p in rows)
    assert all(html_text.main_text(p) != want[i] for i, _, p in rows)  # names alone keep the furniture


def test_text_out_of_order_is_no_template(spark):
    page = lambda i, mid: f"<body><div class=h>Top line</div><div class=t><p>{words(random.Random(i), 80)}</p>{mid}</div><div class=z>End line</div></body>"
    rows = [(i, "http://o.example/", page(i, "")) for i in range(8)] + [(9, "http://o.example/", page(9, "<p>Some text <b>End line</b></p><p>Tail</p>").replace("<div class=z>End line</div>", ""))]
    assert got(spark, rows)[9].split("\n")[1:] == ["Some text End line", "Tail"]


def test_broken_markup():
    text = html_text.main_text
    assert text('one\n<a title="x>two\nthree') == "one two three" and text("&<b>lt;</b>") == "&lt;" and text("a&amp;lt;b") == "a&lt;b"
    assert text("<article><div class='content-widget'>a</div><p class='story-main related-topic'>b</p><div class=comments>c</div></article>") == "a\nb"
    assert text("<p>a<!-- x") == "a" and text("<script>x") == "" and text("a < b <3 c") == "a < b <3 c"
    took = []
    for k in (4000, 16_000):
        t = time.thread_time()
        for page in ("<a " * k, "<div>" * k + "x", "<span>" * k + "<p>x" * k, "<div><p>" * k + "</x>" * k, "<a '" * k):
            text(page)
        took.append(time.thread_time() - t)
    assert took[1] < 10 * took[0]


def test_long_page_and_empty_table(spark):
    long = "<article>" + "".join(f"<p>w{i} x</p>" for i in range(50_000)) + "</article>"
    out = html_text.extract(spark.createDataFrame([(1, "http://l/", long)], "page_id long, url string, html string")).first()
    assert out.text == "\n".join(f"w{i} x" for i in range(50_000)) and out.n_chars == len(out.text)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
