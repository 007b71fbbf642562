"""Main text of pages and WARC round trips, on nulls, copies, malformed pages and empty tables."""

import base64
import hashlib

import pytest

pytest.importorskip("plenum.llm")
from plenum.llm import pagetext, warc  # noqa: E402
from plenum.llm.shared import new_folder  # noqa: E402

SHAPE = "page_id long, url string, html string, host string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SHAPE)


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<nav>menu</nav><article><h1>A &amp; B</h1><p>one\n two<p><b>three<br>four</article><footer>f</footer>", ["A & B", "one two", "three four"]),
        ("<body><header>H</header><div class='ad'>x</div><p title='a>b'>t &lt;i&gt; <i>u</i></p><div class=comments><p>c</p></div>", ["t <i> u"]),
        ("<main><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><script>if (a<b) '</p>'</script><form>f</form></main>after", ["a", "b", "1 2"]),
        ("a < b <!-- c --> d", ["a < b d"]),
        ("", []),
        ("<p", ["<p"]),
        ("<article><aside>s</aside><p>x&nbsp;y</p><div class='comments'><p>c</p></div></article><article class=comment>z</article>", ["x y"]),
    ],
)
def test_pages_are_read_as_blocks(page, blocks):
    assert pagetext.read_page(page)[0] == blocks


def test_site_templates_go_and_content_stays(spark):
    rows = [(i, f"http://u@H.example/{i}", f"<body><div>Our site. Welcome!</div><p>Text number {i} of this site, long enough.</p><p>{i}</p></body>") for i in range(12)]
    rows += [(20, "http://other.example/", rows[0][2]), (21, None, None), (22, "no url", ""), (23, "http://h.example", "<article><p>Only.</p></article>")]
    rows += [(30 + i, "http://copies.example/", "<body><div>Same.</div><p>The same page over and over.</p></body>") for i in range(30)]
    out = {r["page_id"]: r for r in pagetext.main_text(pages(spark, rows)).collect()}
    assert len(out) == len(rows)
    assert out[3]["text"] == "Text number 3 of this site, long enough.\n\n3" and out[3]["n_template"] == 1
    assert out[20]["text"].startswith("Our site.") and out[30]["text"].startswith("Same.")
    assert (out[21]["text"], out[22]["text"], out[23]["text"]) == ("", "", "Only.")
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert pagetext.main_text(pages(spark, [])).count() == 0


def test_archives_round_trip(spark):
    rows = [(1, "http://a/é", "same"), (5, "http://a", "same"), (3, None, "same"), (2, "http://b\r\nX: y", "other\r\n\r\nü"), (4, "u", None), (6, "u", ""), (None, "n", "same"), (7, "l", "long " * 50000)]
    back = {r["page_id"]: r for r in warc.archive_and_read(pages(spark, rows)).collect()}
    top = {"same": 5, "": 6}
    for page, _, html in rows:
        raw = (html or "").encode()
        r = back[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        first = top.get(html or "", page)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if page == first else ("revisit", first))
        assert r["payload"] == (raw if page == first else None)
    assert warc.archive_and_read(pages(spark, [])).count() == 0


def test_selected_records_are_read_alone_and_ranges_are_coalesced(spark):
    index = warc.write_warc(pages(spark, [(i, f"u{i}", f"page {i} " * 50) for i in range(200)]).coalesce(1), new_folder(spark, "warc"), archive=8000)
    assert index.select("file").distinct().count() > 1
    assert warc.byte_ranges(index).count() == index.select("file").distinct().count()
    some = index.where("url IN ('u7', 'u150')")
    assert {r["page_id"] for r in warc.read_warc(some).collect()} == {7, 150}
    assert warc.byte_ranges(index, gap=0).count() < warc.byte_ranges(index.where("url LIKE '%1' OR url LIKE '%5'"), gap=0).count() + 200


def test_shared_items_of_a_large_host_stay(spark):
    rows = []
    for i in range(300):
        own = "<div>Rated good</div>" if i % 5 == 0 else ""
        rows.append((i, "http://cook.example/", f"<article><div>Cook with us!</div><h1>Dish {i}</h1><ul><li>Salt</li><li>Item {i}</li></ul><table><tr><td>Yes<td>No</table>"
                     f"<dl><dt>Time<dd>10 min</dl><figure><figcaption>Photo</figcaption></figure>{own}<p>How to make dish number {i} in some longer words.</p></article>"))
    out = {r["page_id"]: r for r in pagetext.main_text(pages(spark, rows)).collect()}
    for i in range(300):
        own = ["Rated good"] if i % 5 == 0 else []
        blocks = [f"Dish {i}", "Salt", f"Item {i}", "Yes No", "Time", "10 min", "Photo", *own, f"How to make dish number {i} in some longer words."]
        assert out[i]["text"].split("\n\n") == blocks and out[i]["n_template"] == 1


def plain_article(page):
    """Text of a page's article by the standard library's parser: blocks, without what is dropped by element or by a class of its own."""
    from html.parser import HTMLParser

    blocks, gone = {"p", "div", "article", "h1", "h2", "ul", "li", "section", "body"}, {"nav", "footer", "script", "style", "aside", "form", "head", "title"}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.out, self.held = [], [], []

        def flush(self):
            text = " ".join("".join(self.held).split())
            self.held = []
            if text:
                self.out.append(text)

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.handle_data(" ")
            if tag in ("br", "meta"):
                return
            if tag in blocks:
                self.flush()
            self.stack.append((tag, tag in gone or dict(attrs).get("class") in ("ad", "comments")))

        def handle_endtag(self, tag):
            if tag in [t for t, _ in self.stack]:
                if tag in blocks:
                    self.flush()
                while self.stack.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            tags = [t for t, _ in self.stack]
            if "article" in tags and not any(g for _, g in self.stack):
                self.held.append(data)

    reader = Reader()
    reader.feed(page or "")
    reader.flush()
    return "\n\n".join(reader.out)


def test_all_pages_with_planted_templates(spark):
    """Boxes that recur on most pages of a host go, inside articles too; the same box on few pages stays; all else is as the plain reader has it."""
    from plenum.llm import pagetext

    folder = "/root/testdata/sf0.01"
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").orderBy("page_id").collect()]
    box, once = '<div class="box"><div>Follow this site</div><div>every day</div></div>', '<section id="search"><h2 id="related-work">Search</h2><div class="notice-board">Found {}</div></section>'
    rows, want = [], {}
    for n, (page, text) in enumerate(pages):
        end = (text or "").rfind("</article>")
        if end < 0:
            rows.append((page, f"http://odd.example/{page}", text))
            continue
        often, host = n % 3 != 0, "many" if n % 2 else "few"
        planted = (often and host == "many") or (host == "few" and n < 12)
        own = (box if planted else "") + once.format(n)
        rows.append((page, f"https://{host}.example/{page}", text[:end] + own + text[end:] + (box if planted else "")))
        want[page] = "\n\n".join(x for x in (plain_article(text), "Follow this site\n\nevery day" if planted and host == "few" else "", f"Search\n\nFound {n}") if x)
    assert len(want) > 200 and sum("Follow" in t for t in want.values()) > 3
    out = {r["page_id"]: r for r in pagetext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows)
    for page, text in want.items():
        assert out[page]["text"] == text and out[page]["n_chars"] == len(text)
    assert sum(r["n_template"] for r in out.values()) > 100


def test_whole_table_is_the_plain_readers(spark):
    from plenum.llm import queries

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in queries.op5_page_text(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == pages.keys()
    wrong = [p for p, text in pages.items() if "<article" in (text or "") and got[p] != plain_article(text)]
    assert not wrong


def test_an_articles_own_blocks_are_not_dropped_by_names(spark):
    from plenum.llm import pagetext

    page = (
        '<article><h2 id="related-work">Related work</h2><p>x y</p><section id="search"><h2>Search</h2><p>How search works.</p></section>'
        '<p class="notice-board">text</p><div class="promo-code">kept</div><div class="comments">gone</div><div role="advert">gone</div></article>'
    )
    out = pagetext.main_text(spark.createDataFrame([(1, "http://a", page), (2, "http://a", f"<body><p class='menu'>stays</p><div class='site-menu'>gone</div></body>"), (3, "http://a", "<p>" + "long " * 200_000 + "</p>")], "page_id long, url string, html string"))
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got[1] == "Related work\n\nx y\n\nSearch\n\nHow search works.\n\ntext\n\nkept"
    assert got[2] == "stays" and got[3] == ("long " * 200_000).strip()
