import pytest

from newsloom.llm.page_text import Page, page_texts, template_subtrees

SCHEMA = "page_id long, url string, html string, host string, deleted string"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a<b> b</b><br>c<p>d", "a b c\n\nd"),
        ("<nav>x</nav><article><h1>T &amp; U&copy;</h1><p>a\n  b</p></article><footer>y</footer>", "T & U©\n\na b"),
        ("<body><div class='top-ad'>x</div><div id=main>y<div>z</div>w</div></body>", "y\n\nz\n\nw"),
        ("<div class='adult-education'>kept</div>", "kept"),
        ("<header>x</header><article><header><h1>t</h1></header><p>u</p><aside>v</aside></article>", "t\n\nu"),
        ("<article><p>a</p><div class='comments'><p>b</p><div>c</div></div><p>d</p></article>e", "a\n\nd"),
        ("a<script>if (x < '</p>') y</script>b<style>p{}</style>c", "a b c"),
        ("a<!-- <p>b</p> -->c<!-- open", "ac"),
        ("1 < 2 and 3 > 2 <3", "1 < 2 and 3 > 2 <3"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\n\nb\n\nc\n\nd"),
        ("<form><p>x</p></form>y<div hidden>z</div><p aria-hidden=\"true\">w</p><div role=navigation>v</div>", "y"),
        ("<p>cut off &am", "cut off &am"),
        ("<p>cut <a href='x", "cut"),
        ("</p></div>a</b>", "a"),
        ("<title>x</title><head><meta><p>y</head><body>z", "z"),
    ],
)
def test_reading(source, text):
    assert Page(source).text() == text


def site():
    rows = []
    for i in range(12):
        tail = f"<div><p>Latest from us</p><p>Read more</p></div><section>Page of {i}</section>"
        rows.append((i, f"https://User@Example.com:80/{i}", f"<div>Our site</div><div><p>Story {i} begins.</p></div>{tail}"))
    copies = [(100 + i, "http://copies.org/x", "<div><p>One story.</p><p>Its end.</p></div>") for i in range(9)]
    odd = [
        (200, None, "<div>Our site</div><p>no address</p>"), (201, "http://example.com/", None), (202, "http://small.org", "<p>a</p>"),
        (None, "nonsense", "<p>b</p>"), (203, "http://example.com/q", "<p>" + "long text " * 40_000 + "</p>"), (202, "http://small.org", "<p>a</p>"),
    ]
    return [(*r, "h", "d") for r in rows + copies + odd]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_template_subtrees_are_deleted(spark, limit):
    pages = spark.createDataFrame(site(), SCHEMA)
    found = page_texts(pages, limit=limit).collect()
    assert len(found) == len(site())
    text = {r["page_id"]: r["text"] for r in found}
    for i in range(12):
        assert text[i] == f"Story {i} begins.\n\nPage of {i}"
    # copies of one page are one page: no template
    assert all(text[100 + i] == "One story.\n\nIts end." for i in range(9))
    assert text[200] == "Our site\n\nno address" and text[201] == "" and text[202] == "a" and text[None] == "b"
    assert text[203] == ("long text " * 40_000).strip()
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert {r["host"] for r in template_subtrees(pages).collect()} == {"example.com"}


def test_empty_table(spark):
    assert page_texts(spark.createDataFrame([], SCHEMA)).collect() == []
