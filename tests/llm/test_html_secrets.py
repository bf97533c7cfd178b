import hashlib
import random
import re
import string

from rinsework.llm import html_text, queries, secrets

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy &amp; buy</div>
<div class='cookie-notice'>We use cookies<div>nested</div></div>
<article><h1>Head &amp; tail</h1><p><b>First   one<br>goes on<p>Second&nbsp;one</p><div class="ad">Inner ad</div><form><p>Mail</p></form><p>x &lt; y &copy;</p>
<section id="comments"><p>Reader says hi</p></section></article><aside>Side</aside><footer>&copy; 2020</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE) == "Head & tail\nFirst one goes on\nSecond one\nx < y ©"


def test_page_without_article():
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(4))
    page = f"<div class=menu><a href=x>One</a></div><ul><li><a href=x>Two</a></li></ul><div><h2>Short</h2>{body}<p>End.</p></div><div id=footer>f</div>"
    assert html_text.main_text(page).split("\n") == ["Short", *(("word " * 30 + str(i)) for i in range(4)), "End."]


def test_page_with_teasers():
    body = [f"{'word ' * 30}{i}" for i in range(6)]
    cards = "".join(f"<article><h3>Card {i}</h3><p>Read more</p></article>" for i in range(3))
    for page in (f"<div>{''.join(f'<p>{b}</p>' for b in body)}</div>{cards}", f"{cards}<div>{''.join(f'<p>{b}</p>' for b in body)}</div>"):
        assert html_text.main_text(page).split("\n") == body
    assert html_text.main_text(f"<p>Short line</p><article>{''.join(f'<p>{b}</p>' for b in body)}</article>").split("\n") == body


def test_wrappers_that_are_named_like_asides():
    body = [f"{'word ' * 30}{i}" for i in range(6)]
    article = "".join(f"<p>{b}</p>" for b in body)
    side = f'<div class="sidebar"><p>{"side " * 20}</p></div><div class="comments"><p>{"said " * 30}</p></div>'
    for name in ("has-sidebar", "layout no-sidebar", "post legal", "content widget", "with-nav", "related", "page subscribe-wall", "comments-open"):
        for page in (f'<div class="{name}">{article}</div>', f'<nav><a href=x>Menu</a></nav><div class="{name}"><div id="promo">Buy</div><div>{article}{side}</div></div><footer>f</footer>'):
            assert html_text.main_text(page).split("\n") == body, (name, page[:80])
    assert html_text.main_text(f'{article}<div class="comments"><p>{"said " * 60}</p></div>').split("\n") == body  # longer than half of the article


def test_inline_adverts_do_not_cut_a_paragraph():
    assert html_text.main_text('<p>One <span class="promo">Buy <b>now</b></span>two <b>three</b></p>') == "One two three"


def test_odd_pages():
    for page, text in ((None, ""), ("", ""), ("plain", "plain"), ("<p>open", "open"), ("<nav><p>a<article><p>b</article>", "b"), ("a < b <p>c", "a < b\nc"), ("<article></article>", ""), ("<script>x", "")):
        assert html_text.main_text(page) == text, page
    assert html_text.main_text("<article>" + "<p>w</p>" * 50_000 + "</article>").count("\n") == 49_999


def slow_article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    from html import unescape

    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
    return "\n".join(b for b in blocks if b)


def test_extraction_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = queries.op9_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        assert r.text == slow_article(pages[r.page_id].html), r.page_id


def test_extraction_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a</p>", "x"), (2, "u", "", "x"), (2, "u", "", "x")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html_text.extract(df).collect()) == ["", "", "", "a"]
    assert html_text.extract(df.limit(0)).collect() == []


# secrets

BASE = (("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32))


def slow_base(text):
    found = [(k, m.start(), m.end()) for k, form, good in BASE for m in form.finditer(text) if good(m)]
    return sorted(found, key=lambda x: (x[1], [b[0] for b in BASE].index(x[0])))


def test_base_forms():
    rnd = random.Random(4)
    parts = ["password", "PASSWD", "Secret", "ſecret", "toKen", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdefgh", "é😀", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "0" * 40, "deadbeef", ".", "\n", "-", "=="]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        assert [x for x in secrets.scan(t) if x[0] != "random"] == slow_base(t), t


def test_noise_and_language():
    rnd = random.Random(5)
    base64 = string.ascii_letters + string.digits + "+/"
    noise = ["".join(rnd.choice(base64) for _ in range(n)) for n in (24, 32, 40, 64) for _ in range(50)]
    assert sum(any(k == "random" for k, _, _ in secrets.scan(f"the value {t} ends")) for t in noise) > 0.9 * len(noise)
    plain = ["Donaudampfschifffahrtsgesellschaft", "z" * 50, "https://example.com/en/some-long-article-title/12345", "getElementsByClassNameAndTagName", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "12345678901234567890123", "abcdefghijklmnopqrstuvwxyz0123456789", "snake_case_identifier_with_words", "THE-QUICK-BROWN-FOX-JUMPS", "aB" * 20, "0101010101010101010101"]
    assert [t for t in plain if secrets.scan(t)] == []


def test_noise_of_other_encodings():
    rnd = random.Random(6)
    for alphabet in (string.ascii_uppercase + "234567", "0123456789ABCDEF", string.ascii_lowercase + string.digits):
        for n in (20, 32, 52):
            noise = ["".join(rnd.choice(alphabet) for _ in range(n)) for _ in range(200)]
            assert sum(any(k == "random" for k, _, _ in secrets.scan(f"the value {t} ends")) for t in noise) > 0.9 * len(noise), (alphabet, n)
    words = "the value of information about responsible international government und Verantwortung Gesellschaft para desarrollo conocimiento".split()
    for _ in range(500):
        parts = [rnd.choice(words) for _ in range(5)]
        for t in ("".join(parts), "".join(parts).upper(), "_".join(parts), "".join(p.title() for p in parts), "".join(parts) + "2024", "-".join([*parts, "12345"])):
            assert secrets.scan(t) == [], t


def test_scan_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in queries.op10_secret_scans(spark, "/root/testdata/sf0.01").collect():
        base = slow_base(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert set(filter(None, secrets.joined(base).split(","))) <= set(r.spans.split(","))


def test_redaction(spark):
    rows = [(1, "password=abcdefgh12 ok", 22, "s"), (2, None, None, "s"), (None, "", 0, "s"), (3, "clean", 99, "s"), (3, "x " * 90_000, 180_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = sorted((tuple(r) for r in secrets.redact(df).collect()), key=repr)
    assert got == sorted([(1, "[SECRET] ok", 11, "s"), *rows[1:]], key=repr)
    assert secrets.digest(df.limit(0)).collect() == [] and secrets.redact(df.limit(0)).collect() == []
