import html
import math
import random
from collections import Counter, defaultdict

from flowverdict.llm import sitetree as s
from tests.llm.conftest import invented


def page(k, body, template=True, extra=""):
    menu = "".join(f'<li><a href="/{w}">{w}</a>' for w in invented(k, 4).split())
    return (f'<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style><script>var t="</p>";</script></head>'
            f'<body class="has-sidebar"><nav><ul>{menu}</ul></nav><div class="ad">{invented(k + 50, 5)}</div>{extra}'
            + (f"<article>{body}</article>" if template else f'<div class="content">{body}</div>')
            + '<div class="widget">Same on every page</div><div><span>Read our magazine</span></div>'
            f"<footer>&copy; host {k}</footer></body></html>")


def test_article_of_every_page(spark):
    rows, want = [], {}
    for k in range(30):
        lines = [invented(200 + k * 9 + n, 12) + " & more" for n in range(3)]
        if k % 5 == 0:
            lines = ["The same article & more"] * 2
        body = f"<h1>{html.escape(lines[0])}</h1><p><b>" + "<br><p>".join(map(html.escape, lines)) + "</p>"
        rows.append((k, f"http://h{k % 2}.example.com/{k}", page(k, body, extra="<form>Name <input></form>")))
        want[k] = "\n".join([lines[0], *lines])
    out = s.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == want
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == rows[r["page_id"]][1] for r in out)


def test_shared_branches_go_where_no_element_marks_the_article(spark):
    rows = [(k, "http://one.example.com/", page(k, f"<p>{invented(k, 20)}</p><p>{invented(k + 90, 9)}</p>", False))
            for k in range(12)]
    out = {r["page_id"]: r["text"] for r in s.extracted(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {k: f"{invented(k, 20)}\n{invented(k + 90, 9)}" for k in range(12)}


def test_importance_is_the_entropy_over_pages(spark):
    rng = random.Random(1)
    rows = []
    for k in range(40):
        tag = rng.choice(["p", "p", "div"])
        rows.append((f"h{k % 3}", f"<body><section><{tag}>{rng.choice('abc')}</{tag}></section><i>same</i></body>"))
    styles, texts, pages = defaultdict(Counter), defaultdict(Counter), Counter()
    for host, text in rows:
        for path, is_content, value in s.observations(s.Dom(text)):
            (texts if is_content else styles)[host, path][value] += 1
            pages[host, path] += not is_content
    out = s.style_trees(spark.createDataFrame(rows, "host string, html string")).collect()
    assert {(r["host"], r["path"]) for r in out} == {k for k, m in pages.items() if m > 1}
    for r in out:
        key = r["host"], r["path"]
        m = pages[key]
        node = -sum(n / m * math.log(n / m, m) for n in styles[key].values())
        assert abs(r["node"] - node) < 1e-9
        if texts[key]:
            assert abs(r["content"] - 1 + sum(math.log(n, m) for n in texts[key].values()) / len(texts[key])) < 1e-9
        else:
            assert r["content"] is None


def test_blocks_references_and_names():
    read = lambda body: s.main_text(f"<body><article>{body}</article></body>", {})
    assert read("a &amp;  b&nbsp;c &#8364; &am <i>d</i>e<br>f") == "a & b c € &am de f"
    assert read("<p>x<div>y</div>z<ul><li>1<li>2</ul>") == "x\ny\nz\n1\n2"
    assert read("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert read("<p>t</p><div class='comments'><p>first!</p></div><aside>s</aside><div id=cookie-notice>c</div>") == "t"
    assert read("<header><h1>Title</h1></header><p>t<!-- no --></p><script>x</script><footer>f</footer>") == "Title\nt"
    assert s.main_text("<div class='sidebar-layout'><main><p>kept</p></main></div><header>h</header>", {}) == "kept"
    assert s.main_text("<p>open <b>and <![if IE]>never <![endif]>closed <", {}) .startswith("open and never closed")
    assert s.main_text("<div>" * 5000 + "deep", {}) == "deep"


def test_hard_rows(spark):
    long = "<article><p>" + "w " * 50_000 + "</p></article>"
    rows = [(1, None, None), (2, "", ""), (3, "no url", "plain text"), (None, "http://a.b/c", long), (4, None, "<p>x</p>"),
            (4, None, "<p>x</p>")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows],
                               "page_id long, url string, html string, host string, n_chars int")
    out = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in s.extracted(df).collect())
    assert out == Counter({(1, None, "", 0): 1, (2, "", "", 0): 1, (3, "no url", "plain text", 10): 1,
                           (None, "http://a.b/c", ("w " * 50_000).strip(), 99_999): 1, (4, None, "x", 1): 2})
    assert s.extracted(df.where("false")).count() == 0


def test_trees_too_large_to_send_are_joined(spark, monkeypatch):
    monkeypatch.setattr(s, "TREE_ROWS", 0)
    test_shared_branches_go_where_no_element_marks_the_article(spark)
