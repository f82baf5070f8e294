from pyspark.sql import functions as F

from taskwatch.llm import pages as P
from llm_fixtures import make  # noqa: F401

PAGES = "page_id long, url string, html string"
PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header>"
        "<nav><ul><li><a href=/a>Menu</a></ul></nav><!-- ad --><div class='cookie-notice'>We use cookies</div>{0}"
        "<div id=comments><p>Nice!</p></div><form><input value=x>Search</form><footer>&copy; us</footer></body></html>")


def text(html, low=frozenset()):
    return "\n\n".join(P.blocks(P.parse(html), low))


def test_article_without_the_rest():
    art = "<article><header><h1>A &amp;  B</h1></header><p>one\n <b>two<br>three<p>four<ul><li>x<li>y</ul><aside>no</aside></article>"
    assert text(PAGE.format(art)) == "A & B\n\none two three\n\nfour\n\nx\n\ny"
    assert text(PAGE.format("<main><p>m</p><div class='related'>r</div></main>")) == "m"
    assert text(PAGE.format("<div class=content><h2>H</h2>text<p>p</p></div>")) == "H\n\ntext\n\np"


def test_broken_and_odd_markup():
    assert text(None) == text("") == text("<p></p><script>x") == text("<!-- never closed <p>x") == ""
    assert text("plain &lt;b&gt; &#233; &nosuch; 1 < 2") == "plain <b> é &nosuch; 1 < 2"
    assert text("<p>cut <b>off <a href='x") == "cut off"
    assert text("<p>a</div></p></p>b<td>c") == "a\n\nb\n\nc"
    assert text("<p title='a>b'>x</p><p hidden>no</p><p style='display:none'>no</p>") == "x"
    assert text("<SCRIPT>if (a<b) '</p>'</SCRIPT ><P>y") == "y"
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert text(deep) == "deep" and text("<p>" + "w " * 300000) == ("w " * 300000).strip()


def site(n, host="h.example"):
    own = [f"<div class=body><p>Own words {i} of page {i}</p><p>More {i * 7}</p></div>" for i in range(n)]
    return [(i, f"https://{host}/p/{i}", f"<html><body><div class=x1>Welcome to our site</div>{o}<div class=x2><p>Call us now</p></div></body>")
            for i, o in enumerate(own)]


def test_style_tree_removes_what_never_varies(make):
    rows = site(40) + [(100 + i, f"http://few.example/{i}", "<div class=x1>Welcome to our site</div><p>t</p>") for i in range(3)]
    out = {r["page_id"]: r for r in P.extract(make(rows, PAGES)).collect()}
    for i in range(40):
        assert out[i]["text"] == f"Own words {i} of page {i}\n\nMore {i * 7}" and out[i]["n_chars"] == len(out[i]["text"])
    assert out[101]["text"] == "Welcome to our site\n\nt"  # too few pages to tell


def test_entropies(make):
    tree = {(r["host"], r["path"]): r for r in P.style_tree(make(site(40), PAGES)).collect()}
    menu = tree["h.example", "/html/body/div.x"]
    assert menu["content"] < 0.2 and tree["h.example", "/html/body/div.body/p"]["content"] > 0.9
    assert tree["h.example", "/html/body"]["presentation"] == 0


def test_copies_of_an_article_stay(make):
    rows = [(i, "https://h.example/same", PAGE.format("<article><p>the same article</p></article>")) for i in range(50)]
    rows += rows[:3] + [(None, None, PAGE.format("<article>x</article>")), (7, None, None), (8, "nonsense", "")]
    out = P.extract(make(rows, PAGES).withColumns({"text": F.lit("clash"), "paths": F.lit(1)})).collect()
    assert len(out) == len(rows)
    assert all(r["text"] == "the same article" for r in out if r["url"] and r["url"].startswith("https"))
    assert sorted(r["text"] for r in out if not r["url"] or r["url"] == "nonsense") == ["", "", "x"]
    assert P.extract(make([], PAGES)).count() == 0




def test_the_prior_spares_what_holds_the_page():
    art = "<article><h1>H</h1><p>text</p></article>"
    for around in ("<body class='no-sidebar'>{}</body>", "<html class=search><body id=menu>{}</body></html>",
                   "<body><main class='has-sidebar'>{}</main></body>", "<body><div id='search-results'>{}</div></body>",
                   "<body><form action=x><div>{}</div></form></body>", "<body><form><nav>m</nav>{}<footer>f</footer></form></body>",
                   "<body><div class=modal>{}</div></body>", "<body><nav>m</nav><form>Search</form>{}</body>",
                   "<body><aside><article>other</article></aside>{}<section id=comments><article>Nice!</article></section></body>"):
        assert text(around.format(art)) == "H\n\ntext", around
        if "article" not in around and "modal" not in around:
            assert text(around.format("<div><h1>H</h1><p>text</p></div>")) == "H\n\ntext", around
    assert text("<article class='post ad-free'><p>a</p><p title='the hidden cost'>b</p><p title='x class=ad'>c</p></article>") == "a\n\nb\n\nc"
    for gone in ("class=ad", "class='x cookie-notice'", "id=main-nav", "role='navigation'", "hidden", "HIDDEN=''", "class=a hidden",
                 "style='color:red;display: none'"):
        assert text(f"<article><p>a</p><div {gone}>b</div></article>") == "a", gone


def test_the_tree_acts_inside_articles(make):
    """A notice on all pages goes; copies of one article, with other menus, and
    what varies in the notice's place stay."""
    page = "<body><nav>{m}</nav><article><h1>Title {i}</h1><p>Own words {i}</p><div class=x>Read us daily<b>{b}</b></div></article></body>"
    rows = [(i, f"https://h.example/{i}", page.format(m=i, i=i, b="now")) for i in range(30)]
    rows += [(100 + i, f"https://h.example/c{i}", page.format(m=i, i="C", b="now")) for i in range(300)]
    rows += [(500 + i, f"https://v.example/{i}", page.format(m=1, i=i, b=f"issue {i}")) for i in range(30)]
    rows += [(600 + i, f"https://c.example/{i}", page.format(m=i, i="C", b="now")) for i in range(300)]
    out = {r["page_id"]: r["text"] for r in P.extract(make(rows, PAGES)).collect()}
    assert len(out) == len(rows)
    assert all(out[i] == f"Title {i}\n\nOwn words {i}" for i in range(30))
    assert all(out[100 + i] == "Title C\n\nOwn words C" for i in range(300))
    assert all(out[500 + i] == f"Title {i}\n\nOwn words {i}\n\nissue {i}" for i in range(30))
    assert all(out[600 + i] == "Title C\n\nOwn words C\n\nRead us dailynow" for i in range(300))


def test_repeated_headings_and_labels_of_articles_stay(make):
    """Section headings, alternating labels and cells that repeat are the article's, with
    or without an ``article`` element; a notice and a menu that stand alone go."""
    recipe = ("<h1>Dish {i}</h1><h2>Ingredients</h2><p>Take {i} eggs</p><h2>Method</h2><p>Boil {i} minutes</p>"
              "<div class=kind>{k}</div><table><tr><td>yes</td><td>yes</td></tr></table>")
    want = "Dish {i}\n\nIngredients\n\nTake {i} eggs\n\nMethod\n\nBoil {i} minutes\n\n{k}\n\nyes\n\nyes"
    rows, wanted = [], {}
    for i in range(40):
        k = "sweet" if i % 2 else "salty"
        rows.append((i, "http://a.example/", "<body><article>" + recipe.format(i=i, k=k) + "<div class=x>Print this page</div></article></body>"))
        wanted[i] = want.format(i=i, k=k)
        rows.append((100 + i, "http://d.example/", f"<body><div class=top><h2>Topics</h2><a>Home</a><a>Shop</a></div><div class=text><h1>Dish {i}</h1>"
                     f"<h2>Ingredients</h2><p>Take {i} eggs</p><h2>Method</h2><p>Boil {i} minutes</p></div><div class=end>All rights reserved</div></body>"))
        wanted[100 + i] = f"Dish {i}\n\nIngredients\n\nTake {i} eggs\n\nMethod\n\nBoil {i} minutes"
    out = {r["page_id"]: r["text"] for r in P.extract(make(rows, PAGES)).collect()}
    assert out == wanted


def test_a_notice_on_some_pages_of_a_host_stays_in_articles(make):
    rows = [(i, "http://a.example/", f"<body><article><p>Own words {i}</p>{'<div class=x>Print this page</div>' if i % 3 else ''}</article></body>")
            for i in range(60)]
    out = {r["page_id"]: r["text"] for r in P.extract(make(rows, PAGES)).collect()}
    assert out == {i: f"Own words {i}" + ("\n\nPrint this page" if i % 3 else "") for i in range(60)}


def test_deep_nodes_are_judged_apart(make):
    """Below any depth a notice goes and the text beside it stays."""
    rows = [(i, "http://deep.example/", "<body>" + "<div class=level>" * 300 + f"<div class=x>Print this page</div><p>Own words {i}</p>" + "</div>" * 300)
            for i in range(40)]
    out = {r["page_id"]: r["text"] for r in P.extract(make(rows, PAGES)).collect()}
    assert out == {i: f"Own words {i}" for i in range(40)}
    paths = [n.path for n in P._nodes(P.parse(rows[0][2]))]
    assert len(set(paths)) == len(paths) and max(map(len, paths)) < 600
