"""Main text of pages: block cutting, alignment, and page differences against a plain pass over sorted pages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from adwatch.llm import htmltext
from adwatch.llm.queries import QUERIES


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   \n", ""), ("plain &amp; simple", "plain & simple"),
    ("<p><b>one<br>two<p>three &copy; &#233;&#x41;", "one two|three © éA"),
    ("<script>var t='</p>';</script><style>p{}</style><p>a\n\t b&nbsp;c</p><!-- ad --><noscript>n</noscript>", "a b c"),
    ("<nav><ul><li>m<li>n</ul></nav><h1>T</h1><ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table><footer>f</footer>", "T|x|y|1|2|3"),
    ("<p>a < b & c <b>bold</i></b> d", "a < b & c bold d"),
    ("<body class='menu'><form id=f><main><div class=sidebar>s</div><article class='post tag-ads'><header><h1>T</h1></header>p1"
     "<div class='ad-box'>buy</div><p>p2</article><article class=comment><p>c</article></main></form>", "T|p1|p2"),
    ("<section class=comments><article><p>c1</article></section><p>body", "body"),
    ("<div class='wrap menu'><div id=cookie-bar>c</div><p>only text</div>", "only text"),
    ("<div hidden>x</div><aside>y</aside><form><p>z<input></form><div role=banner>b</div><div style='display: none'>n</div><p>kept", "kept"),
    ("<article><p>a</p><div class='newsletter-form'>n</div></article><p>outside", "a"),
    ("<main></main><p>outside", "outside"), ("<p>cut <a href=\"x", "cut"), ("x<!-- open", "x"), ("<title>t</title><p>e", "e"),
    ("<p>" + "long " * 50_000, ("long " * 50_000).strip()),
])
def test_blocks(page, text):
    assert "|".join(htmltext.blocks(page)[0]) == text


def test_shared_lines():
    def longest(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    rng = random.Random(1)
    for _ in range(1500):
        k = rng.choice([2, 3, 8])
        a, b = ([rng.randint(1, k) for _ in range(rng.randint(0, 14))] for _ in range(2))
        places = htmltext.shared_lines(a, b)
        assert len(places) == longest(a, b) and places == sorted(set(places))
        rest = iter(b)
        assert all(a[i] in rest for i in places)


def site(rng, pages):
    """Pages of a few hosts, one with most of them; frames are told by nothing but their being on every page."""
    words = [f"w{i}" for i in range(500)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    frames = {h: ([say(6) for _ in range(3)], [say(5) for _ in range(2)]) for h in ("big.example", "mid.example", "two.example")}
    rows, want = [], {}
    for i in range(pages):
        host = "two.example" if i < 2 else rng.choice(["big.example"] * 4 + ["mid.example"])
        body = [say(rng.randint(15, 40)) for _ in range(rng.randint(2, 6))]
        top, end = frames[host]
        marked = rng.random() < 0.5
        page = "".join(f"<div>{w}</div>" for w in top)
        page += ("<article>" if marked else "") + "".join(f"<p>{w}</p>" for w in body) + ("</article>" if marked else "")
        rows.append((i, f"https://{host}/{rng.choice('abc')}/{rng.randint(0, 9999)}", page + "".join(f"<div>{w}</div>" for w in end)))
        want[i] = "\n\n".join(body)
    return rows, want


def plain(rows):
    """What one pass over the sorted pages gives."""
    def key(row):
        host = re.match(r"(?:[A-Za-z][\w+.-]*:)?//([^/?#]*)", row[1] or "")
        return (host[1].lower() if host else "", re.sub(r"^(?:[A-Za-z][\w+.-]*:)?//[^/?#]*", "", row[1] or ""), row[0] is not None, row[0])

    ordered, held = sorted(rows, key=key), []
    for row in ordered:
        lines, landmark, every = htmltext.blocks(row[2])
        page = htmltext._Page(key(row)[0], [hash(w) for w in lines], [w.count(" ") + 1 for w in lines], landmark, [hash(w) for w in every])
        held.append((page, lines))
    out = []
    for k, (row, (page, lines)) in enumerate(zip(ordered, held)):
        reach = htmltext.REACH
        lost = htmltext._lost(page, [h[0] for h in held[max(0, k - reach):k][::-1]], [h[0] for h in held[k + 1:k + 1 + reach]])
        out.append((row[0], row[1], htmltext._text(lines, lost)))
    return out


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_page_differences(spark, parts):
    rows, want = site(random.Random(parts), 260)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3)).repartition(5)
        got = htmltext.extract(df)
        assert got.columns == ["page_id", "url", "text"]
        found = sorted(tuple(r) for r in got.collect())
        other = spark.range(0, 3, 1, 3).selectExpr("-1 - id AS page_id", "'' AS url", "'' AS text")
        behind = sorted(tuple(r) for r in other.unionAll(got).where("page_id >= 0").collect())  # tasks of a union are numbered anew
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found == behind == sorted(plain(rows))
    assert {i: t for i, _, t in found} == want


def test_copies_and_odd_rows(spark, folder):
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randint(1, 900)}" for _ in range(n))
    article = [say(30) for _ in range(5)]
    body = "<article>" + "".join(f"<p>{a}</p>" for a in article) + "</article>"
    near = body.replace(article[2], say(30))
    rows = [(i, f"http://copies.example/{i:03}", body if i % 3 else near) for i in range(60)]
    quote = say(20)
    rows += [(100 + i, f"http://quotes.example/{i:03}", f"<article><p>{say(40)}</p>" + f"<p>{quote}</p>" * (i % 7 in (0, 1)) + "</article>") for i in range(70)]
    rows += [(200, None, "<p>no address"), (200, None, "<p>no address"), (None, "", "<p>x"), (201, "http://one.example", None), (202, "http://one.example", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{folder}/pages.parquet")
    got = QUERIES["op12_html_text"](spark, folder)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = [tuple(r) for r in got.collect()]
    want = [(i, u, "\n\n".join(htmltext.blocks(h)[0])) for i, u, h in rows]
    assert sorted(found, key=str) == sorted([(*w, len(w[2])) for w in want], key=str)
    assert htmltext.extract(got.limit(0).withColumn("html", F.lit("")), out="main").collect() == []
