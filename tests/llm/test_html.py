"""HTML extraction: parsing, alignment and wrappers."""

import html
import random
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.llm import html_extraction as X

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home %s</a></li></ul></nav>
<div class="ad">Buy %s now</div><article><h1>Title %s</h1><p><b>First   %s.<br><p>Second &amp; &eacute;%s</p><!-- <p>no</p> --><script>var t="</p>";</script></article>
<div id="comments"><p>Nice %s</p></div><footer>&copy; %s</footer></body></html>"""


def test_article_of_pages_of_one_host():
    pages = [PAGE % ((i,) * 7) for i in range(5)]
    assert X.extract_group(pages) == [f"Title {i}\nFirst {i}.\nSecond & é{i}" for i in range(5)]
    assert X.extract_group(pages[:1]) == ["Title 0\nFirst 0.\nSecond & é0"]


def test_nulls_copies_and_broken_pages():
    page = PAGE % ((1,) * 7)
    odd = ["no markup  at\nall", "<p>open <b>x", "a < b &lt; c", "<div", "</p></div>"]
    assert X.extract_group([None, "", page, page]) == ["", "", *["Title 1\nFirst 1.\nSecond & é1"] * 2]
    assert [X.extract_group([p])[0] for p in odd] == ["no markup at all", "open x", "a < b < c", "<div", ""]
    assert X.extract_group([page, *odd])[0] == "Title 1\nFirst 1.\nSecond & é1"
    assert X.extract_group(["a < b &lt; c"]) == ["a < b < c"]
    assert X.extract_group(["<p>open <b>x"]) == ["open x"]


def test_repeats_inside_an_article_stay():
    page = "<body><article><h1>%s</h1><p>The same words everywhere.</p></article></body>"
    assert X.extract_group([page % i for i in range(6)])[2] == "2\nThe same words everywhere."


def test_template_of_pages_without_article_goes():
    page = "<body><div><p>Welcome to our site</p></div><div><h2>%s</h2><p>Story %s text goes here, long enough.</p><p>More of %s.</p></div><div><p>All rights reserved</p></div></body>"
    out = X.extract_group([page % ((f"n{i}",) * 3) for i in range(8)])
    assert out[3] == "n3\nStory n3 text goes here, long enough.\nMore of n3."


def test_attributes_with_angle_brackets_and_deep_nesting():
    assert X.extract_group(['<p title="a > b">x</p><p data-x=\'<i>\'>y</p>']) == ["x\ny"]
    deep = "<div>" * 5000 + "end" + "</div>" * 5000
    assert X.extract_group([deep, deep + "<p>a</p>", deep + "<p>b</p><p>c</p>"])[0] == "end"


def test_matching_is_the_largest_ordered_match():
    tree = lambda s: X.slots(X.parse(s))
    a, b = tree("<div><h1>a</h1><ul><li>x</li></ul><p>b</p></div>"), tree("<div><p>z</p><h1>a</h1><p>b</p></div>")
    n, pairs = X.match(a, b)
    assert n == len(pairs) == 4  # html, div, h1, p


def test_spark_job(spark):
    rows = [(i, f"https://h{i % 2}.example/x?{i}", PAGE % ((i,) * 7), "extra") for i in range(30)]
    rows += [(100, None, None, "e"), (None, "https://h0.example/", "", "e"), rows[3], (101, "https://h0.example/long", "<article>" + "<p>word</p>" * 20000 + "</article>", "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumnRenamed("host", "part")
    out = X.extract(df, group_pages=5).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    got = {(r["page_id"], r["url"]): r["text"] for r in out}
    assert got[(7, "https://h1.example/x?7")] == "Title 7\nFirst 7.\nSecond & é7"
    assert got[(100, None)] == "" and got[(101, "https://h0.example/long")].count("word") == 20000
    assert X.extract(df.limit(0)).count() == 0


def test_character_references():
    text = "&lt;b&gt; &#233; &#x1F600; &nbsp; &copy &bogus;"
    assert X.extract_group([f"<p>{text}</p>"]) == [" ".join(html.unescape(text).split())]


def test_all_articles_of_a_page_stay():
    page = "<body><article><h1>%s</h1><p>Part one of %s.</p></article><article><p>Part two of %s, the longer one.</p></article></body>"
    want = [f"n{i}\nPart one of n{i}.\nPart two of n{i}, the longer one." for i in range(5)]
    pages = [page % ((f"n{i}",) * 3) for i in range(5)]
    assert X.extract_group(pages) == want
    assert X.extract_group(pages[:1]) == want[:1]  # without a wrapper
    single = ["<body><article><h1>%s</h1><p>Only part, %s.</p></article></body>" % (i, i) for i in range(5)]
    assert X.extract_group([*single, pages[0]])[5] == want[0]  # one page of the group has two


def test_the_wrapper_decides_on_pages_that_match_it():
    page = "<body><div><p>Lead of %s, before the box, and rather long as it is the story.</p><h2>%s</h2></div><article><p>Box %s, with some words of its own.</p></article></body>"
    assert X.extract_group([page % ((f"n{i}",) * 3) for i in range(6)])[2] == "Lead of n2, before the box, and rather long as it is the story.\nn2\nBox n2, with some words of its own."


def test_only_constant_text_is_dropped():
    page = "<body><h1>%s</h1><div><p>%s</p><ul><li>x</li></ul></div><section><p>Note on %s.</p><ul><li>y</li></ul></section><div><p>All rights reserved</p></div></body>"
    out = X.extract_group([page % (i, f"Story {i}. " * 40, i) for i in range(6)])
    assert out[2] == "2\n" + ("Story 2. " * 40).strip() + "\nNote on 2."  # x, y and the last line are the same on all pages


def test_one_long_page_takes_nothing_from_others():
    page = "<body><div><p>%s</p><ul><li>x</li></ul></div><section><p>%s</p><ul><li>y</li></ul></section></body>"
    pages = [page % ("", f"Story {i}.") for i in range(6)] + [page % ("long " * 5000, "")]
    out = X.extract_group(pages)
    assert out[:6] == [f"Story {i}." for i in range(6)] and out[6].count("long") == 5000


def test_a_page_keeps_its_own_text_in_a_place_of_the_template():
    page = "<body><div>%s<p>Story %s.</p></div></body>"
    assert X.extract_group([page % ("Read this:" if i else "Retracted!", i) for i in range(6)])[:2] == ["Retracted!\nStory 0.", "Story 1."]


def test_groups_do_not_depend_on_partitions(spark):
    page = "<body><div><p>Welcome to our site</p></div><h2>%s</h2></body>"
    rows = [(i, f"https://h{i // 4}.example/{i}", page % f"n{i}") for i in range(400)] + [(i, f"https://big.example/{i}", page % f"n{i}") for i in range(1000, 1100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for partition_pages in (7, 2000):  # hosts of four pages, and groups of about five
        out = X.extract(df, group_pages=5, partition_pages=partition_pages).collect()
        assert sorted((r["page_id"], r["text"]) for r in out) == [(i, f"n{i}") for i, _, _ in rows]


def test_no_group_is_too_small(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2900, "a").otherwise("b").alias("host"), F.xxhash64("id").alias("place"))
    for least in (1, 3):
        levels = {r["large"]: r["levels"] for r in X.cells(rows, 6, least).collect()}
        held = Counter((r["host"], r["place"] & ((1 << levels.get(r["host"], 0)) - 1)) for r in rows.collect())
        assert min(held.values()) >= least and len(held) > 100
    assert X.cells(rows.limit(11), 6, 3).count() == 0


def plain_score(a, b):
    """The largest match by the definition."""
    if a.tag != b.tag:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_score(x, y))
    return 1 + best[-1][-1]


def sound(pairs):
    """Pairs are one to one, join like tags, and their parents are pairs."""
    above = {(id(c), id(d)) for x, y in pairs for c in x.children for d in y.children}
    return len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs) and all(x.tag == y.tag for x, y in pairs) and sum((id(x), id(y)) in above for x, y in pairs) == len(pairs) - 1


def test_matches_equal_the_definition_on_random_trees():
    draw = random.Random(3)
    grow = lambda d: "".join(f"<{t}>{grow(d - 1) if d and draw.random() < 0.7 else ''}</{t}>" for t in draw.choices(["div", "ul", "section"], k=draw.randint(1, 6)))
    for _ in range(20):
        a, b = (X.slots(X.parse(grow(3))) for _ in range(2))
        n, pairs = X.match(a, b)
        assert n == len(pairs) == plain_score(a, b) and sound(pairs)


def test_long_and_deep_pages_are_matched_whole():
    body = lambda i, tags: "".join(f"<{t}>text {i} {k}</{t}>" for k, t in enumerate(tags))
    pages = [f"<body>{body(i, ['h3'] * (i % 2) + ['h4', 'dl'] * (60 + 5 * i) + ['pre', 'h2'] * 20)}<section>Same end</section><h5>e{i}</h5></body>" for i in range(6)]
    assert all(out.endswith(f"\ne{i}") and "Same end" not in out for i, out in enumerate(X.extract_group(pages)))
    deep = ["<div>" * 300 + f"<p>Same words</p><h2>n{i}</h2>" + "<ul><li>z</li></ul>" * (i % 2) + "</div>" * 300 for i in range(6)]
    assert X.extract_group(deep)[:2] == ["n0", "n1"]


STORY = "Story {0} begins at the river and goes on for some words. It ends in town {0}."


def labelled(i, body):
    return f"<html><head><title>t{i}</title></head><body>" + body.replace("@", str(i)) + "</body></html>"


def test_names_of_an_ancestor_silence_no_main_text():
    text = STORY.format("@")
    bodies = [
        f'<form id="aspnetForm"><ul class="menu"><li>Home<li>News</ul><h1>Title @</h1><div>{text}</div></form>',
        f'<div class="site no-sidebar"><h1>Title @</h1><p>{text}</p></div>',
        f'<div id="content-share-wrapper"><article><h1>Title @</h1><p>{text}</p></article></div>',
        f'<h1>Title @</h1><div id="content-share-wrapper"><p>{text}</p></div>',
        f'<span class="share"><div><h1>Title @</h1><p>{text}</p></div></span>',
    ]
    for body in bodies:
        pages = [labelled(i, body) for i in range(8)]
        want = [f"Title {i}\n" + STORY.format(i) for i in range(8)]
        assert X.extract_group(pages) == want, body
        if "menu" not in body:
            assert X.extract_group(pages[:1]) == want[:1], body


def test_the_wrapper_finds_the_text_of_labelled_pages_without_article():
    """No element or class name tells anything here: alignment alone decides."""
    draw = random.Random(8)
    adverts = [f"Buy the new lamp number {k} in our shop today" for k in range(3)]
    pages, want = [], []
    for i in range(30):
        paragraphs = [f"Paragraph {k} of {i} tells of things that no other page tells {draw.random()}." for k in range(draw.randint(1, 5))]
        text = "".join(f"<p>{p}</p>" for p in paragraphs)
        tree = f"<div class=a1><ul><li>Home<li>Sport<li>Weather</ul></div><div class=a2>{draw.choice(adverts)}</div><div class=a3><h2>Head {i}</h2>{text}</div><table><tr><td>Terms of use<td>Imprint</table><div class=a4>All rights are with the people of this site.</div>"
        pages.append(labelled(i, tree))
        want.append("\n".join([f"Head {i}", *paragraphs]))
    out = X.extract_group(pages)
    right = sum(a == b for a, b in zip(out, want, strict=True))
    assert right >= 27, out[0]
    assert X.content(X.parse(pages[0]), set(), 1) != want[0].split("\n")  # without alignment the template would stay


def test_two_pages_of_a_host_are_enough_for_a_wrapper():
    body = "<div>Welcome to this site</div><div><p>" + STORY.format("@") + "</p></div><div>Imprint</div>"
    assert X.extract_group([labelled(i, body) for i in range(2)]) == [STORY.format(i) for i in range(2)]


def test_copies_of_an_article_are_not_template():
    paragraphs = [f"Paragraph {k} that many copies of the same long article share word for word." for k in range(12)]
    pages = [labelled(i, "<div>Welcome to this site</div><div>" + "".join(f"<p>{p if k != i % 12 else p + ' Edited ' + str(i)}</p>" for k, p in enumerate(paragraphs)) + "</div>") for i in range(24)]
    pages += [labelled(i, f"<div>Welcome to this site</div><div><p>{STORY.format(i)}</p></div>") for i in range(3)]
    out = X.extract_group(pages)
    assert all(len(t.split("\n")) == 12 for t in out[:24]) and out[24:] == [STORY.format(i) for i in range(3)]


def test_boilerplate_in_an_article_goes_where_nearly_all_pages_share_it():
    page = "<article><h1>Title @</h1><p>" + STORY.format("@") + "</p><div>Ask your questions in our forum.</div></article>"
    assert X.extract_group([labelled(i, page) for i in range(10)])[4] == "Title 4\n" + STORY.format(4)


def test_comments_longer_than_the_text_go():
    page = "<div><p>" + STORY.format("@") + "</p></div><div class='comments'>" + "".join(f"<p>Reader {k} of @ writes at length about this and that.</p>" for k in range(30)) + "</div>"
    pages = [labelled(i, page) for i in range(4)]
    assert X.extract_group(pages) == [STORY.format(i) for i in range(4)] and X.extract_group(pages[:1]) == [STORY.format(0)]


def test_heads_that_are_not_closed():
    assert X.extract_group(["<html><head><title>x</title><meta a=b><p>Text"]) == ["Text"]


NEUTRAL = {
    "a constant leaf beside a varying one": ("<div>Site slogan here</div><div>@ is what this page is about, at some length.</div><section>Imprint and terms of use</section>", "@ is what this page is about, at some length."),
    "a constant end of a run": ("<p>First paragraph of @, which no other page has.</p><p>Second one of @.</p><p>All rights reserved by the site.</p>", "First paragraph of @, which no other page has.\nSecond one of @."),
    "teasers and reactions round an article": ("<div class=k1>Site slogan here</div><article><h1>Title @</h1><p>" + STORY.format("@") + "</p></article><div class=k2>Read next: story number @ and a half</div><div class=k3><div>Teaser of @</div><div>Reader @ writes: well said.</div></div>", "Title @\n" + STORY.format("@")),
    "a line of the site in an article": ("<article><h1>Title @</h1><p>" + STORY.format("@") + "</p><p>" + STORY.format("next to @") + "</p></article><div>More about the number @</div>", "Title @\n" + STORY.format("@") + "\n" + STORY.format("next to @")),
}


def test_hosts_of_two_to_twelve_pages_are_read_alike():
    for name, (body, want) in NEUTRAL.items():
        for n in range(2, 13):
            assert X.extract_group([labelled(i + 100, body) for i in range(n)]) == [want.replace("@", str(i + 100)) for i in range(n)], (name, n)


def test_labelled_pages_with_neutral_names():
    """Slogan, menu, teaser and reactions without telling names; alignment takes the slogan, the article the rest."""
    draw, pages, want = random.Random(12), [], []
    for i in range(30):
        paragraphs = [f"Paragraph {k} of {i} tells of things that no other page tells {draw.random()}." for k in range(draw.randint(2, 6))]
        text = "".join(f"<p>{p}</p>" for p in paragraphs)
        reactions = "".join(f"<div>Somebody {draw.random()} liked it</div>" for _ in range(draw.randint(0, 3)))
        pages.append(labelled(i, f"<div class=b1>The slogan of this site</div><div class=b2>Read next: {draw.random()}</div><main><h1>Head {i}</h1>{text}<p>Share your view with the editors of this site.</p></main><div class=b3>{reactions}</div>"))
        want.append("\n".join([f"Head {i}", *paragraphs]))
    right = lambda texts: sum(a == b for a, b in zip(texts, want, strict=True))
    assert right(X.extract_group(pages)) >= 27
    assert right([X.extract_group([p])[0] for p in pages]) == 0  # each by itself: the last line of the main element stays


def test_odds_ask_for_less_of_more_pages():
    least = [next(k for k in range(2, n + 2) if k > n or X.odds(k, n, 0.1) >= 0) / n for n in range(2, 49)]
    assert least[0] == 1 and least[-1] <= 0.3 and all(a - b >= -1 / n for n, (a, b) in enumerate(zip(least, least[1:], strict=False), 2))
    assert X.odds(90_000, 100_000, 0.1) > 0 > X.odds(9_000, 100_000, 0.1)


def test_a_slot_of_very_many_texts():
    pages = [labelled(i, "<div>" + "".join(f"<p>Line {k} of the page with number {i}.</p><p>yes</p>" for k in range(400)) + "</div><section>Imprint of the site</section>") for i in range(4)]
    assert [t.count("\n") for t in X.extract_group(pages)] == [399] * 4
