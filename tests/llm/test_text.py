import collections
import html
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_text, quality

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), failed


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["a", "b", "#c", "d|", "é f", "　", "<g>", "$", "😀"]
    gaps = [" ", " ", "\n", "\t", "\x0b", "\r\n", "  "]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 150))) for _ in range(150)]
    texts += [None, "", " ", "\n\n", "x " * 60000, "one two three one two three"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 0), (None, "hi", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit("clash")).withColumn("loss", F.lit("clash"))
    found = quality.assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((r[0], *base(r[1]))) for r in rows)
    assert quality.assess(spark.createDataFrame([], SCHEMA)).collect() == []


def prose(n):
    """Lines of distinct made-up words."""
    return [f"Line{i} " + " ".join(f"w{i}x{j}" for j in range(12)) + " ends." for i in range(n)]


GOOD = prose(1)[0]


@pytest.mark.parametrize(
    "line,fails",
    [
        (GOOD, False),
        ("Home | News | Sport | About | Contact", True),
        ("Was### this$$$ ever%%% meant&&& to*** be### read$$$", True),
        ("BUY!! NOW!! IT!! IS!! CHEAP!!", True),
        ("Please accept all cookies to go on reading this page of ours.", True),
        ("spam spam spam spam spam spam spam spam spam spam", True),
        ("It cost $5, or 10% less, & that was fine with all of us who came along then.", False),
        ("Title of the piece", False),
        ("The dog saw the dog and the cat saw the cat as well as the dog.", False),
    ],
)
def test_line_rules(spark, line, fails):
    text = "\n".join([*prose(8)[1:], line])
    (row,) = quality.assess(spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA)).collect()
    assert (line not in row["cleaned"].split("\n")) == fails and row["kept"]


def test_short_cuts_of_the_line_rules_find_the_same():
    phrases = ["accept cookies", "accept all cookies", "Cookie Policy", "privacy policy", "terms of use", "terms of service", "All rights reserved", "enable JavaScript", "log in to", "sign in to", "sign up for"]
    phrases += ["subscribe to our", "click here to", "share this ", "share on ", "follow us on", "back to top", "skip to content", "skip to main content", "lorem ipsum"]
    for phrase in phrases:
        for line in (phrase, f"x{phrase.upper()}x", phrase[:-1], phrase[1:], phrase.replace(" ", "  ", 1), f"accept {phrase}"):
            assert bool(re.search(quality.FURNISHED, line)) == bool(re.search(quality.FURNITURE, line))
    assert all(re.search(quality.MARKS, mark) for mark in [*quality.SYMBOLS, "!!", "|", ">", ">>", "»", "›", "·", "•", "/"]) and not re.search(quality.MARKS, "a! b? c-d.")


def test_lines_of_blanks_have_no_word(spark):
    text = "\n".join([*prose(6), " \t", "\x0b\x0c\r", " \t", "", "\u3000", "\u3000"])
    row = quality.assess(spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA)).first()
    assert row["n_dup_lines"] == 1 and row["cleaned"] == text and row["loss"] == 0


def test_long_clean_lines_stay(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(20000)) + "."
    once = " ".join(f"v{i}" for i in range(200)) + " and see the privacy policy before you sign in to it."
    spam = " ".join(["buy this fine thing here now or later"] * 2500)
    footer = "Read our privacy policy, our cookie policy and the terms of use, all rights reserved, then go back to top of this page and sign up for the daily mail."
    rows = [(1, long, "en", "s", 0), (2, once, "en", "s", 0), (3, long + " Then sign in to read on.", "en", "s", 0), (4, spam, "en", "s", 0), (5, "\n".join([*prose(8), footer]), "en", "s", 0)]
    found = {r["doc_id"]: r for r in quality.assess(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r["kept"] for i, r in found.items()} == {1: True, 2: True, 3: True, 4: False, 5: True}
    assert all(found[i]["loss"] == 0 for i in (1, 2, 3)) and found[4]["loss"] == 1 and found[5]["cleaned"] == "\n".join(prose(8))


def test_documents_that_lose_too_much_go(spark):
    nav = "Home | News | Sport | About | Contact | Help | Terms | Jobs"
    good = prose(5)
    rows = [(1, "\n".join(good + [nav]), "en", "s", 0), (2, "\n".join(good[:1] + [f"{nav} {i}" for i in range(12)]), "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"]: r["kept"] for r in quality.assess(docs).collect()} == {1: True, 2: False}
    (left,) = quality.cleaned_documents(docs).collect()
    assert left["text"] == "\n".join(good) and left["n_chars"] == len(left["text"]) and quality.cleaned_documents(docs).columns == docs.columns


def test_cleaned_documents_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "\n".join(prose(6)), "en", "s", 0)], SCHEMA).withColumn("kept", F.lit("mine")).withColumn("loss", F.lit(7))
    (row,) = quality.cleaned_documents(docs).collect()
    assert (row["kept"], row["loss"]) == ("mine", 7) and quality.cleaned_documents(docs).columns == docs.columns


def test_helper_names_may_be_taken(spark):
    docs = spark.createDataFrame([(1, "\n".join(prose(6)), "en", "s", 0)], SCHEMA)
    for name in ("_content", "_words", "_lines", "_dup", "_good", "_repeat", "_held_kept", "Kept"):
        docs = docs.withColumn(name, F.lit("mine"))
    (row,) = quality.cleaned_documents(docs).collect()
    assert row["_words"] == row["Kept"] == row["_held_kept"] == "mine" and row["n_chars"] == len(row["text"])
    (row,) = quality.assess(docs).collect()
    assert row["_dup"] == "mine" and row["n_dup_lines"] == 0 and row["kept"] is True


def test_a_filter_does_not_repeat_the_work(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 5000}" for i in range(20000)), "en", "s", 0)], SCHEMA)
    plan = quality.assess(docs).filter("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws") == 1
    assert quality.cleaned_documents(docs).count() == 0


def test_plan_is_native(spark):
    plan = quality.assess(spark.createDataFrame([(1, "x", "en", "s", 0)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Exchange"))


def test_pages_of_the_test_data():
    for (page,) in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", block)).split()) for block in re.split(r"</?(?:p|h1)>", article)]
        assert html_text.extract(page) == "\n".join(block for block in blocks if block)


LONG = "Some sentence of the article, with a comma or two, that goes on for a while so that it counts as prose."


@pytest.mark.parametrize(
    "page,expected",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("plain words &lt;here&gt;", "plain words <here>"),
        (f"<body><div id=content><p>{LONG}<p>Two&nbsp;&amp;\n three<ul><li>one<li>two</ul></div><div class='sidebar'><p>{LONG}</p></div>", f"{LONG}\nTwo & three\none\ntwo"),
        (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}</p><aside>see also</aside><p>Short.</p></article><section class=comments><p>{LONG}</p><p>{LONG}</p></section>", f"T\n{LONG}\nShort."),
        (f"<main><p>{LONG}</p><form><p>mail</p><input></form><div class='ad-box ad'>buy</div><script>if (a < b) document.write('<p>x</p>')</script><p>{LONG}</p></main><footer>c</footer>", f"{LONG}\n{LONG}"),
        (f"<div class=post><p>{LONG}</p></div><!-- <p>hidden</p> --><div class='cookie-notice'>We use cookies</div><div role=navigation>a b c</div><header>H</header>", LONG),
        (f"<div><div><p>{LONG}</p></div><div><p>{LONG}</p></div><div><a href=1>one link</a> <a href=2>two</a></div></div>", f"{LONG}\n{LONG}"),
        (f"<article><p>a<b>b<i>c</b>d</i> e<br>f</p>{LONG}<p style='display: none'>gone</p><table><tr><td>x<td>y</table></article>", f"abcd e f\n{LONG}\nx\ny"),
        (f"<article><p title='a > b'>{LONG}</p><p>1 < 2 <3 &amp &copy; &#233;</p>", f"{LONG}\n1 < 2 <3 & © é"),
    ],
)
def test_extraction(page, expected):
    assert html_text.extract(page) == expected


ARTICLE = f"<p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>"


@pytest.mark.parametrize(
    "page,expected",
    [
        (f"<article><p>{LONG}</p><div class='commentary'><p>Said {LONG}</p></div><p class='share-price'>12.50</p><section id='related-work'><p>Before us.</p></section></article>", [LONG, f"Said {LONG}", "12.50", "Before us."]),
        (f"<main><p>{LONG}</p><article class='comment'><p>Mine. {LONG}</p></article></main>", [LONG]),
        (f"<article>{ARTICLE}<article class='comment'><p>Mine. {LONG}</p></article></article>", [LONG] * 3),
        (f"<body><div class=body><div>{ARTICLE}</div><div><p>Short end.</p></div></div><div><a href=1>x</a> <a href=2>y</a></div></body>", [LONG] * 3 + ["Short end."]),
        (f"<body><h1>Title</h1><div><div>{ARTICLE}</div></div><div><div><p>Tiny.</p></div></div><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></body>", ["Title"] + [LONG] * 3 + ["Tiny."]),
        (f"<body class='has-sidebar'><article class='post no-banner'><header class='entry-header'><h1>T</h1></header>{ARTICLE}</article><div class='commentList'><p>{LONG}</p></div></body>", ["T"] + [LONG] * 3),
        (f"<div id=page><div class='related-posts'><p>{LONG}</p></div><div class=text>{LONG}<br>{LONG}<p>End, at last.</p></div><div class='share-buttons'>share</div></div>", [f"{LONG} {LONG}", "End, at last."]),
    ],
)
def test_names_and_scores_find_the_article(page, expected):
    assert html_text.extract(page) == "\n".join(expected)


def test_pages_without_article_elements():
    """The pages of the test data with their article as a plain element, or split into two."""
    for (page,) in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall():
        body = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", block)).split()) for block in re.split(r"</?(?:p|h1)>", body)]
        cut = body.rindex("<p>")
        for other in (f"<div class='story'>{body}</div>", f"<div><div>{body[:cut]}</div><div>{body[cut:]}</div></div>"):
            plain = re.sub(r"<article>.*</article>", lambda m: other, page, flags=re.S)
            plain = re.sub(r"</?main[^>]*>", "", plain)
            assert html_text.extract(plain) == "\n".join(block for block in blocks if block)


def test_extraction_takes_time_in_proportion():
    import time

    began = time.perf_counter()
    for page in ("<div>" * 20000 + "</p>" * 20000 + "<li>" * 20000, "<b><div>" + "<i>" * 20000 + "</b>" * 20000, "<header>" * 20000, "<p>" + LONG * 20000):
        html_text.extract(page)
    assert time.perf_counter() - began < 20


def test_extraction_of_hostile_pages():
    assert html_text.extract("<div>" * 20000 + LONG) == LONG
    assert html_text.extract('<p title="' + "x" * 100000) != None  # noqa: E711
    assert html_text.extract("<" * 100000) == "<" * 100000


def test_main_text_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (1, "u", f"<article><p>{LONG}</p></article>", "x"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_text.main_text(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0)]))
    assert html_text.main_text(spark.createDataFrame([], pages.schema)).collect() == []
