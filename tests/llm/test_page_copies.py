from textloom.llm import pages

SITE = "<html><body><div class=top>Welcome all</div><div class=text><p>Story {i} of one host</p></div></body></html>"
DIVIDED = "<html><body><article><div class=story><p>First {i}</p><p>Second</p></div></article></body></html>"


def texts(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in pages.extract_pages(frame).collect()}


def test_copies_keep_their_text_and_repeats_change_nothing(spark):
    copies = [(i, f"http://a.example/{i}", SITE.format(i=1)) for i in range(20)]
    divided = [(100 + i, f"http://b.example/{i}", DIVIDED.format(i=1)) for i in range(6)]
    # different pages of equal text: only scripts differ
    same = [(200 + i, f"http://c.example/{i}", SITE.format(i="x") + f"<script>{i}</script>") for i in range(6)]
    equal = [(300 + i, f"http://d.example/{i}", DIVIDED.format(i="x") + f"<!-- {i} -->") for i in range(6)]
    other = [(400 + i, f"http://e.example/{i}", SITE.format(i=i)) for i in range(5)]
    often = [(500 + i, "http://e.example/0", SITE.format(i=0)) for i in range(300)]
    got = texts(spark, copies + divided + same + equal + other + often)
    assert {got[i] for i in range(20)} == {"Welcome all\nStory 1 of one host"}
    assert {got[100 + i] for i in range(6)} == {"First 1\nSecond"}
    assert {got[200 + i] for i in range(6)} == {"Story x of one host"}
    assert {got[300 + i] for i in range(6)} == {"First x\nSecond"}
    assert [got[400 + i] for i in range(5)] == [f"Story {i} of one host" for i in range(5)]
    assert {got[500 + i] for i in range(300)} == {"Story 0 of one host"}


def low(*paths):
    return {pages.node_of(p) for p in paths}


def test_branches_that_hold_most_of_an_article_or_all_text_stay():
    assert pages.main_text(DIVIDED.format(i=1), low("/html/body/article/div.story/p", "/html/body/article/div.story")) == "First 1\nSecond"
    assert pages.main_text(SITE.format(i=1), low("/html/body", "/html/body/div.top")) == "Story 1 of one host"
    assert pages.main_text(SITE.format(i=1), low("/html/body/div.top", "/html/body/div.text", "/html/body/div.text/p")) == "Story 1 of one host"
    # a branch with something important below it stays whole
    nested = "<html><body><div class=a>Label<div class=b>Unlike text</div></div></body></html>"
    assert pages.main_text(nested, low("/html/body/div.a")) == "Label\nUnlike text"
