import pytest

from textloom.llm import pages

BODY = "<body><div class=menu>Home</div>{}<div id=footer-2>me</div></body>"


@pytest.mark.parametrize("wrap", ['class="content no-sidebar"', 'id="page" class="has-sidebar"', 'class="banner-layout"', 'class="widget-area-off"', "class=sidebar", 'class="modal"'])
def test_names_around_an_article(wrap):
    assert pages.main_text(BODY.format(f"<div {wrap}><article><p>Story</p><p>of a day</p></article></div>"), set()) == "Story\nof a day"
    assert pages.main_text(BODY.format(f"<div {wrap}><div role=main><p>Story of a day</p></div></div>"), set()) == "Story of a day"


def test_names_inside_an_article():
    article = "<article><p class=share-price>Up</p><div class=related-work>Others</div><section id=notice>Mind</section><div class=share>Tweet</div><div class='ad ad-1'>Buy</div></article>"
    assert pages.main_text(BODY.format(article), set()) == "Up\nOthers\nMind"


def test_furniture_stays_furniture():
    teaser = "<div class=sidebar><article>Teaser</article></div>"
    assert pages.main_text(BODY.format(f"{teaser}<div class=text>The whole story</div>"), set()) == "The whole story"
    assert pages.main_text(BODY.format(f"{teaser}<article>Real</article>"), set()) == "Real"
    assert pages.main_text(BODY.format("<div id=comments><article>Nice!</article></div><p>A</p>"), set()) == "A"
    assert pages.main_text(BODY.format("<aside><article>Aside</article></aside><p>A</p>"), set()) == "A"
    assert pages.main_text(BODY.format("<div class=sidebar>x<p>y</p><b>z</b></div><p>A <span class=hidden>b</span> c</p>"), set()) == "A\nc"


def test_ambiguous_names_are_left_to_the_tree(spark):
    site = "<body><div class=notice>Shop closed</div><div class=related>Story {i} of one host</div></body>"
    rows = [(i, f"http://a.example/{i}", site.format(i=i)) for i in range(6)]
    got = pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Story {i} of one host" for i in range(6)}
