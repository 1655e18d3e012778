"""What names, frames and places of a page decide in op3."""

import pytest

from lexispark.llm import html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h2 id='form-validation'>a</h2><section id='ad-hoc-networks'>b</section><p class='notice-period'>c</p><div class='menu-recipes'>d</div></article>", "a\nb\nc\nd"),
        ("<header>Site</header><article><header><p>By line</p></header><p>t</article>", "By line\nt"),
        ("<article><h2 id=comments>On comments</h2><p>t</p><section id=comments>mine</section><div class='post-comments'>no</div></article>", "On comments\nt"),
        ("<form id=aspnetForm><div class=page-header>no</div><article><p>t</p><input value=x></article></form>", "t"),
        ("<div class='header-wrapper'><main><p>t</p><div class='ad-300x250'>no</div></main></div>", "t"),
        ("<div class='post-header'><h1>T</h1></div><p>t</p><div class='site-footer'>no</div><div id=cookieBanner>no</div>", "T\nt"),
        ("<div class='comment comment-12'>no</div><div class='comment-list'>no</div><ul class='top-nav'><li>no</ul><p class='sidebar-widget'>no<p>t", "t"),
    ],
)
def test_names(page, text):
    assert "\n".join(html.cut(page)[0]) == text


def test_articles_keep_shared_passages_but_lose_the_frame_inside_them(spark):
    page = "<article><h1>T{i}</h1><div>Follow us on all channels.</div>{body}<p>Written for the daily news.</p></article>"
    own = [[f"<p>Own {i} {k}.</p>" for k in range(6 + i % 3)] for i in range(8)]
    for i in range(0, 8, 2):  # a passage that half of the pages share, each at another place
        own[i].insert(i // 2, "<p>Les.</p>")
    rows = [(i, f"http://a.example/fr/{i}", page.format(i=i, body="".join(own[i]))) for i in range(8)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == "\n".join([f"T{i}", *(x[3:-4] for x in own[i])])
