from tests.llm.test_html import texts_of


def test_parts_of_classes_set_nothing_apart(spark):
    tags = ('article class="post has-sidebar"', 'div id="content" class="with-comments"', 'div class="search-results-article"', 'article class="category-ad"', 'article class="ad"', 'div role="main" class="banner"')
    rows = [(i, f"http://{i}/", f'<nav>Menu</nav><{tag}><p>Main text</p></{tag.split()[0]}><div class="site-footer">Foot</div><div class="ad">Buy</div>') for i, tag in enumerate(tags)]
    rows.append((99, "http://x/", '<div class="sidebar-left"><p>Side</p></div><div class="banner"><main><p>Main text</p></main></div>'))
    assert set(texts_of(spark, rows).values()) == {"Main text"}


def test_running_text_in_an_article_goes_by_its_class(spark):
    page = '<article><p class="notice">{}</p><p>text {}</p><div class="share">Share</div><p class="search">Searching {}</p></article>'
    rows = [(i, "http://a/", page.format(f"Read this {i}", i, i)) for i in range(10)] + [(100 + i, "http://b/", page.format("Like us", i, i)) for i in range(10)]
    got = texts_of(spark, rows)
    assert all(got[i] == got[100 + i] == f"text {i}\n\nSearching {i}" for i in range(10))
