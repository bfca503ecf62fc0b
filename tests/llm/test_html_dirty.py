"""Pages that are no proper HTML, and the text leaves against another parser."""

import html.parser
import time

import pytest

from factorloom.llm import html_extract


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_cost_is_linear_in_dirty_pages(model):
    n = 100_000
    pages = ["<a " * 350_000, '<a b="' * n, '<a "b>" ' * n + "<a '", ('<a "' * (n + 1)) + "<b>" * n, "<div>" * 1000 + "</p></li></td>" * n, "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<div>" * 40_000 + "x" + "</span></section>" * 20_000, "<video>" * n, "<!--" * n, "<div><p>" * 40_000]
    for page in pages:
        began = time.process_time()
        model.extract(page)
        assert time.process_time() - began < 10, page[:20]


def test_unclosed_and_bare(model):
    assert model.extract("just text without tags &amp; <b>more</b>") == "just text without tags & more"
    assert model.extract("   ") == model.extract("") == model.extract("<!-- nothing -->") == ""
    assert model.extract("<div class=ad>x</div><article><video><p>hi there my friend</article>") == "hi there my friend"
    assert model.extract("<article><p>kept text of it<script>var x = '<p>gone") == "kept text of it"
    assert model.extract("<article><p>kept text of it</p><a href='x") == "kept text of it"
    assert model.extract('<article data-y="x" class="content"><p>a mark that is no mark</article>') == "a mark that is no mark"


class Leaves(html.parser.HTMLParser):
    """Runs of text between block-level tags, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.run, self.raw = [], [], None

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.run.append(" ")
        if tag in html_extract.RAW:
            self.raw = tag
        if tag in html_extract.BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag == self.raw:
            self.raw = None
        if tag in html_extract.BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.raw:
            self.run.append(data)


def test_leaves_are_those_of_another_parser():
    for page in html_extract.labelled_pages(80, seed=5):
        other = Leaves()
        other.feed(page)
        other.close()
        other.flush()
        assert [t for t in html_extract.parse(page).text if t] == other.out
