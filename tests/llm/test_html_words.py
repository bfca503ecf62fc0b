"""Class words of an element."""

from factorloom.llm import html_extract


def test_all_class_words_count():
    names = " ".join(f"u{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(60))
    tree = html_extract.parse(f'<body><div class="{names} comments">x</div></body>')
    assert any("comments" in w for w in tree.words)
