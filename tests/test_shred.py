"""Tree building on lenient markup."""

from pagequarry.sources.shred import shred


def tree(df):
    rows = df.where("pre > 0").orderBy("page_id", "pre").collect()
    return [(r.page_id, r.depth, r.tag, (r.own or "").strip()) for r in rows]


def test_structure_is_repaired(pages):
    got = tree(
        shred(
            pages(
                "<ul><li>a<li>b <b>c</b> d</ul>tail",
                "just text<p>x",
                "<head><title>T &amp; t</title></head>",
                "<p><b>one<br><p>two</p></i><p>three",
                "<table><tr><td>1<td>2<tr><th>3</table>",
                "<div><p>a</div>b</p>",
                "<DIV ID=x CLASS='a  b' id=y>z</DIV><img src=i><br/>",
            )
        )
    )
    assert [t[1:] for t in got if t[0] == 0] == [
        (1, "html", ""), (2, "body", "tail"), (3, "ul", ""), (4, "li", "a"), (4, "li", "b  d"), (5, "b", "c"),
    ]
    assert [t[1:] for t in got if t[0] == 1][2:] == [(3, "p", "just text"), (3, "p", "x")]
    assert [t[2] for t in got if t[0] == 2] == ["html", "head", "title"]
    assert [t[1:] for t in got if t[0] == 3][2:] == [
        (3, "p", ""), (4, "b", "one"), (5, "br", ""), (3, "p", "two"), (3, "p", "three"),
    ]
    assert [t[1:] for t in got if t[0] == 4][2:] == [
        (3, "table", ""), (4, "tr", ""), (5, "td", "1"), (5, "td", "2"), (4, "tr", ""), (5, "th", "3"),
    ]
    assert [t[1:] for t in got if t[0] == 5][2:] == [(3, "div", ""), (4, "p", "a")]
    assert [t[2] for t in got if t[0] == 6][2:] == ["div", "img", "br"]


def test_numbers_text_and_options(pages):
    page = pages("<div id=a> x <p>y <i>z</i></p><!-- no --><script>var q</script></div>", "", None)
    rows = shred(page, text_for="all").orderBy("page_id", "pre").collect()
    first = [r for r in rows if r.page_id == 0]
    ends = {r.pre: r.end for r in first}
    for r in first[1:]:
        assert r.parent < r.pre <= r.end <= ends[r.parent]
    by_tag = {r.tag: r for r in first}
    assert by_tag["div"].text == "xyz" and by_tag["script"].text == "var q"
    assert by_tag["div"].own_len == 1 and by_tag["p"].n_children == 1
    assert by_tag["#document"].attrs == {"url": "https://site.example.com/p/0"}
    # Empty pages still have their document row.
    assert [(r.page_id, r.tag) for r in rows if r.page_id > 0] == [(1, "#document"), (2, "#document")]
    noted = shred(page, include_comments=True).where("tag = 'div'").first()
    assert "no" in noted.own
    lines = {r.tag: r.up for r in shred(page, ancestors=2).where("page_id = 0").collect()}
    assert lines["i"] == [by_tag["p"].pre, by_tag["div"].pre]


def test_plain_tags_are_read_as_the_parser_reads_them(monkeypatch):
    import random
    from html.parser import HTMLParser

    from pagequarry.sources import shred as module

    class Slow(module._Tree):
        goahead = HTMLParser.goahead

    def rows(tree, html):
        error = module._build(tree, html)
        return error or [*module._page_rows(tree, 1, None, "all", 0), *module._piece_rows(tree, 1)]

    bits = [
        "<p>", "</p>", "<B>", "</B >", "<td>", "</td>", "<tr>", "<table>", "</table>", "<br/>", "<li class=\"a  b\" ID=\"i\">",
        "<a href=\"/x?y=1&amp;z\">", "<a href='q'>", "<a href=\"x>y\">", "<a href=\"\" href=\"2\">", "<a href=\"open", "</div x=\"y\">",
        "<script>", "</script>", "<STYLE>", "</style>", "<title>", "</title>", "<textarea>", "</textarea>", "<!DOCTYPE html>", "<!--", "-->",
        "<![CDATA[", "]]>", "<?pi", "<1>", "<é>", "</", "<", ">", "&", "&amp;", "&#65", ";", "text", " two ", "\n", "é", "<html lang=\"en\">", "<body>",
    ]
    deal = random.Random(3)
    for _ in range(4000):
        html = "".join(deal.choice(bits) for _ in range(deal.randint(1, 20)))
        for comments in (False, True):
            assert rows(module._Tree(comments), html) == rows(Slow(comments), html), html
    # Pages of plain tags need none of the parser's own steps.
    plain = "<ul class=\"k\"><li>a &amp; b</li><li id=\"x\">c</li></ul> tail <b>d</b>"
    want = rows(Slow(False), plain)
    monkeypatch.setattr(HTMLParser, "parse_starttag", None)
    monkeypatch.setattr(HTMLParser, "parse_endtag", None)
    assert rows(module._Tree(False), plain) == want and len(want) == 7
