"""Selectors, fields and row scopes."""

import random

import pytest

from pagequarry.operators import automaton
from pagequarry.operators import selectors as css
from pagequarry.plans import sites
from pagequarry.sources.shred import shred

PAGE = (
    '<div id=a class="x y" data-k="p-q r"><ul><li class=k>1</li><li>2<ul><li class=k>3</li></ul></li></ul><p>q</p></div>'
    "<div>z<p class=k>r</p></div>"
)
# Numbers: 1 html, 2 body, 3 div#a, 4 ul, 5 li, 7 li, 9 ul, 10 li, 12 p, 14 div, 16 p.
CASES = {
    "li": [5, 7, 10], "ul > li": [5, 7, 10], "ul li li": [10], ".k": [5, 10, 16], "div > p": [12, 16], "#a p": [12],
    "li.k + li": [7], "div ~ div p": [16], "li:not(.k)": [7], "li:nth-child(2)": [7], "[class~=y]": [3],
    "div#a.x, p.k": [3, 16], "ul ul > li": [10], "div:last-child p": [16], "body > *": [3, 14], "p:only-of-type": [12, 16],
    "[data-k^='p-']": [3], '[data-k$="r"]': [3], "[data-k*='q r']": [3], "[data-k|=p]": [3], "[data-k='p-q']": [],
    "li:first-of-type": [5, 10], "li:nth-of-type(odd)": [5, 10], "li:nth-child(-n+1)": [5, 10], "DIV > UL": [4],
    "div div": [], "html body div": [3, 14], "li > ul > li.k": [10], "ul + p": [12], "p:not(div, .k)": [12],
    "li:nth-last-child(1)": [7, 10], "li:nth-last-child(2)": [5], "li:nth-last-of-type(odd)": [7, 10], ":root": [1],
    ":root > body": [2], ":is(p, ul.x, li.k)": [5, 10, 12, 16], "div:where(#a, .none) > p": [12], "*:empty": [],
    "[id='A' i]": [3], "[id='A']": [], "[data-k$=R i]": [3], "li[class!=k]": [7], "div :not([class!=k])": [5, 10, 16],
    "div > p, div > ul li + li, ul ~ p": [7, 12, 16], "div#a ~ div > p.k": [16], "li:only-child": [10], "ul li:first-child.k": [5, 10],
}


def test_matches(pages):
    # All selectors in one pass over the page: the flags are independent.
    names = {f"s{i}": s for i, s in enumerate(CASES)}
    rows = css.match(shred(pages(PAGE)), names).orderBy("pre").collect()
    got = {s: [r.pre for r in rows if r[n]] for n, s in names.items()}
    assert got == CASES
    assert rows[0].pre == 0 and not any(rows[0][n] for n in names)


def test_automaton_finds_the_same(pages):
    page = pages(PAGE, "", "<p></p><br><p id=a> x</p>")
    want = {(r.page_id, r.pre, k) for k, s in enumerate(CASES) for r in css.select(page, s).collect()}
    got = [tuple(r) for r in automaton.match_many(page, list(CASES)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_automaton_on_random_pages_and_selectors(pages):
    rng = random.Random(3)
    tags, classes = ["div", "p", "b", "ul", "li", "em"], ["x", "y", "z"]

    def markup(depth):
        if depth > 5:
            return rng.choice(["", "t", "<br>"])
        parts = []
        for _ in range(rng.randrange(4)):
            tag = rng.choice(tags)
            parts.append(f"<{tag} class='{' '.join(rng.sample(classes, rng.randrange(3)))}'>{markup(depth + 1)}</{tag}>")
        return "".join(parts)

    def simple():
        out = rng.choice([*tags, "*", ""]) + "".join(f".{c}" for c in rng.sample(classes, rng.choice([0, 0, 1])))
        more = ["", "", "", ":empty", ":first-child", ":nth-last-child(2)", ":not(.x, p)", ":is(b, .y)", ":nth-of-type(2n)", "[class~=z]", ":only-of-type"]
        return (out + rng.choice(more)) or "*"

    def selector():
        chain = simple()
        for _ in range(rng.randrange(4)):
            chain += rng.choice([" ", " ", " > ", " + ", " ~ "]) + simple()
        return chain

    some = [selector() for _ in range(30)] + [f"{selector()}, {selector()}" for _ in range(6)]
    page = pages(*[markup(0) for _ in range(12)])
    rows = css.match(shred(page), {f"s{k}": s for k, s in enumerate(some)}).where("pre > 0").collect()
    want = {(r.page_id, r.pre, k) for r in rows for k in range(len(some)) if r[f"s{k}"]}
    assert {tuple(r) for r in automaton.match_many(page, some).collect()} == want and len(want) > 100


def test_plan_and_work_do_not_grow_with_the_sites(spark, pages):
    page = pages(*[(f"http://www.s{k}.test/", f"<ul class=c{k}><li>a{k}<li class='u  v'>b{k}</ul>") for k in range(300)])
    specs = {f"s{k}.test": {"one": f"ul.c{k} > li", "two": f".c{k} li + li", "words": f".c{k} .u@class", "none": f"ol.c{k}"} for k in range(299)}
    out = sites.extract_by_site(page, specs)
    few = sites.extract_by_site(page, dict(list(specs.items())[:2]))
    size = lambda df: len(df._jdf.queryExecution().executedPlan().toString())
    assert size(out) < 1.2 * size(few) + 200
    got = {(r.page_id, r.col): r.value for r in out.collect()}
    assert len(got) == 4 * 299
    assert all([got[k, c] for c in ("one", "two", "words", "none")] == [f"a{k}", f"b{k}", "u v", ""] for k in range(299))


def test_sites_by_host(spark, pages):
    names = spark.createDataFrame([("b.test",), ("A.b.test",), ("c",)], "name string")
    page = pages(("http://x.a.b.test/", ""), ("http://b.test:80/", ""), ("http://zb.test/", ""), ("", ""), ("http://C/", ""))
    for fits in (0, 100):
        got = {(r.page_id, r.site) for r in sites.with_site(page, names, fits).collect()}
        assert got == {(r.page_id, r.site) for r in sites.route(page, names).collect()}


@pytest.mark.parametrize("bad", ["", " ", "a >", "> a", "a,", ",a", "a..b", "a:has(b)", "a::before", ":nth-child(x)", "a[b", "svg|a"])
def test_bad_selectors_fail_early(spark, bad):
    with pytest.raises(css.SelectorError):
        css.parse(bad)


def test_attribute_suffix():
    assert css.split_spec("a.next@href") == ("a.next", "href")
    assert css.split_spec('a[href*="@x.com"]') == ('a[href*="@x.com"]', None)
    assert css.split_spec("@href") == ("@href", None)
    assert css.split_spec("img @data-src") == ("img", "data-src")


def test_rows_flat_and_one(pages):
    page = pages(
        '<div class=o><ul><li class=card><h2>A</h2><i>1</i><a class="u v" href="/a"> x </a></li>'
        "<li class=card><h2> </h2><i>2</i></li><li class=card><i>3</i><h2>C <b>c</b></h2>"
        "<li class=card><ul><li class=card><h2>in</h2></li></ul></li></ul></div>",
        "<p>none</p>",
        "",
    )
    fields = {"t": "h2", "n": ".o i", "u": "a@class", "none": "h2@id"}
    rows = css.extract_rows(page, "li.card", fields, with_url=True).orderBy("page_id", "row_idx").collect()
    assert [(r.page_id, r.row_idx, r.t, r.n, r.u, r.none) for r in rows] == [
        (0, 0, "A", "1", "u v", ""), (0, 1, "", "2", "", ""), (0, 2, "Cc", "3", "", ""), (0, 3, "in", "", "", ""),
        (0, 4, "in", "", "", ""),
    ]
    assert {r.url for r in rows} == {"https://site.example.com/p/0"}
    one = css.extract_one(page, fields).orderBy("page_id").collect()
    assert [(r.t, r.n, r.u) for r in one] == [("A", "1", "u v"), ("", "", ""), ("", "", "")]
    scoped = css.extract_one(page, {"t": "i"}, row_selector="li:nth-child(2)").orderBy("page_id").collect()
    assert [r.t for r in scoped] == ["2", "", ""]
    flat = css.extract_flat(page, {"t": "h2", "link": "a"}, attribute="href").orderBy("col", "row_idx").collect()
    assert [(r.col, r.row_idx, r.value) for r in flat] == [("link", 0, "/a")] + [("t", i, "") for i in range(4)]
    with pytest.raises(css.SelectorError):
        css.extract_flat(page, {})
