"""Outputs replaced as a whole, empty tables, and table functions as extractors."""

import pytest
from pyspark.sql.functions import udtf

from pagequarry.operators import sinks, versions
from pagequarry.plans import pipeline, registry
from pagequarry.plans.spec import ExtractSpec
from pagequarry.sources import shred as shredding
from pagequarry.sources.pages import read_pages

SPEC = ExtractSpec(extractor="selector", row_selector="li", selectors={"t": "b"}, provenance=True, quality_report=True)


def test_publish_and_follow_the_manifest(spark, pages, tmp_path):
    path = str(tmp_path / "out")
    assert versions.current(spark, path) is None
    with pytest.raises(LookupError):
        versions.read_part(spark, path)
    one = pipeline.run(pages("<li><b>1</b>", "<li><b>2</b>"), SPEC)
    assert one.publish("parquet", path) == 1
    assert sorted(r.t for r in versions.read_part(spark, path).collect()) == ["1", "2"]
    assert versions.read_part(spark, path, "urls").count() == 2
    assert versions.read_part(spark, path, "quality").first().name == "t"
    assert versions.read_part(spark, path, "failed").count() == 0
    assert versions.read_part(spark, path, "provenance").first().n_pages == 2
    two = pipeline.run(pages('<li><b>3, "x"</b>'), SPEC)
    assert two.publish("csv", path) == 2
    assert [r.t for r in versions.read_part(spark, path).collect()] == ['3, "x"']
    assert versions.manifests(spark, path).count() == 2


@pytest.mark.parametrize("part", ["rows", "quality", "provenance", "urls", "failed"])
def test_a_run_broken_off_leaves_the_version_before(spark, pages, tmp_path, part, monkeypatch):
    path = str(tmp_path / "out")
    result = pipeline.run(pages("<li><b>1</b>"), SPEC)
    result.publish("json", path)
    write = versions.publish

    def broken(spark, path, fmt, parts):
        def stop(folder):
            raise RuntimeError(part)

        return write(spark, path, fmt, parts | {part: stop})

    monkeypatch.setattr(pipeline.versions, "publish", broken)
    with pytest.raises(RuntimeError, match=part):
        pipeline.run(pages("<li><b>2</b>"), SPEC).publish("json", path)
    assert versions.current(spark, path).number == 1
    assert [r.t for r in versions.read_part(spark, path).collect()] == ["1"]
    monkeypatch.undo()
    assert pipeline.run(pages("<li><b>3</b>"), SPEC).publish("json", path) == 2
    assert [r.t for r in versions.read_part(spark, path).collect()] == ["3"]


def test_empty_tables_by_choice(spark, pages, tmp_path):
    none = pipeline.run(pages("<p>no rows</p>"), SPEC)
    with pytest.raises(sinks.EmptyTable):
        none.write("json", str(tmp_path / "a"))
    assert none.write("json", str(tmp_path / "a"), on_empty="skip") is False and not (tmp_path / "a").exists()
    with pytest.raises(sinks.EmptyTable):
        none.publish("json", str(tmp_path / "b"))
    assert none.publish("json", str(tmp_path / "b"), on_empty="skip") is None
    assert versions.current(spark, str(tmp_path / "b")) is None


def test_failed_pages_are_named(pages):
    chosen = pages("<p>a</p>", "<p>b</p>")
    found = pipeline.failed_pages(chosen)
    assert found.columns == ["page_id", "url", "error"] and found.count() == 0
    assert shredding.failures(chosen).columns == ["page_id", "error"]


def test_table_function_as_extractor(spark, pages):
    @udtf(returnType="page_id bigint, row_idx int, col string, col_ord int, value string")
    class Words:
        def __init__(self):
            self.n = 0

        def eval(self, page):
            for word in page["html"].split():
                yield page["page_id"], self.n, "word", 0, word
                self.n += 1

    registry.register_table_function("words", Words)
    rows = pipeline.run(pages("a b", "c"), ExtractSpec(extractor="words")).table.collect()
    assert sorted((r["__page_id"], r["__row_idx"], r["word"]) for r in rows) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    with pytest.raises(KeyError):
        registry.extractor("never registered")


def test_pages_of_html_files(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "https%3A%2F%2Fx.test%2Fp%3Fq%3D1+2.html").write_text(f"<p>{folder}\nsecond line</p>")
    found = read_pages(spark, str(tmp_path / "*"), "html").collect()
    assert {r.url for r in found} == {"https://x.test/p?q=1+2"} and len({r.page_id for r in found}) == 2
    assert sorted(r.html for r in found) == ["<p>a\nsecond line</p>", "<p>b\nsecond line</p>"]


def test_too_many_columns_are_refused(pages):
    def many(pages, spec):
        return pages.selectExpr("page_id", "0 as row_idx", "posexplode(array('a', 'b', 'c', 'd')) as (col_ord, col)", "'x' as value")

    registry.register_extractor("many", many)
    spec = ExtractSpec(extractor="many", max_columns=3)
    assert pipeline.run_long(pages("a"), spec).count() == 4
    with pytest.raises(ValueError, match="more than 3 distinct columns"):
        pipeline.run(pages("a"), spec)
    assert pipeline.run(pages("a"), ExtractSpec(extractor="many", max_columns=4)).columns == ["a", "b", "c", "d"]
