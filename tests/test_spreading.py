"""Costly work a row is dealt over the tasks; the reader gives what is asked for."""

import pytest

from curul.functions.html import with_elements
from curul.plans import indexes, page_queries, text_queries


@pytest.mark.parametrize("staged", [page_queries.popup_pages, page_queries.senate_pages, page_queries.results_pages, page_queries.gazette_pages, text_queries._signatures])
def test_a_small_file_is_read_by_all_tasks(spark, small, staged):
    assert staged(spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_only_asked_elements_are_described(spark):
    html = "<ul><li>uno <a href='/x'>dos</a></li></ul><table><tr id=t><th>a</th><td>b</td><td></td></tr></table>"
    rows = spark.createDataFrame([("u", html)], "url string, html string")
    whole = {e.tag: e for e in with_elements(rows).first().elements}
    assert set(whole) == {"li", "a", "tr", "th", "td"} - {"th"} and whole["a"].container == "uno dos" and whole["tr"].cells == ["a", "b", ""]
    (row,) = with_elements(rows, ["tr"], ["data_cells"]).first().elements
    assert row.tag == "tr" and row.data_cells == ["b", ""] and (row.text, row.cells, row.html) == (None, None, None)


def test_short_texts_are_indexed_by_all_tasks(spark, small, monkeypatch, tmp_path):
    dealt = {}
    monkeypatch.setattr(indexes, "write_index", lambda rows, key, text, path, grams: dealt.update({key: rows.rdd.getNumPartitions()}))
    monkeypatch.setattr(indexes, "TextIndex", lambda spark, path: None)
    monkeypatch.setattr(indexes, "EDITION", str(tmp_path))
    indexes.titles(spark, small)
    assert dealt["id"] >= spark.sparkContext.defaultParallelism
