"""Pages tables as a folder of files, with addresses that several pages share."""

import hashlib

import pytest

from curul.plans import QUERIES

ROWS = [(1, "https://h/a", "<p>one</p>"), (2, "https://h/a", "<p>two</p>"), (3, "https://h/b", "<p>one</p>"), (4, None, "<p>four</p>")]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def digest(html):
    return hashlib.sha256(html.encode()).hexdigest()


def test_unparsed_pages_keep_their_own_hash(spark, folder):
    rows = sorted(tuple(r) for r in QUERIES["unparsed_pages"](spark, folder).collect())
    assert rows == [(page, digest(html)) for page, _, html in ROWS]


def test_stream_reads_a_folder_of_files(spark, folder):
    rows = {tuple(r) for r in QUERIES["stream_pages"](spark, folder).collect()}
    assert rows == {(url, digest(html)) for _, url, html in ROWS}
