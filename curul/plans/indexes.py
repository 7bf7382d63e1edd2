"""Written indexes over the given tables, made once for each state of the files that they are made from."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curul.operators import vectors
from curul.operators.index import TextIndex, write_index
from curul.operators.keyed import spread
from curul.plans import staged
from curul.session import shared_folder
from curul.sources.scans import table
from curul.sources.staging import stage


#: Part of an index's name; another one has every index written anew.
EDITION = ""


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def place_of(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """A folder below the cluster's shared one, named by the files that the rows come from, their sizes and their times."""
    state = []
    for file in sorted(rows.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        state.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    digest = hashlib.sha256("\n".join([EDITION, name, *state]).encode()).hexdigest()[:24]
    return f"{shared_folder(spark).rstrip('/')}/curul-index-{digest}/{name}"


def _text_index(spark: SparkSession, rows: DataFrame, name: str, key: str, text: str, grams: bool = True) -> TextIndex:
    """An index of texts; short ones, whose trigrams are listed too, come from small files and are dealt over the tasks first."""
    path = place_of(spark, rows, name)
    if not _exists(spark, f"{path}/figures/_SUCCESS"):  # the last table written
        texts = rows.select(key, text)
        write_index(spread(texts, key) if grams else texts, key, text, path, grams)
    return TextIndex(spark, path)


def documents(spark: SparkSession, folder: str) -> TextIndex:
    return _text_index(spark, table(spark, folder, "documents", "doc_id", "text"), "documents", "doc_id", "text", grams=False)


def titles(spark: SparkSession, folder: str) -> TextIndex:
    return _text_index(spark, stage(spark, folder, "st_initiatives"), "titles", "id", "canonical_title")


def names(spark: SparkSession, folder: str) -> TextIndex:
    return _text_index(spark, staged.authors(spark, folder), "names", "id", "full_name")


def vector_lists(spark: SparkSession, folder: str) -> str:
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    path = place_of(spark, rows, "vectors")
    if not _exists(spark, f"{path}/figures/_SUCCESS"):
        vectors.write_lists(rows, "vec_id", "embedding", path)
    return path


MAKERS: dict[str, Callable] = {"documents": documents, "titles": titles, "names": names, "vectors": vector_lists}
