"""Repeated word windows and byte strings against plain versions."""

import brute
import pytest
from pyspark.sql import functions as F

from leeward.llm import repeats, suffixes


@pytest.mark.parametrize("width", [5, 50])
def test_word_windows(corpus, documents, width):
    found = repeats.remove_repeats(documents, width=width, bytes_per_bucket=20_000)
    assert found.columns == [*documents.columns, "n_words", "n_removed"]
    wanted = brute.word_windows(corpus, width)
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.text or "")) for r in found.collect()}
    assert got == wanted


@pytest.mark.parametrize("width", [60, 100])
def test_byte_strings(corpus, documents, width):
    found = suffixes.remove_repeats(documents, width=width, bytes_per_bucket=20_000)
    wanted = brute.byte_strings(corpus, width)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in found.collect()}
    assert got == wanted


def test_null_ids_repeated_rows_and_taken_names(spark):
    long = " ".join(f"t{i}" for i in range(80))
    rows = [(None, long, 1), (5, long, 2), (5, long, 3), (9, long, 4), (9, "short", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int")
    words = {r.n_removed: r.n_removed_ for r in repeats.remove_repeats(docs).collect()}
    assert words == {1: 0, 2: 0, 3: 0, 4: 80, 5: 0}
    strings = {r.n_removed: (r.n_removed_, r.n_spans) for r in suffixes.remove_repeats(docs).collect()}
    assert strings == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (len(long), 1), 5: (0, 0)}


def test_strings_that_repeat_within_themselves(spark):
    docs = [(1, "a" * 350), (2, "abc" * 200), (3, "b" + "a" * 120), (4, "x" * 99), (5, "x" * 99)]
    found = suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in found.collect()}
    assert got == brute.byte_strings(docs, 100)


def test_no_rows(documents):
    empty = documents.where(F.lit(False))
    assert repeats.remove_repeats(empty).count() == 0
    assert suffixes.remove_repeats(empty).count() == 0
