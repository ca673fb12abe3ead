"""Rows that near-dedup keeps where doc_ids are null or repeated."""

import random

import pytest

pytest.importorskip("debitage.llm")

from debitage.llm import nearcopies, simhash  # noqa: E402


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")


@pytest.mark.parametrize("drop", [nearcopies.drop_near_copies, simhash.drop_near_duplicates])
def test_null_and_repeated_ids_keep_their_texts(spark, drop):
    rng = random.Random(18)
    one, two, three, four, five = (" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(5))
    rows = [(None, one), (None, two), (None, two), (7, three), (7, four), (7, four), (8, three), (None, four), (6, five), (7, five)]
    got = sorted(((r["doc_id"], r["text"]) for r in drop(table(spark, rows)).collect()), key=str)
    assert got == sorted([(None, one), (None, two), (7, three), (7, four), (6, five)], key=str)


@pytest.mark.parametrize("drop", [nearcopies.drop_near_copies, simhash.drop_near_duplicates])
def test_columns_of_any_name_pass_through(spark, drop):
    names = ["doc_id", "text", "_row", "row", "_copies", "component", "fp", "k.v", "th"]
    rows = [(k, f"words of text {k % 2} " * 9, k, k, k, "c", 1.0, "d", 3) for k in range(6)]
    d = spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, ["long", "string", "long", "long", "long", "string", "double", "string", "int"], strict=True)))
    out = drop(d)
    assert out.columns == names and sorted(r[0] for r in out.collect()) == [0, 1]
