"""Further columns whose names clash with the operators' own change nothing."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("debitage.llm")

from debitage.llm import ann, binout, decontam, licenses, packing, sharding, simhash, urls, wrapper  # noqa: E402
from debitage.llm.queries import tokenizer_path  # noqa: E402

NAMES = ["row", "row_key", "n", "h", "d", "w", "p", "t", "fp", "rep", "key", "part", "own", "number", "size", "shard", "slot", "rank", "score", "v", "codes", "host", "path", "tail", "rule", "verdict", "piece", "length", "labels", "component_id"]


def clashing(df):
    return df.withColumns({c: F.lit(None).cast("int") if k % 2 else F.lit("clash") for k, c in enumerate(NAMES)})


def documents(spark):
    texts = [None, "", "mit license and apache license", "same text here", "same text here", "one two three four five six " * 9]
    return spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string")


def pages(spark):
    html = "<html><body><div><a href='/'>Home</a></div><div><p>Words of article {} stand here, and more of them follow it.</p></div></body></html>"
    rows = [(k, f"https://h{k % 2}.org/en/{k}", html.format(k)) for k in range(6)] + [(None, None, None), (9, "https://x.com/de/1", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def vectors(spark):
    return spark.createDataFrame([(k, [float(k % 7), 1.0, float(k)]) for k in range(0, 220, 10)] + [(None, None), (5, [0.0] * 3)], "vec_id long, embedding array<float>")


RUNS = {
    "ann": (vectors, ann.nearest),
    "wrapper": (pages, wrapper.extract),
    "packing": (documents, lambda d: packing.pack(d, tokenizer_path()).drop("sequence_id", "offset")),
    "decontam": (documents, lambda d: decontam.contained_items(d, clashing(d.sparkSession.createDataFrame([(1, "three four five six one two"), (2, None)], "item_id long, text string")))),
    "licenses": (documents, licenses.scan),
    "sharding": (documents, lambda d: sharding.shard(d).select("doc_id", "size", "text_crc32", "law")),
    "simhash": (documents, simhash.near_duplicates),
    "urls": (pages, lambda d: urls.judge(d).drop("score")),
}


@pytest.mark.parametrize("name", RUNS)
def test_clashing_columns_change_nothing(spark, name):
    table, run = RUNS[name]
    plain = table(spark)
    got, want = (sorted(map(str, run(d).collect())) for d in (clashing(plain), plain))
    assert got == want and want


def test_clashing_columns_of_token_shards(spark, tmp_path):
    plain = documents(spark)
    got, want = (sorted(str((r["doc_id"], r["piece"], r["length"], r["ids_crc32"])) for r in binout.ordered(d, tokenizer_path(), str(tmp_path / k)).collect()) for k, d in (("a", clashing(plain)), ("b", plain)))
    assert got == want and want
