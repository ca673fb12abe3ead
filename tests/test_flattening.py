"""Flattened metadata against a plain walk, in one pass whatever the depth."""

import json

from debitage.operators import annotations as A

DOCS = [
    '{"a":1.50,"b":1e3,"c":123456789012345678901234567890,"t":"}]\\",{"}',
    ' { "x" : { "y\\"z" : [ 1 , { "q" : "]" } ] , "" : { "" : null } } } ',
    '{"u":"\\u0001\\ud83d\\ude00 \\n","\\u0007k\\n":true,"tab\\tkey":{"é.\\\\":false}}',
    '{"w":[{"a":[1,"\\"]"]}],"v":{"z":"[","y":[]},"none":{"also":{}}}',
    '{"d":' * 60 + '{"k":[[],{}]}' + "}" * 60,
    "[1]", "7", "null", None, '{"a":1,"a":2}', "{", "{}",
]


def walk(node, path=()):
    for k, v in node.items():
        if isinstance(v, dict):
            yield from walk(v, (*path, k))
        else:
            yield ".".join((*path, k)), v


def test_leaves_of_odd_documents(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "mesh_id int, json string")
    got = {(r["mesh_id"], r["path"]): r["value"] for r in A.flatten_metadata(df).collect()}
    want = {(i, p): v for i, d in enumerate(DOCS[:5]) for p, v in walk(json.loads(d))}
    assert got.keys() == want.keys()
    assert all(json.loads(got[k]) == v for k, v in want.items())
    assert got[0, "a"] == "1.5" or got[0, "a"] == "1.50"


def test_a_level_is_no_job(spark):
    deep = spark.createDataFrame([(i, '{"d":' * 50 + str(i) + "}" * 50) for i in range(20)], "mesh_id int, json string")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = set(jobs())
    assert A.flatten_metadata(deep).count() == 20
    assert len(set(jobs()) - before) <= 3
