"""License scans by diagonal voting, in DataFrame functions only.

Every rolling pair of words of a text is hashed and joined to the positions of the
same pair in the license templates.  A hit at word p of a text and word q of a
template lies on diagonal p - q: a copy of the template piles its hits on one
diagonal, one with words put in or left out on neighbouring ones.  Hits are counted
by diagonal, each diagonal is merged with those up to ``DRIFT`` behind it, which is a
stretch of the template's length and so many words more, and a span is verified: its
words are the template's (the join compares them, not the hashes alone), and what counts
is the longest run of its pairs that stand in the template's order in the text.  The templates are a fixed table of a few kilobytes, so the join is a
broadcast one and nothing but hits and one short row a text is shuffled.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that the method looks for besides, with labels of its own.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "general public license version 3": "gpl-3.0",
    "general public license version 2": "gpl-2.0",
    "released under the mit license": "mit-notice",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-grant",
}
#: Share of a notice's word pairs that a span must cover.
COVERED = 0.8
#: Diagonals of one span are at most so far apart: so many words are put in, or left out, in all.
DRIFT = 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def templates(spark: SparkSession) -> DataFrame:
    """t, base, label, pairs, q, h, u, v: the word pairs (u, v) of each phrase and notice, at most 64 each.

    One more row, of two empty words, is what every text meets once.
    """
    rows = [(-1, False, "", 1, 0, "", "")]
    for t, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
        words = text.split()
        rows += [(t, t < len(PHRASES), label, len(words) - 1, q, u, v) for q, (u, v) in enumerate(zip(words, words[1:], strict=False))]
    return spark.createDataFrame(rows, "t int, base boolean, label string, pairs int, q int, u string, v string").withColumn("h", F.xxhash64("u", "v"))


def words_of(text: Column) -> Column:
    """The words of a text as they stand: runs of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")


def _in_order(near: Column, pairs: Column) -> Column:
    """The most pairs of a span (diagonal, covered as bits of q) that follow one another both in the text and in the template."""
    hits = F.flatten(F.transform(near, lambda x: F.transform(F.filter(F.sequence(F.lit(0), pairs - 1), lambda q: F.getbit(x.covered, q) == 1), lambda q: F.struct((x.diagonal + q).alias("p"), (-q).alias("back")))))
    # by place in the text, of one place the later pair first, so that it isn't counted behind the other
    longest = F.aggregate(
        F.array_sort(hits),
        F.transform(F.sequence(F.lit(0), pairs - 1), lambda q: F.lit(0)),
        lambda best, h: F.transform(best, lambda v, q: F.when(q == -h.back, F.greatest(v, 1 + F.coalesce(F.array_max(F.slice(best, F.lit(1), -h.back)), F.lit(0)))).otherwise(v)),
    )
    return F.array_max(longest)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases; labels also has those of notices covered
    to at least ``COVERED``; score is the best share of a template covered, 1 with any
    base phrase.  Only A-Z are lower-cased.  Null and wordless texts have no words, no
    labels (empty strings) and score 0; repeated rows and null doc_ids keep their rows;
    an empty table gives an empty one; further columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text").cast("string")).alias("w"))
    # the documents are read once: each row's own facts travel as one more pair, of no words
    none = F.array(F.struct(F.lit("").alias("u"), F.lit("").alias("v")))
    zipped = F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("u"), F.slice("w", 2, F.size("w")).alias("v"))
    pairs = rows.select("row_key", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode(F.concat(none, zipped)).alias("p", "x"))
    # lower() also folds some letters into ASCII ones; the words are compared below by A-Z alone
    pairs = pairs.withColumn("h", F.xxhash64(F.lower("x.u"), F.lower("x.v")))
    # a fixed table of some 100 short rows
    hits = pairs.join(F.broadcast(templates(docs.sparkSession)), "h")
    ascii_lower = lambda c: F.translate(c, UPPER, UPPER.lower())
    hits = hits.where((ascii_lower(F.col("x.u")) == F.col("u")) & (ascii_lower(F.col("x.v")) == F.col("v")))
    hits = hits.select("row_key", "t", "base", "label", "pairs", "q", (F.col("p") - 1 - F.col("q")).alias("diagonal"), *(F.when(F.col("t") < 0, F.col(c)).alias(c) for c in ("doc_id", "n_words")))
    # one shuffle, by row, serves all that follows
    diagonals = hits.repartition("row_key").groupBy("row_key", "t", "base", "label", "pairs", "diagonal").agg(F.expr("bit_or(shiftleft(1L, q))").alias("covered"), F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"))
    behind = Window.partitionBy("row_key", "t").orderBy("diagonal").rangeBetween(0, DRIFT)
    # a base phrase stands on one diagonal, a notice on neighbouring ones; what lies on one is in order
    near = diagonals.withColumn("near", F.when(~F.col("base") & (F.col("t") >= 0), F.collect_list(F.struct("diagonal", "covered")).over(behind)))
    alone = F.coalesce(F.size("near"), F.lit(1)) <= 1
    n = F.when(alone, F.bit_count("covered")).otherwise(_in_order(F.col("near"), F.col("pairs")))
    spans = near.select("row_key", "t", "base", "label", "pairs", "doc_id", "n_words", n.alias("n"), F.col("diagonal").cast("long").alias("at"))
    whole = F.col("base") & (F.col("n") == F.col("pairs"))
    noted = ~F.col("base") & (F.col("t") >= 0)
    found = spans.groupBy("row_key").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.count(F.when(whole, 1)).alias("n_base"),
        F.min(F.when(whole, F.col("at"))).alias("first_word"),
        F.max(F.when(whole, F.col("at"))).alias("last_word"),
        F.collect_set(F.when(whole, F.col("label"))).alias("base_set"),
        F.collect_set(F.when(noted & (F.col("n") >= COVERED * F.col("pairs")), F.col("label"))).alias("own_set"),
        F.max(F.when(noted, F.col("n") / F.col("pairs"))).alias("best"),
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base_set"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_set", "own_set")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


@functools.cache
def oracle() -> str:
    """DuckDB SQL for scan() over documents."""

    def values() -> str:
        out = []
        for t, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
            words = text.split()
            out += [f"({t}, {str(t < len(PHRASES)).lower()}, '{label}', {len(words) - 1}, {q}, '{u}', '{v}')" for q, (u, v) in enumerate(zip(words, words[1:], strict=False))]
        return ", ".join(out)

    return rf"""
    with recursive tpl(t, base, label, pairs, q, u, v) as (values {values()}),
    w as (select doc_id, row_number() over () as rk, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
    p as (select rk, unnest(range(1, len(w))) as i, w from w where len(w) > 1),
    pairs as (select rk, i - 1 as p, w[i] as u, w[i + 1] as v from p),
    hit as materialized (select distinct rk, t, base, label, pairs, p - q as d, q from pairs join tpl using (u, v)),
    diag as (select rk, t, base, label, pairs, d, count(distinct q) as n from hit group by all),
    b as (select rk, count(*) as n_base, min(d) as first_word, max(d) as last_word, list(distinct label) as base_set from diag where base and n = pairs group by rk),
    notes as materialized (select rk, t, label, pairs, d + q as p, q from hit where not base),
    lows as (select distinct rk, t, p - q as low from notes),
    chain(rk, t, low, p, q, n) as (select rk, t, low, p, q, 1 from lows join notes using (rk, t) where p - q between low and low + {DRIFT}
      union select c.rk, c.t, low, x.p, x.q, n + 1 from chain c join notes x on x.rk = c.rk and x.t = c.t and x.p > c.p and x.q > c.q and x.p - x.q between low and low + {DRIFT}),
    c as (select rk, t, max(n) as n from chain group by all),
    o as (select rk, max(n / pairs) as best, list(distinct label) filter (where n >= {COVERED} * pairs) as own_set from c join (select distinct t, label, pairs from tpl) using (t) group by rk)
    select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
      array_to_string(list_sort(coalesce(base_set, [])), ',') as base_labels,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(base_set, []), coalesce(own_set, [])))), ',') as labels,
      case when len(coalesce(base_set, [])) > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
    from w left join b using (rk) left join o using (rk)
    """
