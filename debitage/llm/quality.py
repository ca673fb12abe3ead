"""Quality rules under weak supervision, in DataFrame and SQL functions only.

Each rule looks at a document's counts and votes good (1), bad (-1) or abstains (0).
No label is read: a document's votes are one of at most ``3 ** len(RULES)`` patterns, the
patterns are counted over all documents, and expectation-maximisation on that small
table estimates how each rule votes on good and on bad documents.  The posterior
probability of good quality under those estimates takes the place of a filter that
every rule must pass.  The counts of a text are made from its own row alone, so no text
is shuffled and no group of rows can grow hot.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debitage.iterate import materialise

#: Rules: when they vote bad and, else, good; SQL over the counts below, the same for Spark and DuckDB.
RULES = {
    "symbols": ("n_symbols > 0.2 * n_words", "n_symbols < 0.05 * n_words"),
    "dup_lines": ("n_dup_lines > 0.25 * n_lines", "n_lines >= 3 and n_dup_lines < 0.1 * n_lines"),
    "repeats": ("n_repeat_words > 0.25 * n_words", "n_words >= 20 and n_repeat_words < 0.1 * n_words"),
    "variety": ("n_words <= 2000 and n_unique < 0.3 * n_words", "n_unique > 0.5 * n_words"),
    "capitals": ("n_capitals > 0.3 * n_letters", "n_capitals < 0.15 * n_letters"),
    "letters": ("n_letters < 0.8 * word_chars", "n_letters > 0.9 * word_chars"),
    "wordless": ("n_wordless > 0.2 * n_words", "n_wordless < 0.05 * n_words"),
    "line_ends": ("n_ended < 0.3 * n_lines", "n_ended > 0.7 * n_lines"),
    "word_length": ("word_chars > 10 * n_words or word_chars < 3 * n_words", "word_chars < 7 * n_words and word_chars > 3.5 * n_words"),
    "shouting": ("n_shouts > 0.3 * n_words", "n_shouts < 0.05 * n_words"),
}
#: Belief in good quality before the first round: of no bad vote, of one, of more.
START = (0.95, 0.5, 0.05)
ROUNDS = 25
#: Votes that each rule has of each kind before any is counted, and the least chance of any vote: no rule is trusted beyond it.
PRIOR = 1.0
LEAST = 0.01
KEEP = 0.5
#: Repeated windows of a text that are looked for one by one; more are found by sorting.
FEW = 16
#: The limits of the base verdict, and the characters of its counts.
BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ENDS = ".!?:;\"'”»)…"
#: ASCII characters that are no letters, digits or white space.
MARKS = r"[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words() -> Column:
    """Words inside three-word windows (h: their 64-bit hashes) that the text has more than once.

    Texts whose hashes all differ have none.  Of the others, a few repeated hashes are
    looked for one by one, many are found by sorting the windows; what the repeated
    windows cover is summed over the gaps from each to the next.
    """
    # one-element arrays hand a value to a lambda, so each is made once
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    found = once(F.sort_array("h"), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))

    def few(again: Column) -> Column:
        return F.array_compact(F.transform("h", lambda x, i: F.when(F.array_contains(again, x), i)))

    def many(s: Column) -> Column:
        own = F.filter(s, lambda x, i: (x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h))
        return F.sort_array(F.transform(own, lambda x: x.p))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    by_sort = once(F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))), many)
    starts = once(found, lambda again: F.when(F.size(again) <= FEW, few(again)).otherwise(by_sort))
    return F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0)).otherwise(once(starts, covered))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text, all of type long."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spaced = text
    for c in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    words = lambda c: F.array_remove(F.split(c, " "), "")
    bare = lambda x: F.rtrim(x, F.lit(SPACES))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), spaced.alias("spaced"))
    cut = cut.select(
        "doc_id",
        words("spaced").alias("w"),
        words(F.regexp_replace("spaced", MARKS, "")).alias("unmarked"),
        F.filter(F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), bare(x).alias("bare"))), lambda x: x.bare != "").alias("lines"),
    )
    cut = cut.select(
        "*",
        F.array_join("w", "").alias("joined"),
        F.array_join("unmarked", "").alias("letters"),
        F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2))), 1, F.greatest(F.size("w") - 2, F.lit(0))).alias("h"),
    )
    long = lambda c: c.cast("long")
    return cut.select(
        "doc_id",
        long(F.size("w")).alias("n_words"),
        long(F.length("joined")).alias("word_chars"),
        long(F.length("joined") - F.length(_without(F.col("joined"), SYMBOLS))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct(F.col("lines.line")))).alias("n_dup_lines"),
        long(_repeat_words()).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size(F.array_distinct("w"))).alias("n_unique"),
        long(F.length("letters") - F.length(F.regexp_replace("letters", "[A-Z]+", ""))).alias("n_capitals"),
        # letters are ASCII letters and digits and all that is not ASCII
        long(F.length("letters")).alias("n_letters"),
        long(F.size("w") - F.size("unmarked")).alias("n_wordless"),
        long(F.size(F.filter(F.col("lines.bare"), lambda x: F.right(x, F.lit(1)).isin(*ENDS)))).alias("n_ended"),
        long(F.length("joined") - F.length(F.replace("joined", F.lit("!"), F.lit("")))).alias("n_shouts"),
    )


def votes(counts: DataFrame, rules: Mapping[str, tuple[str, str]] = RULES) -> DataFrame:
    """counts with a column ``votes``: -1, 0 or 1 for each rule; texts without words get no vote."""
    some = F.col("n_words") > 0
    return counts.withColumn("votes", F.array(*(F.when(~some, 0).when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for bad, good in rules.values())))


def _posterior(weights: list[float], bias: float) -> Column:
    """Chance of good quality, from log odds of each rule's votes bad, none and good."""
    odds = F.array(*map(F.lit, weights))
    total = F.aggregate(F.transform("votes", lambda v, i: F.get(odds, 3 * i + v + 1)), F.lit(0.0), lambda x, y: x + y)
    return 1 / (1 + F.exp(-(total + bias)))


def accuracies(voted: DataFrame, n_rules: int = len(RULES)) -> tuple[list[float], float]:
    """Log odds that each rule's vote (three numbers a rule: bad, none, good) speaks for good quality, and those of any document.

    Expectation-maximisation over the counted vote patterns: a table of at most
    ``3 ** n_rules`` rows that each round reads once, for three sums a rule.  A vote never
    speaks against what it says.
    """
    patterns = materialise(voted.where("n_words > 0").groupBy("votes").agg(F.count("*").alias("many")).coalesce(1))
    bad = F.size(F.filter("votes", lambda v: v == -1))
    belief = F.when(bad == 0, START[0]).when(bad == 1, START[1]).otherwise(START[2])
    chance = lambda own, of: max(LEAST, (own + PRIOR) / (of + 3 * PRIOR))
    weights, bias = [0.0] * (3 * n_rules), 0.0
    for _ in range(ROUNDS):
        cast = patterns.withColumn("good", F.col("many") * belief).select("many", "good", F.posexplode("votes").alias("rule", "vote"))
        sums = {(r["rule"], r["vote"]): (r["many"], r["good"]) for r in cast.groupBy("rule", "vote").agg(F.sum("many").alias("many"), F.sum("good").alias("good")).collect()}
        if not sums:
            break
        n, yes = (sum(s[k] for (rule, _), s in sums.items() if rule == 0) for k in (0, 1))
        for rule in range(n_rules):
            for vote in (-1, 0, 1):
                own, good = sums.get((rule, vote), (0, 0.0))
                odds = math.log(chance(good, yes) / chance(own - good, n - yes))
                weights[3 * rule + vote + 1] = min(odds, 0.0) if vote < 0 else max(odds, 0.0) if vote > 0 else odds
        bias = math.log((yes + PRIOR) / (n - yes + PRIOR))
        belief = _posterior(weights, bias)
    return weights, bias


def judge(docs: DataFrame, rules: Mapping[str, tuple[str, str]] = RULES, keep: float = KEEP) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score of every row of docs (doc_id, text).

    score is the posterior probability of good quality, to six digits; a document is kept with at least
    ``keep`` of it, unless the base verdict fails it.  Null, empty and wordless texts
    have counts of 0, fail the base verdict and get the share of good documents as
    score; repeated rows and null doc_ids keep their rows and count each; an empty table gives
    an empty one; further columns are ignored.
    """
    voted = materialise(votes(counted(docs), rules))  # one row of numbers a document: texts are read once
    weights, bias = accuracies(voted, len(rules))
    score = F.when(F.col("n_words") > 0, _posterior(weights, bias)).otherwise(1 / (1 + math.exp(-bias)))
    failed = F.expr(BASE)
    out = voted.withColumn("score", F.round(score, 6)).withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("score") >= keep)).alias("kept"), "score")


def oracle() -> str:
    """DuckDB SQL for judge() over documents; each round of the estimates is a table."""
    names = list(RULES)
    blank = r"[\x20\x09-\x0D]"
    sql = rf"""
    with d as (select doc_id, row_number() over () as rk, coalesce(text, '') as t from documents),
    c as (select doc_id, rk, t, list_filter(string_split_regex(t, '{blank}+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
    win as materialized (select rk, i, w[i : i + 2] as s from (select rk, w, unnest(range(1, len(w) - 1)) as i from c)),
    rep as materialized (select rk, count(distinct p) as n from (select rk, unnest([i, i + 1, i + 2]) as p from (select rk, i, count(*) over (partition by rk, s) as k from win) where k > 1) group by rk),
    n as materialized (select doc_id, rk, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
      len(l) as n_lines, len(list_distinct(w)) as n_unique, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_capitals,
      length(regexp_replace(t, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) as n_letters,
      len(list_filter(w, lambda x: not regexp_matches(x, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]'))) as n_wordless,
      len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;"''\x{{201D}}\x{{BB}})\x{{2026}}]{blank}*$'))) as n_ended, length(t) - length(replace(t, '!', '')) as n_shouts
      from c left join rep using (rk)),
    v as materialized (select *, {", ".join(f"case when n_words = 0 then 0 when {bad} then -1 when {good} then 1 else 0 end as vote_{r}" for r, (bad, good) in RULES.items())} from n),
    pat as materialized (select row_number() over () as k, * from (select {", ".join(f"vote_{r}" for r in names)}, count(*)::double as many from v where n_words > 0 group by all)),
    cast_ as materialized ({" union all ".join(f"select k, '{r}' as r, vote_{r} as vote, many from pat" for r in names)}),
    kinds as materialized (select r, vote from (select unnest({names!r}) as r) cross join (select unnest([-1, 0, 1]) as vote)),
    b0 as materialized (select k, case when m = 0 then {START[0]} when m = 1 then {START[1]} else {START[2]} end as belief from (select k, count(*) filter (where vote = -1) as m from cast_ group by k)),
    """
    for i in range(1, ROUNDS + 1):
        sql += f"""
    t{i} as materialized (select sum(many) as n, sum(many * belief) as yes from pat join b{i - 1} using (k)),
    o{i} as materialized (select r, vote, case when vote < 0 then least(odds, 0) when vote > 0 then greatest(odds, 0) else odds end as w from (
      select r, vote, ln(greatest({LEAST}, (coalesce(got, 0) + {PRIOR}) / (yes + 3 * {PRIOR})) / greatest({LEAST}, (coalesce(own, 0) - coalesce(got, 0) + {PRIOR}) / (n - yes + 3 * {PRIOR}))) as odds
      from kinds left join (select r, vote, sum(many) as own, sum(many * belief) as got from cast_ join b{i - 1} using (k) group by all) using (r, vote) cross join t{i})),
    b{i} as materialized (select k, 1 / (1 + exp(-(sum(w) + any_value(ln((yes + {PRIOR}) / (n - yes + {PRIOR})))))) as belief from cast_ join o{i} using (r, vote) cross join t{i} group by k),"""
    return (
        sql
        + f"""
    s as (select v.*, {BASE} as base_failed, round(case when n_words > 0 then belief else (yes + {PRIOR}) / (n + 2 * {PRIOR}) end, 6) as score
      from v left join pat on {" and ".join(f"v.vote_{r} = pat.vote_{r}" for r in names)} left join b{ROUNDS} using (k) cross join t{ROUNDS})
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and score >= {KEEP} as kept, score from s
    """
    )
