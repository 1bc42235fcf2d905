"""Quality rules by weak supervision (DataFrame functions only).

Rules read counts of a whole text and vote for it (1), against it (-1) or abstain (0). How often each
rule votes right on good and on bad texts is not known; expectation-maximisation over the counts of
vote patterns (3 ** rules rows at most, however many documents) estimates it, and a document's
posterior probability of being good decides, in place of all rules having to pass.

Defined results: null or wordless texts have zero counts, and only `any_word` votes (against);
ties of the posterior at the threshold are kept; repeated rows are judged alike; a very long text is
read whole, its counts grow with it; an empty table gives an empty table; other columns are carried along
untouched where asked for, under their own names even where these are those of a count or of `posterior`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survista.llm.common import WORD, materialize

WINDOW = 5
ROUNDS = 20
THRESHOLD = 0.5
#: Chance of a right vote and share of good documents that the estimation starts from.
START, PRIOR = 0.8, 0.8

#: name: (when it votes against, when it votes for), over the counts below.
RULES = {
    "any_word": ("n_words = 0", "n_words >= 50"),
    "symbols": ("n_symbols * 100 > 10 * n_words", "n_words > 0 AND n_symbols * 100 <= n_words"),
    "dup_lines": ("n_dup_lines * 100 > 30 * n_lines", "n_lines >= 2 AND n_dup_lines = 0"),
    "repeats": ("n_repeat_words * 100 > 20 * n_words", "n_words >= 20 AND n_repeat_words * 100 <= 5 * n_words"),
    "capitals": ("n_capitals * 100 > 20 * n_words", "n_words >= 20 AND n_capitals * 100 <= n_words"),
    # distinct words grow with about the root of a text's length
    "variety": ("n_words >= 20 AND n_distinct * n_distinct < 2 * n_words", "n_words >= 20 AND n_distinct * n_distinct >= 8 * n_words"),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_distinct"]


def counts(docs: DataFrame) -> DataFrame:
    """docs with the columns COUNTS added. Each text is split once; nothing is exploded or shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    d = d.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
    word = lambda i, k: F.get(F.col("_words"), i + k)
    starts = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[word(i, k) for k in range(WINDOW)]))
    d = d.withColumn("_hashes", F.when(F.size("_words") > WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    return d.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_capitals": F.regexp_count(text, F.lit(r"(?<!\p{L})\p{Lu}{3,}(?!\p{L})")).cast("long"),
            "n_distinct": F.size(F.array_distinct("_words")).cast("long"),
            "n_repeat_words": F.when(F.size("_hashes") == F.size(F.array_distinct("_hashes")), F.lit(0)).otherwise(_covered()).cast("long"),
        }
    ).drop("_words", "_lines", "_hashes")


def _covered() -> Column:
    """Words under windows that occur twice or more: sort windows by hash, keep those with an equal
    neighbour, and add up how far each reaches beyond the one before it."""
    nested = """
      transform(array(array_sort(transform(_hashes, (h, i) -> named_struct('h', h, 'i', i)))), s ->
        transform(array(array_sort(transform(
            filter(s, (x, i) -> coalesce(get(s, i - 1).h = x.h, false) OR coalesce(get(s, i + 1).h = x.h, false)), x -> x.i))), p ->
          aggregate(transform(p, (x, i) -> least({w}, coalesce(get(p, i + 1) - x, {w}))), 0, (a, x) -> a + x))[0])[0]
    """
    return F.expr(nested.format(w=WINDOW))


def votes(counted: DataFrame) -> DataFrame:
    return counted.withColumns({f"v_{name}": F.expr(f"CASE WHEN {no} THEN -1 WHEN {yes} THEN 1 ELSE 0 END") for name, (no, yes) in RULES.items()})


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents and each rule's chances of voting right on good and on bad ones.

    patterns: distinct vote patterns with their counts. Add-one smoothing keeps chances off 0 and 1.
    """
    width = len(RULES)
    prior, right = PRIOR, [(START, START)] * width
    for _ in range(rounds):
        good_n = bad_n = 1.0
        good, bad = [[1.0, 2.0] for _ in range(width)], [[1.0, 2.0] for _ in range(width)]
        for vote, n in patterns:
            p = posterior_of(vote, prior, right)
            good_n += n * p
            bad_n += n * (1 - p)
            for j, v in enumerate(vote):
                if v:
                    good[j][1] += n * p
                    bad[j][1] += n * (1 - p)
                    good[j][0] += n * p * (v > 0)
                    bad[j][0] += n * (1 - p) * (v < 0)
        prior = good_n / (good_n + bad_n)
        right = [(g[0] / g[1], b[0] / b[1]) for g, b in zip(good, bad, strict=True)]
    return prior, right


def weights_of(prior: float, right: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds: of the prior, and what a vote against and a vote for add."""
    return math.log(prior / (1 - prior)), [(math.log((1 - g) / b), math.log(g / (1 - b))) for g, b in right]


def posterior_of(vote: tuple[int, ...], prior: float, right: list[tuple[float, float]]) -> float:
    base, weight = weights_of(prior, right)
    odds = base + sum(w[v > 0] for v, w in zip(vote, weight, strict=True) if v)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def posterior(voted: DataFrame, prior: float, right: list[tuple[float, float]]) -> Column:
    base, weight = weights_of(prior, right)
    odds = F.lit(base)
    for name, (no, yes) in zip(RULES, weight, strict=True):
        odds = odds + F.when(F.col(f"v_{name}") > 0, F.lit(yes)).when(F.col(f"v_{name}") < 0, F.lit(no)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-700.0)), F.lit(700.0))))


def judge(docs: DataFrame, rounds: int = ROUNDS, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (doc_id by default) with COUNTS, votes v_<rule> and `posterior`.

    The counts are written to the shared scratch folder once, since both the estimation and the
    verdicts read them; texts are read once.
    """
    keep = keep or ["doc_id"]
    clear = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"))
    counted = materialize(counts(clear).drop("text").select("_kept", *COUNTS), "quality-counts")
    voted = votes(counted)
    # 3 ** rules patterns at most
    found = voted.groupBy(*[f"v_{n}" for n in RULES]).count().orderBy(*[f"v_{n}" for n in RULES]).collect()
    prior, right = estimate([(tuple(r[:-1]), r[-1]) for r in found], rounds)
    return voted.withColumn("posterior", posterior(voted, prior, right)).select("_kept.*", *COUNTS, *[f"v_{n}" for n in RULES], "posterior")


def good_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a posterior of at least `threshold`, all columns as they were."""
    mine = [f"_c{i}" for i in range(len(docs.columns))]
    # names first: a column of docs may be called as one of the judgement
    judged = judge(docs, keep=docs.columns).toDF(*mine, *[f"_n_{c}" for c in COUNTS], *[f"_v_{n}" for n in RULES], "_posterior")
    return judged.where(F.col("_posterior") >= threshold).select(*[F.col(m).alias(c) for m, c in zip(mine, docs.columns, strict=True)])


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    j = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return j.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("posterior") >= THRESHOLD)).alias("kept"),
    )


def oracle(rounds: int = ROUNDS) -> str:
    v = [f"v_{n}" for n in RULES]
    cases = ",\n".join(f"CASE WHEN {no} THEN -1 WHEN {yes} THEN 1 ELSE 0 END AS v_{n}" for n, (no, yes) in RULES.items())
    odds = "ln(prior / (1 - prior)) + " + " + ".join(f"CASE WHEN {c} > 0 THEN ln(g_{c} / (1 - b_{c})) WHEN {c} < 0 THEN ln((1 - g_{c}) / b_{c}) ELSE 0 END" for c in v)
    chance = f"1 / (1 + exp(-greatest(-700, least(700, {odds}))))"
    steps = "m0 AS (SELECT " + f"{PRIOR}::DOUBLE AS prior, " + ", ".join(f"{START}::DOUBLE AS g_{c}, {START}::DOUBLE AS b_{c}" for c in v) + ")"
    for i in range(rounds):
        sums = ", ".join(
            f"(1 + sum(n * p) FILTER ({c} > 0)) / (2 + sum(n * p) FILTER ({c} <> 0)) AS g_{c}, (1 + sum(n * (1 - p)) FILTER ({c} < 0)) / (2 + sum(n * (1 - p)) FILTER ({c} <> 0)) AS b_{c}"
            for c in v
        )
        sums = sums.replace("sum(", "zsum(")
        steps += f",\ne{i} AS MATERIALIZED (SELECT patterns.*, {chance} AS p FROM patterns, m{i}),\nm{i + 1} AS MATERIALIZED (SELECT (1 + zsum(n * p)) / (2 + zsum(n)) AS prior, {sums} FROM e{i})"
    import re

    steps = re.sub(r"zsum\(((?:[^()]|\([^()]*\))*)\)( FILTER \(([^()]*)\))?", lambda m: f"coalesce(sum({m[1]}){f' FILTER (WHERE {m[3]})' if m[3] else ''}, 0)", steps)
    return f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_no,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT row_no, i, w[i:i + {WINDOW - 1}] AS g FROM (SELECT row_no, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split WHERE len(w) > {WINDOW})),
twice AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT row_no, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n_repeat_words
  FROM (SELECT row_no, i, lead(i) OVER (PARTITION BY row_no ORDER BY i) AS nxt FROM twice) GROUP BY row_no),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(regexp_extract_all(text, '\\p{{L}}+'), lambda x: regexp_full_match(x, '\\p{{Lu}}{{3,}}')))::BIGINT AS n_capitals,
         len(list_distinct(w))::BIGINT AS n_distinct
  FROM split LEFT JOIN covered USING (row_no)),
voted AS (SELECT *, {cases} FROM counts),
patterns AS MATERIALIZED (SELECT {", ".join(v)}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL),
{steps},
judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {chance} AS posterior
  FROM voted, m{rounds})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= {THRESHOLD} AS kept FROM judged
"""
