"""Quality rules with verdicts on hosts; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_lake.llm.common import WORD, joined, materialise, table, unused

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5

#: A host goes if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5

#: Bounds of the prior's weight in documents, where the hosts' rates spread no more than chance or by all they can.
PRIOR_WEIGHT = (1.0, 10_000.0)


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row; plain repetition inside lambdas would compute it once an element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """The words that lie in WINDOW-word windows found twice or more, from an array of words.

    Windows are compared by a 64-bit hash of their words' hashes. Rows whose hashes are all different end there;
    the others sort (hash, place) and add up the union of the windows that stand beside an equal one."""

    def coverage(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            n = F.size(s)
            at = lambda k: F.get(s, k)
            twice = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(at(k)["h"] == at(k - 1)["h"], F.lit(False)) | F.coalesce(at(k)["h"] == at(k + 1)["h"], F.lit(False)))
            places = F.array_sort(F.transform(twice, lambda k: at(k)["i"]))
            # (end of what is covered, sum)
            step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["sum"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("sum"))
            return F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")), step, lambda acc: acc["sum"])

        return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)

    def of_hashes(one: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(one) - WINDOW), lambda i: F.xxhash64(*[F.get(one, i + j) for j in range(WINDOW)]))
        return let(windows, lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(coverage(hashes)))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed; these replace columns of the same names. Null text: no words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words, real = unused(docs, "words", "lines")
    out = docs.withColumns({words: F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), real: lines})
    out = out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": (F.length(whole) - F.regexp_count(whole, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(real) - F.size(F.array_distinct(real))).cast("long"),
        "n_repeat_words": repeated_words(F.col(words)).cast("long"),
    }).drop(words, real)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def host_verdicts(ruled: DataFrame, host: str = "_host", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """From (host, base_failed): the hosts whose shrunk failure rate is above max_rate, with n, failures and rate.

    The beta prior is fitted to all hosts by the method of moments: its mean is the corpus's failure rate, its weight
    says how much the hosts' rates spread beyond chance. Counts are summed before the shuffle; one row comes to the driver."""
    hosts = materialise(ruled.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures")), "hosts")
    n, k, f, squares = hosts.agg(F.sum("n"), F.count("*"), F.sum("failures"), F.sum(F.col("failures") * F.col("failures") / F.col("n"))).first()
    if not n:
        return hosts.withColumn("rate", F.lit(0.0)).where(F.lit(False))
    mean = f / n
    chance, spread = mean * (1 - mean), squares / n - mean * mean
    beyond = spread - chance * k / n
    weight = min(max((chance - spread) / beyond, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1]) if beyond > 0 else PRIOR_WEIGHT[1]
    rate = (F.col("failures") + mean * weight) / (F.col("n") + weight)
    return hosts.withColumn("rate", rate).where(F.col("rate") > max_rate)


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """docs with the base rules' columns and kept: false if base_failed or if the host's verdict is against it.

    Null host: a host of its own. Repeated rows count as often as they come. No rows: no rows.
    Columns of docs with the names of the new ones are replaced. The ruled rows are written once and read for both the
    counts and the verdicts' join, in which the verdicts' size is checked."""
    key, against = unused(docs, "host_key", "against")
    ruled = materialise(base_rules(docs.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))), text), "ruled")
    bad = host_verdicts(ruled, key, max_rate).select(key, F.lit(True).alias(against))
    return joined(ruled, bad, key).withColumn("kept", ~F.col("base_failed") & F.col(against).isNull()).drop(key, against)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
one AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
grams AS (
  SELECT r, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS gram
  FROM one WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) > 1 AS hit FROM grams WHERE gram IS NOT NULL),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(5) x(j) WHERE hit GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
  SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dups USING (r) LEFT JOIN covered USING (r)),
ruled AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM ruled GROUP BY source),
corpus AS (SELECT sum(f) / sum(n) AS mean, count(*) / sum(n) AS kn, sum(f * f / n) / sum(n) AS sq FROM hosts),
prior AS (
  SELECT mean, CASE WHEN sq - mean * mean - mean * (1 - mean) * kn > 0
    THEN least(greatest((mean * (1 - mean) - (sq - mean * mean)) / (sq - mean * mean - mean * (1 - mean) * kn), 1), 10000) ELSE 10000 END AS weight FROM corpus),
bad AS (SELECT source FROM hosts, prior WHERE (f + mean * weight) / (n + weight) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM ruled.source) AS kept
FROM ruled
"""
