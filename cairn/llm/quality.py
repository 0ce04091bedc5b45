"""Quality rules by document, and verdicts on hosts from the rates at which their documents fail them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import cut, join_sized, load, version, words_of


@dataclass(frozen=True)
class QualityPolicy:
    """Thresholds. ``min_words`` and ``max_repeat_percent`` are the base rules; the others add to what counts as a
    failure of a document. ``host_limit``: a host whose shrunk failure rate is above goes with all its documents."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbol_percent: int = 20
    max_dup_line_percent: int = 50
    host_limit: float = 0.6
    window: int = 5


def measure(docs: DataFrame, keep: dict[str, Column], *, text: str = "text", window: int = 5) -> DataFrame:
    """Counts over the whole text of each row, without a shuffle, beside the columns ``keep`` by their new names.

    A null or empty text has no words and no lines. A window is ``window`` words in a row; the words of all windows
    that stand twice or more in the text count once each, the first occurrence included. Windows are compared by
    64-bit hashes within one text; only texts in which two hashes agree are sorted.
    """
    shingle = ", ".join(f"get(_w, i + {k})" for k in range(window))
    return (
        docs.select(*[c.alias(k) for k, c in keep.items()], F.coalesce(F.col(text), F.lit("")).alias("_t"), words_of(F.col(text)).alias("_w"))
        .selectExpr(
            "*",
            f"CASE WHEN size(_w) >= {window} THEN transform(sequence(0, size(_w) - {window}), i -> xxhash64({shingle})) ELSE array() END AS _h",
            r"filter(split(_t, '\n', -1), l -> l RLIKE '[^\\x20\\x09-\\x0D]') AS _l",
        )
        .selectExpr("*", "CASE WHEN size(array_distinct(_h)) < size(_h) THEN array_sort(transform(_h, (h, i) -> struct(h, i))) ELSE array() END AS _s")
        .selectExpr(
            "*",
            "array_sort(transform(filter(transform(_s, (x, k) -> struct(x.i AS i, x.h <=> get(_s, k - 1).h OR x.h <=> get(_s, k + 1).h AS twice)), x -> x.twice), x -> x.i)) AS _p",
        )
        .select(
            *keep,
            F.size("_w").cast("long").alias("_n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("_word_chars"),
            F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("_n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("_n_dup_lines"),
            F.size("_l").cast("long").alias("_n_lines"),
            F.expr(f"aggregate(transform(_p, (p, k) -> coalesce(least({window}, get(_p, k + 1) - p), {window})), 0L, (a, x) -> a + x)").alias("_n_repeat_words"),
        )
    )


def failures(policy: QualityPolicy) -> dict[str, Column]:
    """The rules on what ``measure`` counts; the first two are the base rules."""
    n = F.col("_n_words")
    return {
        "short": n < policy.min_words,
        "repeats": 100 * F.col("_n_repeat_words") > policy.max_repeat_percent * n,
        "symbols": 100 * F.col("_n_symbols") > policy.max_symbol_percent * n,
        "dup_lines": 100 * F.col("_n_dup_lines") > policy.max_dup_line_percent * F.col("_n_lines"),
    }


def host_verdicts(measured: DataFrame, host: str, policy: QualityPolicy) -> DataFrame:
    """One row per host (a null host is one too): documents, failures, the rate shrunk by an empirical beta prior,
    and whether the host is rejected. ``measured`` has the boolean column ``_failed``.

    The prior's mean is the failure rate of all documents, its weight the one that explains the spread of the hosts'
    rates beyond what chance gives (method of moments), between 2 and a million documents. Rates are summed up
    before the shuffle, so that a host with a third of all rows costs a row per task.
    """
    hosts = measured.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("_docs"), F.count_if("_failed").alias("_fails"))
    n, f = F.col("_docs"), F.col("_fails")
    total = hosts.agg(F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff")).first()
    docs = total["n"] or 0
    mean = total["f"] / docs if docs else 0.0
    spread = (total["ff"] / docs - mean * mean - mean * (1 - mean) * total["hosts"] / docs) if docs else 0.0
    weight = min(max(mean * (1 - mean) / spread - 1, 2.0), 1e6) if spread > 0 else 1e6
    rate = (f + F.lit(weight * mean)) / (n + F.lit(weight))
    return hosts.withColumn("_host_rate", rate).withColumn("_rejected", F.col("_host_rate") > policy.host_limit)


def judge(docs: DataFrame, policy: QualityPolicy = QualityPolicy(), *, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row of ``docs``: the counts of ``measure``, ``_base_failed``, ``_failed`` (any rule), the host's shrunk rate
    and ``_kept``. A document stays if it fails no rule and its host is not rejected.

    Null ids and hosts are values like others; repeated rows are judged alike and all returned; an empty table gives
    no rows; columns that are not named here are not read.
    """
    rules = failures(policy)
    measured = cut(
        measure(docs, {"_id": F.col(doc_id), "_v": version(F.col(text)), "_at": F.col(host)}, text=text, window=policy.window)
        .withColumn("_base_failed", rules["short"] | rules["repeats"])
        .withColumn("_failed", F.col("_base_failed") | rules["symbols"] | rules["dup_lines"])
    )
    hosts = cut(host_verdicts(measured, "_at", policy))
    joined = join_sized(measured, hosts, measured["_at"].eqNullSafe(hosts["_host"]), "left", _bytes(hosts))
    return joined.withColumn("_kept", ~F.col("_failed") & ~F.coalesce("_rejected", F.lit(False)))


def _bytes(hosts: DataFrame) -> int:
    return hosts.agg(F.sum(F.coalesce(F.octet_length("_host"), F.lit(0)) + 64)).first()[0] or 0


def filter_stage(docs: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns; repeated rows stay repeated. Texts are measured once and
    stay where they are: a row that fails goes at once, the others are written with their hosts, and only the hosts
    that are rejected are sent to them."""
    rules = failures(policy)
    measured = measure(docs, {"_row": F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "_at": F.col("source")}, window=policy.window)
    failed = reduce(Column.__or__, rules.values())
    measured = cut(measured.withColumn("_failed", failed).select("_at", "_failed", F.when(~F.col("_failed"), F.col("_row")).alias("_row")))
    rejected = cut(host_verdicts(measured, "_at", policy).filter("_rejected").select("_host"))
    kept = join_sized(measured.filter("NOT _failed"), rejected, measured["_at"].eqNullSafe(rejected["_host"]), "left_anti", _bytes(rejected))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(load(spark, sf_dir, "documents", "doc_id", "text", "source"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(F.col("_id").alias("doc_id"), *[F.col(f"_{n}").alias(n) for n in names])


SQL_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), c AS (
  SELECT doc_id, source, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM d
), x AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM c WHERE len(w) >= 5)
), r AS (
  SELECT doc_id, count(*) AS n_repeat_words FROM (
    SELECT DISTINCT doc_id, i + k AS at FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM x), range(5) AS g(k) WHERE n >= 2)
  GROUP BY 1
), f AS (
  SELECT doc_id, source, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM c LEFT JOIN r USING (doc_id)
), g AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines AS failed
  FROM f
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM g GROUP BY 1
), m AS (
  SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2 - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS spread FROM h
), p AS (
  SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 2.0), 1e6) ELSE 1e6 END AS weight FROM m
), v AS (
  SELECT source, (f + weight * mean) / (n + weight) > 0.6 AS rejected FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND NOT rejected AS kept
FROM g JOIN v ON g.source IS NOT DISTINCT FROM v.source
"""
