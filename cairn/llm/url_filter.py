"""Host rules for URLs, and a logistic regression on hashed character n-grams for those that no rule fits."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import LOWER, UPPER, load
from cairn.llm.url_labels import LABELLED

#: Buckets for n-grams, their length, and the most labelled rows that ``train`` takes: training is on the driver.
BUCKETS, GRAM, MAX_LABELLED = 4096, 3, 10_000

#: The rules, as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased: after the first ``://`` up to ``/``, ``?``, ``#`` or the end. The path: then up to ``?``,
    ``#`` or the end. Both are empty for null and where there is no ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


@dataclass(frozen=True)
class Model:
    """Weights by bucket and a bias; their sum over a URL's n-grams, divided by the number of n-grams, is the log odds
    that it is to be blocked."""

    weights: tuple[float, ...]
    bias: float
    gram: int = GRAM


def buckets_of(text: str, gram: int = GRAM, buckets: int = BUCKETS) -> list[int]:
    """The buckets of the n-grams of ``^text$``: code points as digits to the base 257, modulo the buckets."""
    marked = f"^{text}$"
    grams = [marked[i : i + gram] for i in range(max(1, len(marked) - gram + 1))]
    return [sum(ord(c) * 257**k for k, c in enumerate(reversed(g))) % buckets for g in grams]


def labels() -> list[tuple[str, int]]:
    return [(url, int(label == "block")) for label, _, url in (line.partition(" ") for line in LABELLED.strip().splitlines())]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The table at hand: (url, blocked), blocked 1 or 0."""
    return spark.createDataFrame(labels(), "url string, blocked int")


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Batch gradient descent on host and path of the labelled table's urls (url, blocked). The table is small by contract: more
    than ``max_labelled`` rows are refused; rows without a label, or with another than 0 and 1, are passed over; a null url
    is empty, repeated ones count as often; an empty table gives a model that allows all."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter(F.col("blocked").isin(0, 1)).select(F.concat(host, path).alias("text"), F.col("blocked").cast("int").alias("blocked")).take(max_labelled + 1)
    if len(rows) > max_labelled:
        raise ValueError(f"more than the {max_labelled} labelled URLs that are taken")
    return fit([(r["text"], r["blocked"]) for r in rows])


def fit(labelled: list[tuple[str, int]], *, epochs: int = 300, rate: float = 500.0, decay: float = 1e-3) -> Model:
    if not labelled:
        return Model((0.0,) * BUCKETS, -1.0)
    rows = [(buckets_of(text), label) for text, label in sorted(labelled)]
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(epochs):
        step, shift = dict.fromkeys({b for bs, _ in rows for b in bs}, 0.0), 0.0
        for bs, label in rows:
            miss = label - 1 / (1 + math.exp(-bias - sum(w[b] for b in bs) / len(bs)))
            shift += miss
            for b in bs:
                step[b] += miss / len(bs)
        bias += shift / len(rows)
        for b, x in step.items():
            w[b] += rate * x / len(rows) - decay * w[b]
    return Model(tuple(round(x, 6) for x in w), round(bias, 6))


def _plain(url: str) -> str:
    """Host and path, as ``host_and_path`` has them."""
    rest = url.partition("://")[2]
    cut = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.lower() + slash + path


def own_model() -> Model:
    """The model of the table at hand, without a session."""
    return fit([(_plain(url), label) for url, label in labels()])


def log_odds(text: Column, model: Model) -> Column:
    """The model's log odds for a text, by SQL functions only and without columns of its own; the weights are a literal of
    fixed size."""
    n, buckets = model.gram, len(model.weights)
    weights = F.from_json(F.lit(f"[{','.join(map(repr, model.weights))}]"), "array<double>")

    def of(codes: Column) -> Column:
        digit = lambda i, k: F.coalesce(F.get(codes, i + k), F.lit(0).cast("long")) * F.lit(257 ** (n - 1 - k)).cast("long")
        at = F.transform(F.sequence(F.lit(0), F.greatest(F.size(codes) - n, F.lit(0))), lambda i: (sum((digit(i, k) for k in range(1, n)), digit(i, 0)) % buckets).cast("int"))
        return F.transform(F.array(at), lambda b: F.aggregate(b, F.lit(0.0), lambda s, x: s + F.get(weights, x)) / F.size(b))[0]

    points = F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: F.ascii(c).cast("long"))
    return F.transform(F.array(points), of)[0] + F.lit(model.bias)


def judge_urls(pages: DataFrame, *, rules: tuple = RULES, model: Model | None = None, url: str = "url") -> DataFrame:
    """``pages`` with one more column, ``_cairn``: struct<host, path, rule, verdict>; a table that has it already is refused, all
    other columns stay as they are. A rule fits its host and all subdomains where the path starts with the rule's; the
    longest that fits wins (of equals, a block). Without a rule the model blocks at log odds above zero. A null url has
    empty host and path, fits no rule and goes to the model as an empty text; very long ones are judged whole; repeated
    rows are judged each; an empty table gives no rows."""
    if "_cairn" in pages.columns:
        raise ValueError("the table has a column _cairn already")
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    placed = pages.withColumn("_cairn", F.struct(*[c.alias(n) for c, n in zip(host_and_path(F.col(url)), ("host", "path"), strict=True)]))
    host, path = F.col("_cairn.host"), F.col("_cairn.path")
    rule, verdict = F.lit(None).cast("string"), F.when(log_odds(F.concat(host, path), model or own_model()) > 0, "block").otherwise("allow")
    for kind, h, p in reversed(ranked):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return placed.withColumn("_cairn", F.struct(host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(load(spark, sf_dir, "pages", "page_id", "url"), model=train(labelled_urls(spark)))
    return judged.select("page_id", "_cairn.host", "_cairn.path", "_cairn.rule", "_cairn.verdict")


def sql_op8() -> str:
    model = own_model()
    when = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{kind}}}{h + p}'" for kind, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    return rf"""
WITH u AS (
  SELECT page_id, coalesce(substr(url, nullif(instr(url, '://'), 0) + 3), '') AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE {when} END AS hit, list_transform(string_split('^' || host || path || '$', ''), lambda c: unicode(c)::BIGINT) AS c FROM p
), b AS (
  SELECT *, list_transform(range(1, greatest(len(c) - 1, 2)), lambda i: (c[i] * 66049 + coalesce(c[i + 1], 0) * 257 + coalesce(c[i + 2], 0)) % {len(model.weights)}) AS b FROM r
), w AS (SELECT {list(model.weights)}::DOUBLE[] AS w)
SELECT page_id, host, path, regexp_replace(hit, '^\{{\w+\}}', '') AS rule,
  coalesce(regexp_extract(hit, '^\{{(\w+)\}}', 1), CASE WHEN list_sum(list_transform(b, lambda k: w[k + 1])) / len(b) + {model.bias!r} > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM b, w
"""
