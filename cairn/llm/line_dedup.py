"""Lines that many documents share, dropped from all but one; the result is a bitmap per document, not text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import BLANKS, ascii_lower, cut, load, version


def lines_of(text: Column) -> Column:
    """All lines, empty ones too; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """For each document that loses lines: ``_id``, ``_v`` (which of the texts under that id), and ``_bitmap``, an array
    of ``struct<word int, keep bigint>``: bit k of word w tells whether line 64 * w + k stays. Words that would be all
    ones are left out, so a document that keeps nearly all is a few bytes, and one that keeps all has no row.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code points in
    at least ``min_docs`` different ids stay only in the largest id that holds them, there as often as they stand.
    Rows with one id count as one document; null texts are one empty line; rows with a null id hold no key of others.

    The keys' 128-bit hashes are dealt by range of (hash, document), sorted by hash, document, last first, and position, so
    that a line held by a third of all documents spans as many ranges as it needs. Windows stream over each range as it is
    sorted: the first document of a hash is where its lines stay, the others are numbered as they pass. Only the hashes at
    the ends of a range can go on in the next; their counts and first documents, two rows a range, are carried over.
    """
    key = F.col("_key")
    lines = (
        docs.select(F.col(doc_id).alias("_id"), version(F.col(text)).alias("_v"), F.posexplode(lines_of(F.col(text))).alias("_pos", "_line"))
        .filter(F.col("_id").isNotNull())
        .select("_id", "_v", "_pos", F.btrim("_line", F.lit(BLANKS)).alias("_line"))
        .filter(F.length("_line") >= min_chars)
        .select("_id", "_v", "_pos", ascii_lower(F.col("_line")).alias("_key"))
        .select("_id", "_v", "_pos", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(1), key).alias("_h2"))
    )
    lines = cut(lines)
    ranged = lines.repartitionByRange("_h1", "_h2", F.desc("_id")).withColumn("_range", F.spark_partition_id())
    # a range exchange does not tell the planner the number of a range; this one sends each row to the task of that number
    ranged = ranged.repartitionById(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_range").sortWithinPartitions("_range", "_h1", "_h2", F.desc("_id"), "_v", "_pos")
    whole, own = Window.partitionBy("_range"), Window.partitionBy("_range", "_h1", "_h2")
    passed, hash_ = own.orderBy(F.desc("_id")), F.struct("_h1", "_h2")
    streamed = cut(
        ranged.withColumn("_end", (hash_ == F.min(hash_).over(whole)) | (hash_ == F.max(hash_).over(whole)))
        .withColumn("_stays", F.first("_id").over(passed))
        .withColumn("_nth", F.dense_rank().over(passed))
        .withColumn("_n", F.max("_nth").over(own))
        .filter("_n > 1 OR _end")
        .drop("_nth")
    )
    ends = streamed.filter("_end").groupBy("_h1", "_h2", "_range").agg(F.max("_n").alias("_n"), F.max("_stays").alias("_stays"))
    carried = ends.groupBy("_h1", "_h2").agg(F.sum("_n").alias("_all"), F.max("_stays").alias("_first"), F.count("*").alias("_ranges")).filter("_ranges > 1").drop("_ranges")
    dropped = (
        streamed.join(F.broadcast(carried), ["_h1", "_h2"], "left")
        .filter((F.coalesce("_all", "_n") >= min_docs) & (F.col("_id") != F.coalesce("_first", "_stays")))
        .select("_id", "_v", F.expr("_pos div 64").cast("int").alias("word"), F.expr("shiftleft(1L, CAST(_pos % 64 AS INT))").alias("_bit"))
    )
    words = dropped.groupBy("_id", "_v", "word").agg(F.bitwise_not(F.bit_or("_bit")).alias("keep"))
    return words.groupBy("_id", "_v").agg(F.sort_array(F.collect_list(F.struct("word", "keep"))).alias("_bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``_cairn_n_lines``, ``_cairn_n_dropped`` and ``_cairn_kept``, the lines that stay joined by line feeds. The kept text
    of a document without a bitmap is its text, or empty for null. ``docs`` must not have columns of these three names."""
    names = docs.columns
    theirs = bitmaps.select(*[F.col(c).alias(f"_cairn{c}") for c in ("_id", "_v", "_bitmap")])
    joined = docs.join(theirs, docs[doc_id].eqNullSafe(theirs["_cairn_id"]) & (version(docs[text]) == theirs["_cairn_v"]), "left")
    gone = "flatten(transform(_cairn_bitmap, b -> transform(filter(sequence(0, 63), k -> (shiftrightunsigned(b.keep, k) & 1L) = 0L), k -> b.word * 64 + k)))"
    return (
        joined.withColumn("_cairn_lines", lines_of(F.col(text)))
        .withColumn("_cairn_gone", F.when(F.col("_cairn_bitmap").isNotNull(), F.expr(gone)))
        .select(
            *[F.col(f"`{n}`") for n in names],
            F.size("_cairn_lines").cast("long").alias("_cairn_n_lines"),
            F.coalesce(F.size("_cairn_gone"), F.lit(0)).cast("long").alias("_cairn_n_dropped"),
            F.when(F.col("_cairn_gone").isNull(), F.coalesce(F.col(text), F.lit("")))
            .otherwise(F.expr("array_join(transform(array_except(sequence(0, size(_cairn_lines) - 1), _cairn_gone), p -> _cairn_lines[p]), '\n')"))
            .alias("_cairn_kept"),
        )
    )


def dedup_stage(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that ``keep_bitmaps`` drops; ``n_chars`` follows the text. No document goes; a null
    text stays null."""
    done = apply_bitmaps(docs, keep_bitmaps(docs))
    kept = F.when(F.col("text").isNotNull(), F.col("_cairn_kept"))
    changed = {"text": kept, "n_chars": F.when(F.col("_cairn_n_dropped") > 0, F.length(kept).cast("long")).otherwise(F.col("n_chars"))}
    return done.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    done = apply_bitmaps(docs, keep_bitmaps(docs))
    return done.select("doc_id", F.col("_cairn_n_lines").alias("n_lines"), F.col("_cairn_n_dropped").alias("n_dropped"), F.sha2("_cairn_kept", 256).alias("kept_sha256"))


SQL_OP7 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, c.key IS NOT NULL AND doc_id <> stays AS gone FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY 1
"""
