"""Line deduplication by a suffix array over line ids, built by distributed prefix doubling; DataFrame functions only.

Lines that occur once can't be in a repeated run and only break runs. The others get ranks in the order of their MD5;
each round ranks the pairs (rank here, rank 2^k lines on), so after it a rank names 2^k lines, and ranks order the
suffixes by their first 2^k lines. Suffixes with equal ranks form an interval of common prefixes of that many lines; an
interval of any length between is named by two overlapping ranks. A run is long enough to be deleted if it has
``min_words`` words; whether a line lies in such a run that also occurs earlier is decided by the shortest runs with
that many words that begin or end at a line, so rounds end once a rank names as many lines as the longest of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohera.llm.registry import query, table
from cohera.llm.shared import Stored, content_key

MIN_WORDS = 50


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line that has a word: document key (id, content), line number in the text, MD5 of the line, words.

    Words are what spaces and tabs part. Lines without a word take no part and are never deleted. Rows with the same id
    and text are one document, whose lines are deleted alike.
    """
    line = F.rtrim(F.col("line"), F.lit("\r"))
    lines = docs.select(F.col(id_col).alias("id"), content_key(F.col(text_col)).alias("content"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("no", "line"))
    return lines.select("id", "content", "no", F.unhex(F.md5(line.cast("binary"))).alias("hash"), F.regexp_count(line, F.lit("[^ \t]+")).cast("long").alias("words")).where("words > 0")


def runs_to_judge(lines: DataFrame, min_words: int) -> DataFrame:
    """``lines`` with the place ``at`` among the document's lines with words, and per line the number of lines of the
    shortest run with ``min_words`` words that starts (``ahead``) and that ends (``back``) here; null if there is none."""
    doc = Window.partitionBy("id", "content")
    line = doc.orderBy("no")
    upto = F.sum("words").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lines.withColumns({"at": F.row_number().over(line).cast("long"), "upto": upto}).withColumn("before", F.col("upto") - F.col("words"))
    # every line has a word, so a run of fewer than min_words words has fewer lines: frames are short
    end = F.max(F.struct("at", "upto")).over(doc.orderBy("before").rangeBetween(0, min_words - 1))
    start = F.min("at").over(doc.orderBy("upto").rangeBetween(-(min_words - 1), 0))
    rows = rows.withColumns({"end": end, "start": start})
    ahead = F.when(F.col("end.upto") - F.col("before") >= min_words, F.col("end.at") - F.col("at") + 1)
    back = F.when(F.col("upto") >= min_words, F.col("at") - F.col("start") + 1)
    return rows.select("id", "content", "no", "at", "hash", ahead.alias("ahead"), back.alias("back"))


def _ranks(named: DataFrame, by: list[str]) -> Stored:
    """Order-preserving ranks of the distinct keys that occur more than once. They are written, so a rank is fixed."""
    keys = named.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return Stored(keys.sort(*by).withColumn("rank", F.monotonically_increasing_id()), "line-ranks")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per document (id, content) with lines to delete: ``gone``, the sorted numbers (from 0) of these lines.

    A line goes if it lies in a run of whole lines with at least ``min_words`` words that also occurs earlier: in a document
    before, or further up in the same one. Documents are ordered by id (null first), then by the MD5 of their text.
    """
    lines = line_table(docs, id_col, text_col).repartition("id", "content").distinct()  # one shuffle serves the windows too
    judged = Stored(runs_to_judge(lines, min_words), "lines")
    base = Stored(judged.df.join(_ranks(judged.df, ["hash"]).df, "hash").select("id", "content", "no", "at", "ahead", "back", "rank"), "line-suffixes")
    longest = base.df.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 0
    judged.drop()
    suffix, span, found = base, 1, []
    while span <= longest:
        key = suffix.df.select(F.col("id").alias("_id"), F.col("content").alias("_c"), F.col("at").alias("_at"), "rank")
        # runs of span .. 2 span - 1 lines are named by the ranks of their first and of their last ``span`` lines
        for kind in ("ahead", "back"):
            size = F.col(kind)
            first = F.col("at") if kind == "ahead" else F.col("at") - size + 1
            run = base.df.where(size.between(span, 2 * span - 1)).select("id", "content", first.alias("first"), size.alias("size"))
            for side, place in (("r0", F.col("first")), ("r1", F.col("first") + F.col("size") - span)):
                k = key.withColumnRenamed("rank", side)
                run = run.join(k, F.col("id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_c")) & (place == F.col("_at"))).drop("_id", "_c", "_at")
            place = F.struct("id", "content", "first")
            origin = run.groupBy("size", "r0", "r1").agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1")
            later = run.join(origin, ["size", "r0", "r1"]).where(~place.eqNullSafe(F.col("origin")))
            end = F.col("first") + F.col("size") - 1
            lost = F.explode(F.sequence("first", end)) if kind == "ahead" else end
            found.append(Stored(later.select("id", "content", lost.alias("at")).distinct(), "line-runs"))
        span *= 2
        if span > longest:
            break
        order = Window.partitionBy("id", "content").orderBy("at")
        follows = F.lead("at", span // 2).over(order) == F.col("at") + span // 2
        pairs = suffix.df.withColumnRenamed("rank", "r0").withColumn("r1", F.when(follows, F.lead("r0", span // 2).over(order))).where("r1 IS NOT NULL")
        suffix = Stored(pairs.join(_ranks(pairs, ["r0", "r1"]).df, ["r0", "r1"]).select("id", "content", "at", "rank"), "line-suffixes")
    marks = base.df.select("id", "content", "at").limit(0)
    for f in found:
        marks = marks.unionByName(f.df)
    numbers = base.df.select(F.col("id").alias("_id"), F.col("content").alias("_c"), F.col("at").alias("_at"), "no")
    gone = marks.distinct().join(numbers, F.col("id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_c")) & (F.col("at") == F.col("_at")))
    return gone.groupBy("id", "content").agg(F.sort_array(F.collect_set("no")).alias("gone"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text, and ``lines_before`` and ``lines_deleted``.

    Texts that lose no line are returned as they are (a null stays null); a text that loses all is empty. Columns of the
    two names are replaced; all others pass through; an empty table gives no rows.
    """
    docs = docs.drop("lines_before", "lines_deleted")
    gone = Stored(repeated_lines(docs, id_col, text_col, min_words), "line-gone").df.withColumnsRenamed({"id": "_gid", "content": "_gc", "gone": "_gone"})
    # always by a sort-merge join: the texts then move alike at every size, whatever the size of ``gone``
    rows = docs.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col("_gid")) & (content_key(F.col(text_col)) == F.col("_gc")), "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return rows.select(
        *[F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.size(lines).alias("lines_before"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("lines_deleted"),
    )


SQL = rf"""
WITH s AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(range(0, len(ls))) AS no, unnest(ls) AS line FROM s),
w AS (SELECT doc_id, no, rtrim(line, chr(13)) AS line, len(regexp_extract_all(line, '[^ 	
]+')) AS words FROM u),
l AS (SELECT doc_id, no, line, words, row_number() OVER d AS pos, sum(words) OVER d AS upto FROM w WHERE words > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY no)),
a AS (SELECT doc_id, list(line ORDER BY pos) AS ls FROM l GROUP BY 1),
f AS (SELECT s.doc_id, s.pos AS first, min(e.pos) AS last FROM l s JOIN l e ON s.doc_id = e.doc_id AND e.pos >= s.pos AND e.upto - s.upto + s.words >= {MIN_WORDS} GROUP BY 1, 2),
b AS (SELECT e.doc_id, max(s.pos) AS first, e.pos AS last FROM l s JOIN l e ON s.doc_id = e.doc_id AND e.pos >= s.pos AND e.upto - s.upto + s.words >= {MIN_WORDS} GROUP BY 1, 3),
r AS (SELECT 'f' AS kind, doc_id, first, last FROM f UNION ALL SELECT 'b', doc_id, first, last FROM b),
t AS (SELECT kind, r.doc_id, first, last, array_to_string(ls[first : last], chr(10)) AS run FROM r JOIN a USING (doc_id)),
o AS (SELECT *, first_value(doc_id) OVER k AS d0, first_value(first) OVER k AS f0 FROM t WINDOW k AS (PARTITION BY kind, run ORDER BY doc_id, first)),
g AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM o WHERE doc_id <> d0 OR first <> f0),
n AS (SELECT doc_id, list(no) AS gone FROM g JOIN l USING (doc_id, pos) GROUP BY 1)
SELECT s.doc_id, len(ls)::INT AS lines_before, coalesce(len(gone), 0)::INT AS lines_deleted,
       sha256(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END) AS kept_sha256
FROM s LEFT JOIN n USING (doc_id)
"""


@query("op8_line_dedup", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines_before", "lines_deleted", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
