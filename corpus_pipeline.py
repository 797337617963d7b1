"""A training corpus from raw documents: language ID, line dedup, near-dedup, decontamination, source mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns of
``docs``. Each stage's result is written as a table before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohera.llm import decontamination, language_id, line_dedup, mixing, near_dedup
from cohera.llm.registry import table
from cohera.llm.shared import Stored

#: Language ID and BagMinHash have no SQL form; the stages are tested one by one against brute force.
ORACLE_SQL = None


#: Columns that stages read; all others of a stage's input travel in one column, so that no name of theirs can meet a name
#: that an operator uses inside, and come back as they were.
READ = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = "carried_columns"


def sheltered(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage on the columns of ``READ``; columns that it adds replace carried ones of their name."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        column = lambda c: F.col("`" + c.replace("`", "``") + "`")
        rest = [c for c in docs.columns if c not in READ]
        if not rest:
            return stage(spark, docs, sf_dir)
        slim = docs.select(*[c for c in docs.columns if c in READ], F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias(CARRIED))
        out = stage(spark, slim, sf_dir)
        new = [c for c in out.columns if c not in slim.columns]
        place = lambda c: column(c) if c in READ else F.col(CARRIED).getField(f"c{rest.index(c)}").alias(c)
        return out.select(*[place(c) for c in docs.columns if c not in new], *new)

    return run_stage


@sheltered
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised (no letters, or a score below the calibrated threshold) go.

    Where no document has a language to learn from, none can be told apart: documents with a letter stay.
    """
    learn = F.col("lang").isNotNull()
    names = ("_lang_pred", "_lang_score", "_lang_rejected")
    model = language_id.train(docs, learn, "doc_id", "text", "lang")
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language_id.identify(docs, model, "text", names)
    return found.where(~F.col("_lang_rejected")).drop(*names)


@sheltered
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs of 50 words and more are deleted from the texts; documents of which nothing but
    white space is left go. ``n_chars`` follows the text."""
    out = line_dedup.drop_repeated_lines(docs)
    left = (F.col("lines_deleted") == 0) | (F.length(F.trim(F.translate(F.coalesce("text", F.lit("")), "\n\r\t", "   "))) > 0)
    return _counted(out.where(left), docs)


@sheltered
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five words, 0.8) the document with the smallest id stays."""
    return near_dedup.keep_one(docs)


@sheltered
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of ten words (or a whole shorter item) with a benchmark item go."""
    marked = docs.withColumn("_content", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    found = decontamination.decontaminate(marked, table(spark, sf_dir, "benchmark"), keep=("_content",))
    bad = Stored(found.where("contaminated").select("_content").distinct(), "contaminated").df
    return marked.join(bad, "_content", "left_anti").select(*docs.columns)


@sheltered
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in the mixture: by ``mix_slot``, then ``mix_place``."""
    return mixing.mix_sources(docs)


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("lines_deleted") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("source_mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = Stored(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return docs
