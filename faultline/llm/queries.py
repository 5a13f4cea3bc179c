"""Queries p2, p6, p7 and p8 over whole tables, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import pii
from faultline.llm.packing import pack, packing_report
from faultline.llm.residue import with_residue
from faultline.llm.tokens import encode_texts, token_counts
from faultline.session import cut, table


def _free_text(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, pii.Lexicon]:
    return pii.fields(table(spark, sf_dir, "log_lines"), table(spark, sf_dir, "kb_incidents")), pii.read_lexicon(table(spark, sf_dir, "name_parts"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of personal information."""
    return pii.occurrences(*_free_text(spark, sf_dir))


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders."""
    return pii.masked(*_free_text(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids of every document."""
    return token_counts(table(spark, sf_dir, "documents"))


#: Tokenizers that the specifications may name; more is an error.
MOST_TOKENIZERS = 100


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    specs = table(spark, sf_dir, "pack_specs")
    return place(table(spark, sf_dir, "documents"), specs), specs


def place(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """The containers of every row of `specs`, each measured in tokens of its own tokenizer. No specifications give no rows; one without a tokenizer, or more
    than MOST_TOKENIZERS of them, is an error."""
    names = [r[0] for r in specs.select("tokenizer").distinct().limit(MOST_TOKENIZERS + 1).collect()]
    if len(names) > MOST_TOKENIZERS or None in names:
        raise ValueError(f"specifications name no tokenizer or more than {MOST_TOKENIZERS}")
    if not names:
        return pack(docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens")), specs)
    parts = [pack(cut(token_counts(docs, name)), specs.where(F.col("tokenizer") == name)) for name in names]
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    return placed


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece, for every row of pack_specs."""
    return _placed(spark, sf_dir)[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and room left, by row of pack_specs."""
    return packing_report(*_placed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to exclude."""
    return with_residue(table(spark, sf_dir, "documents")).where("residue is not null").select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_masked, p6_ids, p6_counts, p7_containers, p7_report, p8_found)}
SQL: dict[str, str] = {}
