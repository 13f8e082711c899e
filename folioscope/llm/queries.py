"""The queries pN_ over the tables of TESTDATA.md and their SQL; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.encoding import damaged_documents, repaired
from folioscope.llm.leaks import leaks
from folioscope.llm.mail import new_lines, own_texts
from folioscope.llm.mix import mix, shares
from folioscope.llm.names import same_party
from folioscope.llm.near import near_pairs
from folioscope.llm.pii import pii_values, redact_pii
from folioscope.llm.pieces import split_items
from folioscope.llm.secrets import secret_spans, sensitivity_raised, redact_secrets


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a mail that its sender newly wrote."""
    return new_lines(_table(spark, sf_dir, "file_extract").filter("kind = 'email'"))


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mail reduced to what its sender newly wrote."""
    return own_texts(_table(spark, sf_dir, "file_extract").filter("kind = 'email'"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct personal value of each text, as it stands there."""
    return pii_values(_table(spark, sf_dir, "file_extract"), _table(spark, sf_dir, "file_catalog").select("file_id", "pii_columns"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with typed placeholders for personal data."""
    files = _table(spark, sf_dir, "file_extract").select("file_id", "kind", "text")
    return redact_pii(files, _table(spark, sf_dir, "file_catalog").select("file_id", "pii_columns")).select("file_id", "redacted_text").distinct()


def p2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with surrogates for personal data, under a key for tests."""
    files = _table(spark, sf_dir, "file_extract").select("file_id", "kind", "text")
    return redact_pii(files, _table(spark, sf_dir, "file_catalog").select("file_id", "pii_columns"), key=b"a key for tests").select("file_id", "redacted_text").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of spellings of one counterparty."""
    return same_party(_table(spark, sf_dir, "file_catalog").select("counterparty"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each extract and request whose text comes out in more than one piece."""

    def of(table: str, id_col: str, text_col: str) -> DataFrame:
        rows = split_items(_table(spark, sf_dir, table), id_col, text_col)
        return rows.filter("piece_no > 1").select(F.lit(table).alias("item_table"), F.col(id_col).alias("item_id"))

    return of("file_extract", "file_id", "text").unionByName(of("request_state", "request_id", "content")).distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each extract, in their order."""
    return split_items(_table(spark, sf_dir, "file_extract").select("file_id", "text").distinct(), "file_id", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of files with nearly the same text."""
    return near_pairs(_table(spark, sf_dir, "file_extract"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a code file or note that holds a part of a live credential."""
    files = _table(spark, sf_dir, "file_extract").filter(F.col("kind").isin("code", "text"))
    return secret_spans(files).select("file_id", "line_no").distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code file and note with its credentials blanked out."""
    files = _table(spark, sf_dir, "file_extract").filter(F.col("kind").isin("code", "text")).select("file_id", "text")
    return redact_secrets(files).select("file_id", "redacted_text").distinct()


def p6_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file that holds a live credential and is catalogued below restricted."""
    files = _table(spark, sf_dir, "file_extract").filter(F.col("kind").isin("code", "text"))
    return sensitivity_raised(_table(spark, sf_dir, "file_catalog"), secret_spans(files))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and held-out item that share a stretch of words."""
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used for each source of the mix."""
    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source got: documents, uses, tokens, and its share of the mix beside its target."""
    return shares(p8_mix(spark, sf_dir), _table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document whose own words hold characters read in the wrong encoding."""
    return damaged_documents(_table(spark, sf_dir, "documents"))


def p9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each damaged document's text as far as it can be restored."""
    return repaired(_table(spark, sf_dir, "documents")).filter("damage != 'none'").select("doc_id", "damage", "repaired_text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": "SELECT 'file_extract' AS item_table, file_id AS item_id FROM file_extract WHERE length(text) > 2000"
        " UNION SELECT 'request_state', request_id FROM request_state WHERE length(content) > 2000",
    }
