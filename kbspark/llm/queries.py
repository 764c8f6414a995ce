"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import credentials as C
from kbspark.llm import encode as E
from kbspark.llm import generated as G
from kbspark.llm import graph_search as GS
from kbspark.llm import leaks as L
from kbspark.llm import neighbours as N
from kbspark.llm import split as S
from kbspark.llm import truncated as T


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return N.similar_pairs(_table(spark, d, "embedding_cache"))


def p1_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar live rows for every live row whose id is divisible by 50, by greedy search in the graph."""
    return GS.search_rows(_table(spark, d, "embedding_cache"), "id % 50 = 0")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = S.split(_table(spark, d, "index_file"), _table(spark, d, "recursive_chunker"), with_text=False, oversized=True)
    return pieces.where("piece = 1").select("file_id", "config_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return S.split(_table(spark, d, "index_file"), _table(spark, d, "recursive_chunker"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return G.find_unwritten(_table(spark, d, "index_file")).select("file_id").distinct()


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kind of every file that was not written by hand, and the evidence."""
    return G.find_unwritten(_table(spark, d, "index_file"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return C.find_credentials(_table(spark, d, "index_file")).select("file_id", "line_no").distinct()


def p4_masked(spark: SparkSession, d: str) -> DataFrame:
    """Contents with the values masked."""
    return C.redact(_table(spark, d, "index_file"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return E.encode(_table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return L.find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return T.find_truncated(_table(spark, d, "documents")).select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    documents = _table(spark, d, "documents")
    return T.truncation_rates(documents, T.find_truncated(documents))


QUERIES = {"p1_found": p1_found, "p1_search": p1_search, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_kinds": p3_kinds, "p4_found": p4_found, "p4_masked": p4_masked, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_rates": p9_rates}
SQL = {
    "p2_found": """SELECT DISTINCT f.file_id, c.config_id FROM index_file f JOIN recursive_chunker c
ON c.max_tokens > 0 AND (octet_length(encode(f.content)) + 3) // 4 > c.max_tokens""",
}
