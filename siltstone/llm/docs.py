"""Getting at documents by position, so that no other column's name matters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID, TEXT = "doc_id", "text"


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under positional names, and where the named columns are; later columns of a name that an earlier one has are ignored."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at: dict[str, str] = {}
    for given, name in zip(docs.columns, names):
        at.setdefault(given, name)
    return docs.toDF(*names), at


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id bigint, text string, more...) of the rows that have an id; a null text is empty."""
    plain, at = numbered(docs)
    return plain.where(F.col(at[ID]).isNotNull()).select(F.col(at[ID]).cast("bigint").alias(ID), F.coalesce(F.col(at[TEXT]).cast("string"), F.lit("")).alias(TEXT), *(F.col(at[m]).alias(m) for m in more))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose id is in the one column of ids; rows without an id stay."""
    plain, at = numbered(docs)
    gone = ids.toDF("_gone")
    return plain.join(gone, plain[at[ID]] == gone["_gone"], "left_anti").toDF(*docs.columns)
