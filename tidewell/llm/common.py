"""What the operators share: checkpoints, table access and decimal-safe ids."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import remove, shared_dir  # noqa: F401

#: Prefix of the columns that operators add for their own use.
OWN = "_tw_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str):
    """A column by its plain name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(names: list[str]) -> list:
    """Columns under plain names of our own, as functions over Arrow batches need them; ``renamed`` gives them back."""
    return [col(c).alias(f"{OWN}c{i}") for i, c in enumerate(names)]


def renamed(names: list[str]) -> list:
    return [F.col(f"{OWN}c{i}").alias(c) for i, c in enumerate(names)]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that a lost executor costs a reread and no recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under our own names, of the rows that have both."""
    return docs.select(
        col(id_col).cast("bigint").alias(f"{OWN}id"), col(text_col).cast("string").alias(f"{OWN}text")
    ).where(f"{OWN}id is not null and {OWN}text is not null")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public vocabulary file; the folder is a parameter, else ``TIDEWELL_TOKENIZERS``, else the usual place."""
    return os.path.join(folder or os.environ.get("TIDEWELL_TOKENIZERS", "/opt/tokenizers"), name)
