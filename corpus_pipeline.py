"""A corpus pipeline of five training-data operators.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``.

Defined cases: documents with null text or without a letter go in the first
stage, their language being unknown; repeated rows (equal ``doc_id`` and text)
leave the second as one; rows of one ``doc_id`` and different texts are
documents each; a null ``doc_id`` is larger than any other where the least of a
group of copies stays. Further columns are carried along
whatever their names, but for ``shard`` and ``slot``, which the last stage sets.
An empty table gives an empty one with all columns. A long text is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindle.llm import decontaminate, jaccard, language, mixing, sharding
from spindle.llm.common import cut, table

STAGES = [
    ("language ID", language.stage),
    ("n-gram Jaccard join", jaccard.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources to target weights", mixing.stage),
    ("sharding", sharding.stage),
]

#: A trained model and a greedy fit of blocks are in the chain: SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(spark, stage(spark, docs, sf_dir), f"stage{k}")
    return docs
