"""The training-data pipeline: five stages, each written and read again as the
next one's documents.

Each stage is one operator of ``panelcast.llm`` with the parameters of its
registered query and works on everything its predecessor kept:

1. language ID: documents named ``und`` (null text or no letters) go;
2. line dedup: ``text`` keeps the lines that stay, ``n_chars`` its new length;
3. SimHash near-dedup: of each group the document with the smallest id stays;
4. benchmark decontamination: documents that hold a benchmark window go;
5. mixing: documents that the mix takes, with size, source_size, target and
   taken (words, repeats counted).

The first four return the columns of the documents they were given, whatever
their names. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import decontaminate, lang_crf, line_dedup, mix_sources, simhash_dedup
from panelcast.llm.common import doc_mod, shielded, spool, table


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_crf.fit(spark, docs, doc_mod(F.col("doc_id"), 4) != 2)
    return shielded(docs, ["doc_id", "text"],
                    lambda d: lang_crf.identify(spark, d, model).filter("lang_pred <> 'und'"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = shielded(docs, ["doc_id", "text"], lambda d: line_dedup.dedup_lines(spark, d))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(spark, docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shielded(docs, ["doc_id", "text"], lambda d: decontaminate.remove_contaminated(
        spark, d, table(spark, sf_dir, "benchmark")))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources.mix(spark, docs).filter("taken > 0")


STAGES = [("language ID", _language), ("line dedup", _lines), ("SimHash near-dedup", _near_copies),
          ("benchmark decontamination", _benchmark), ("mixing sources", _mix)]

#: No SQL: a learned model and components over Hamming distances; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    sp = spool(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = sp.put(stage(spark, docs, sf_dir))
    return docs
