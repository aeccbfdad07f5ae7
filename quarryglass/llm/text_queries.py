"""Queries on texts: packing, leaks, sentences."""

import os

from pyspark.sql import functions as F

from quarryglass.catalog import Catalog
from quarryglass.llm.leakage import RUN, leaks
from quarryglass.llm.packing import fill_containers, fill_report, token_counts
from quarryglass.llm.sentences import sentences
from quarryglass.plans.cut import Scratch
from quarryglass.sources.tables import table

#: Ranks of a public tokenizer, read by the driver.
TOKENIZER = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Least part of a passage that an alignment must hold for an edited copy.
ALIGNED = 0.5


def register(c: Catalog) -> None:
    @c.query("p6_containers")
    def containers(spark, d):
        counts = token_counts(table(spark, d, "documents", "doc_id", "text"), TOKENIZER)
        return fill_containers(counts, table(spark, d, "container_spec"))

    @c.query("p6_report")
    def report(spark, d):
        filled = Scratch(spark, "filled").write(containers(spark, d))
        return fill_report(filled, table(spark, d, "container_spec"))

    @c.query("p7_found")
    def leaked(spark, d):
        return found(spark, d).where(F.col("longest_run") >= RUN).select("doc_id", "item_id")

    def found(spark, d, edited=False):
        return leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_item", "item_id", "passage"), edited=edited)

    @c.query("p7_scored")
    def scored(spark, d):
        kept = found(spark, d, edited=True).where((F.col("longest_run") >= RUN) | (F.col("aligned") >= ALIGNED))
        return kept.withColumn("aligned", F.round("aligned", 4))

    @c.query("p8_found")
    def split(spark, d):
        return sentences(table(spark, d, "documents", "doc_id", "text"))

    @c.query("p8_per_document")
    def per_document(spark, d):
        return split(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.max(F.col("end_pos") - F.col("start_pos")).alias("longest"))
