"""The training-text queries, p7 to p9. SQL cannot state them; tests hold them against brute force."""

from __future__ import annotations

from claimwright.llm import encode, leaks, split
from claimwright.plans.tables import table


def p7_ids(spark, sf_dir):
    return encode.encode(table(spark, sf_dir, "documents"))


def p8_found(spark, sf_dir):
    return leaks.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_report(spark, sf_dir):
    return leaks.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark, sf_dir):
    return split.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "size_limits"))


def p9_pieces(spark, sf_dir):
    return split.split(table(spark, sf_dir, "documents"), table(spark, sf_dir, "size_limits"))


QUERIES = {"p7_ids": p7_ids, "p8_found": p8_found, "p8_report": p8_report, "p9_found": p9_found, "p9_pieces": p9_pieces}
