"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, embedding_dedup, fim, host_rules, minhash, mixing, nearest, packing, pii, quality, substrings, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mixing": mixing.op1,
        "op2_warc_revisits": warc.op2,
        "op3_pii": pii.op3,
        "op4_minhash_near_dedup": minhash.op4,
        "op5_quality": quality.op5,
        "op6_url_filter": url_filter.op6,
        "op7_nearest_neighbours": nearest.op7,
        "op8_mixture_packing": packing.op8,
        "op9_embedding_dedup": embedding_dedup.op9,
        "op10_substring_dedup": substrings.op10,
        "op11_fill_in_middle": fim.op11,
        "op12_collocations": collocations.op12,
        "op13_host_rules": host_rules.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_revisits": warc.OP2_SQL,
        "op4_minhash_near_dedup": minhash.OP4_SQL,
        "op7_nearest_neighbours": nearest.OP7_SQL,
        "op9_embedding_dedup": embedding_dedup.OP9_SQL,
        "op10_substring_dedup": substrings.OP10_SQL,
        "op11_fill_in_middle": fim.OP11_SQL,
        "op12_collocations": collocations.OP12_SQL,
        "op13_host_rules": host_rules.OP13_SQL,
    }
