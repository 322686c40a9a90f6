"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tableprep.llm import (chat_format, fill_middle, hamming, mixing, packing, quality, quality_rules, secrets, simhash, suffix_dedup, table_kmeans,
                           token_output, toxicity)


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(query: Callable) -> Callable:
    """Let Python workers find this package where the session was started elsewhere."""
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = spark.sparkContext.environment
        if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, env.get("PYTHONPATH"))))
        return query(spark, sf_dir)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_rans_tokens": token_output.op2_rans_tokens,
        "op3_quality_gbdt": quality.op3_quality_gbdt,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_hamming_topk": hamming.op6_hamming_topk,
        "op7_simhash_groups": simhash.op7_simhash_groups,
        "op8_curriculum_mix": mixing.op8_curriculum_mix,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_toxicity_ftrl": toxicity.op10_toxicity_ftrl,
        "op11_fill_middle": fill_middle.op11_fill_middle,
        "op12_chat_format": chat_format.op12_chat_format,
        "op13_table_kmeans": table_kmeans.op13_table_kmeans,
    }
    return {name: importable(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op6_hamming_topk": hamming.ORACLE_SQL, "op8_curriculum_mix": mixing.ORACLE_SQL, "op11_fill_middle": fill_middle.ORACLE_SQL,
            "op12_chat_format": chat_format.ORACLE_SQL, "op13_table_kmeans": table_kmeans.ORACLE_SQL}
