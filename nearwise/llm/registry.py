"""The queries of this subpackage by name, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

import os
from pathlib import Path

import corpus_pipeline

from . import fixity, lines, minhash, mixing, neighbours, packing, quality, search, simhash, substrings, suffixes, toxicity, whitening


def queries() -> dict:
    return {name: _shipped(query) for name, query in _queries().items()}


def _shipped(query):
    """A local session's Python workers find this package too, wherever the session was started."""

    def run(spark, sf_dir):
        if spark.sparkContext.master.startswith("local["):
            places = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
            root = str(Path(__file__).resolve().parents[2])
            if root not in places:
                spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, places)])
        return query(spark, sf_dir)

    return run


def _queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_substring_dedup": substrings.op2_substring_dedup,
        "op3_quality": quality.op3_quality,
        "op4_line_dedup": lines.op4_line_dedup,
        "op5_merkle_audit": fixity.op5_merkle_audit,
        "op6_packing": packing.op6_packing,
        "op7_simhash": simhash.op7_simhash,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_fingerprints": minhash.op10_fingerprints,
        "op11_whitening": whitening.op11_whitening,
        "op12_suffix_dedup": suffixes.op12_suffix_dedup,
        "op13_search": search.op13_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.OP1_SQL,
        "op2_substring_dedup": substrings.OP2_SQL,
        "op4_line_dedup": lines.OP4_SQL,
        "op5_merkle_audit": fixity.OP5_SQL,
        "op8_neighbours": neighbours.OP8_SQL,
        "op12_suffix_dedup": suffixes.OP12_SQL,
        "op13_search": search.OP13_SQL,
    }
