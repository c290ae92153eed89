"""The registered queries of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, divergence, identifiers, langid, lpf, media, mixing, packing, secrets_cnn, sharding, simhash, vptree, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": langid.query,
    "op2_capture_index": warc.query,
    "op3_simhash_bk_trees": simhash.query,
    "op4_hypergeometric_shards": sharding.query,
    "op5_secret_network": secrets_cnn.query,
    "op6_previous_factors": lpf.query,
    "op7_interleaved_media": media.query,
    "op8_minimum_bin_slack": packing.query,
    "op9_vantage_point_trees": vptree.query,
    "op10_entropy_balancing": mixing.query,
    "op11_token_alignment": alignment.query,
    "op12_bootstrapped_identifiers": identifiers.query,
    "op13_source_divergence": divergence.query,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op2_capture_index": warc.ORACLE,
    "op9_vantage_point_trees": vptree.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
