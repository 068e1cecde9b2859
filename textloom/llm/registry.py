"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, licences, mixing, quality, sharding, simhash, token_files, toxicity, vectors, warc
from .sql import ORACLES

QUERIES = {
    "op1_hnsw_near_dedup": vectors.query,
    "op2_warc_zstd": warc.query,
    "op3_extendible_sharding": sharding.query,
    "op4_toxicity_restored": toxicity.query,
    "op5_licence_windows": licences.query,
    "op6_quality_mcd": quality.query,
    "op7_source_mixture": mixing.query,
    "op8_simhash_deletion": simhash.query,
    "op9_orc_token_ids": token_files.query,
    "op10_byte_bpe": bpe.query,
}

__all__ = ["ORACLES", "QUERIES"]
