"""The registered queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chat, divergence, licenses, media, mixing, packing, quality, secrets, shards, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_jpeg_media": media.op2_jpeg_media,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_secrets": secrets.op4_secrets,
    "op5_simhash": simhash.op5_simhash,
    "op6_shards": shards.op6_shards,
    "op7_perspectives": chat.op7_perspectives,
    "op8_licenses": licenses.op8_licenses,
    "op9_quality": quality.op9_quality,
    "op10_mixing": mixing.op10_mixing,
    "op11_divergence": divergence.op11_divergence,
    "op12_alignment": alignment.op12_alignment,
    "op13_packing": packing.op13_packing,
}
ORACLES: dict[str, str] = {
    "op7_perspectives": chat.OP7_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_divergence": divergence.OP11_SQL,
}
