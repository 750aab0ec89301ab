"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocation, infill, langid, mixing, neardup, packing, quality, secret_scan, simhash, substring, warc, wavelet, webp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_secrets": secret_scan.op2_secrets,
    "op3_wavelet": wavelet.op3_wavelet,
    "op4_langid": langid.op4_langid,
    "op5_neardup": neardup.op5_neardup,
    "op6_webp": webp.op6_webp,
    "op7_mixing": mixing.op7_mixing,
    "op8_packing": packing.op8_packing,
    "op9_substring": substring.op9_substring,
    "op10_warc": warc.op10_warc,
    "op11_simhash": simhash.op11_simhash,
    "op12_collocation": collocation.op12_collocation,
    "op13_infill": infill.op13_infill,
}

SQL: dict[str, str] = {
    "op1_quality": quality.OP1_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_substring": substring.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_collocation": collocation.OP12_SQL,
    "op13_infill": infill.OP13_SQL,
}
