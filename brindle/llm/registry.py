"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import chat, decontaminate, html_text, langid, oracle, pieces, quality, secrets, simhash, token_counts, warc


def _on(f: Callable, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": _on(simhash.op1, "documents"),
        "op2_secrets": _on(secrets.op2, "documents"),
        "op3_decontamination": _on(decontaminate.op3, "documents", "benchmark"),
        "op4_token_counts": _on(token_counts.op4, "documents"),
        "op5_pieces": _on(pieces.op5, "documents"),
        "op6_quality": _on(quality.op6, "documents"),
        "op7_chat": _on(chat.op7, "conversations"),
        "op8_html": _on(html_text.op8, "pages"),
        "op9_warc": _on(warc.op9, "pages"),
        "op10_langid": _on(langid.op10, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    """SQL where DuckDB can express the query. XXH64, tokenizers, trained models and the spans that op2 and op3 add are
    beyond it; tests hold those queries against brute force."""
    return {name: sql() for name, sql in oracle.ORACLE.items()}
