"""Operators for training-data corpora. Nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The registered queries of this package and of corpus_pipeline, by name."""
    from lectorium.llm.decontamination import op4_decontamination
    from lectorium.llm.html_text import op7_html_text
    from lectorium.llm.jaccard_join import op2_ngram_jaccard
    from lectorium.llm.language_id import op5_language_id
    from lectorium.llm.licenses import op1_license_scan
    from lectorium.llm.mixing import op9_source_mixing
    from lectorium.llm.suffix_dedup import op3_suffix_dedup
    from lectorium.llm.tokens import op6_token_ids
    from lectorium.llm.top_k import op8_exact_top_k
    from lectorium.llm.warc import op10_warc

    found = (op1_license_scan, op2_ngram_jaccard, op3_suffix_dedup, op4_decontamination, op5_language_id, op6_token_ids, op7_html_text, op8_exact_top_k, op9_source_mixing, op10_warc)
    import corpus_pipeline

    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    from lectorium.llm.decontamination import OP4_SQL
    from lectorium.llm.mixing import OP9_SQL
    from lectorium.llm.top_k import OP8_SQL
    from lectorium.llm.warc import OP10_SQL

    return {"op4_decontamination": OP4_SQL, "op8_exact_top_k": OP8_SQL, "op9_source_mixing": OP9_SQL, "op10_warc": OP10_SQL}
