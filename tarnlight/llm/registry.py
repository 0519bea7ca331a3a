"""The queries of this subpackage by name, with the DuckDB SQL that checks them."""

from __future__ import annotations

from tarnlight.llm import byte_bpe, debruijn_spans, decontaminate, line_frequency, mixture_shards, secret_scan, simhash_dedup, token_pack, url_filter, warc_derivatives

QUERIES = {
    "op1_warc_derivatives": warc_derivatives.query,
    "op2_decontaminate": decontaminate.query,
    "op3_url_filter": url_filter.query,
    "op4_secret_scan": secret_scan.query,
    "op5_mixture_shards": mixture_shards.query,
    "op6_simhash_dedup": simhash_dedup.query,
    "op7_debruijn_spans": debruijn_spans.query,
    "op8_line_frequency": line_frequency.query,
    "op9_token_pack": token_pack.query,
    "op10_byte_bpe": byte_bpe.query,
}
ORACLE_SQL = {
    "op1_warc_derivatives": warc_derivatives.SQL,
    "op3_url_filter": url_filter.SQL,
    "op5_mixture_shards": mixture_shards.SQL,
    "op8_line_frequency": line_frequency.SQL,
}
