"""Queries of the text operators and their SQL twins."""

from __future__ import annotations

from oxbow.llm import dedup, digest, frequent, packing, quality, tokenizer, truncation

QUERIES = {
    "p1_found": truncation.p1_found,
    "p1_shares": truncation.p1_shares,
    "p4_found": frequent.p4_found,
    "p4_items": frequent.p4_items,
    "p4_top_users": frequent.p4_top_users,
    "p6_percentiles": digest.p6_percentiles,
    "p6_daily": digest.p6_daily,
    "p7_found": dedup.p7_found,
    "p7_collapsed": dedup.p7_collapsed,
    "p8_ids": tokenizer.p8_ids,
    "p9_containers": packing.p9_containers,
    "p10_found": quality.p10_found,
    "p10_stats": quality.p10_stats,
}

ORACLE: dict[str, str] = {**frequent.ORACLE}
