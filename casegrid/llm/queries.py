"""Queries of this subpackage, and their SQL where SQL can express one."""

from __future__ import annotations

from casegrid.llm import conversations, language, mixing, names, packing, pii, reading, scans

QUERIES = {
    "p2_found": pii.p2_found,
    "p2_redacted": pii.p2_redacted,
    "p3_found": names.p3_found,
    "p3_members": names.p3_members,
    "p5_found": scans.p5_found,
    "p6_found": language.p6_found,
    "p7_found": conversations.p7_found,
    "p8_containers": packing.p8_containers,
    "p8_fill": packing.p8_fill,
    "p9_mixture": mixing.p9_mixture,
    "p9_shares": mixing.p9_shares,
    "p10_found": reading.p10_found,
    "p10_levels": reading.p10_levels,
}

SQL: dict[str, str] = {}
