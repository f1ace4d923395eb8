"""The subpackage's queries and their oracle SQL."""

from __future__ import annotations

from . import decontaminate, jaccard, language, line_dedup, media, mixing, revisits, sharding, tokens, tools

QUERIES = {
    "op1_ftrl_language": language.op1_ftrl_language,
    "op2_tool_linking": tools.op2_tool_linking,
    "op3_golden_mix": mixing.op3_golden_mix,
    "op4_positional_decontamination": decontaminate.op4_positional_decontamination,
    "op5_chunked_media": media.op5_chunked_media,
    "op6_edit_counts": tokens.op6_edit_counts,
    "op7_flow_resharding": sharding.op7_flow_resharding,
    "op8_levelled_line_dedup": line_dedup.op8_levelled_line_dedup,
    "op9_revisit_resolution": revisits.op9_revisit_resolution,
    "op10_banded_jaccard": jaccard.op10_banded_jaccard,
}

#: Models, chunkings, token merges and block fitting have no SQL; brute force tests them.
SQL = {
    "op2_tool_linking": tools.SQL,
    "op3_golden_mix": mixing.SQL,
    "op4_positional_decontamination": decontaminate.SQL,
    "op8_levelled_line_dedup": line_dedup.SQL,
    "op9_revisit_resolution": revisits.SQL,
    "op10_banded_jaccard": jaccard.SQL,
}
