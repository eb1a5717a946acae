"""Control-token vocabulary of the chat/tool-calling grammar.

Fixed values: these strings and their ids must equal the reference grammar
exactly (reserved ids 0..13, in this order).
"""

from __future__ import annotations

import re

# --- fixed values (reserved vocabulary, ids 0..13 in order) -----------------
SPECIAL_TOKENS = [
    "<|pad|>",
    "<|bos|>",
    "<|eos|>",
    "<|unk|>",
    "<|im_start|>",
    "<|im_end|>",
    "<|thought_start|>",
    "<|thought_end|>",
    "<|tool_call_start|>",
    "<|tool_call_end|>",
    "<|tool_result_start|>",
    "<|tool_result_end|>",
    "<|mcp_server_decl|>",
    "<|mcp_server_end|>",
]
# ---------------------------------------------------------------------------

PAD, BOS, EOS, UNK = SPECIAL_TOKENS[0:4]
IM_START, IM_END = SPECIAL_TOKENS[4:6]
THOUGHT_START, THOUGHT_END = SPECIAL_TOKENS[6:8]
CALL_START, CALL_END = SPECIAL_TOKENS[8:10]
RESULT_START, RESULT_END = SPECIAL_TOKENS[10:12]
DECL_START, DECL_END = SPECIAL_TOKENS[12:14]

ASSISTANT_HEADER = IM_START + "assistant\n"

#: Python ``str.strip()`` whitespace, built by rule (every code point for which
#: ``isspace()`` holds) so trimming matches Python, not SQL ``trim``.
PY_WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


#: the same as regex classes, for Java and RE2
WS_CLASS = "[" + PY_WHITESPACE + "]"
NON_WS = "[^" + PY_WHITESPACE + "]+"


def java_quote(s: str) -> str:
    """Regex-escape for Java (Spark) and RE2 (DuckDB) alike."""
    return re.sub(r"([\\|.^$*+?()\[\]{}])", r"\\\1", s)


def span_pattern(start: str, end: str) -> str:
    """Non-greedy, dot-all span between two markers, group 1 = body."""
    return "(?s)" + java_quote(start) + "(.*?)" + java_quote(end)


CALL_SPAN = span_pattern(CALL_START, CALL_END)
#: fallback when no marker span exists: first ``{`` to the first ``}`` (non-greedy)
FLAT_OBJECT = r"(?s)\{.*?\}"
#: greedy object: first ``{`` to the last ``}``
GREEDY_OBJECT = r"(?s)\{.*\}"
#: name recovery inside an unparseable call body
NAME_RECOVERY = '"name":' + WS_CLASS + r'*"([^"]+)"'
#: any one of the reserved markers, as a capture group
ANY_MARKER = "(" + "|".join(java_quote(t) for t in SPECIAL_TOKENS) + ")"


def sql_str(s: str) -> str:
    """Quote a Python string as a Spark/DuckDB SQL literal (no backslash escapes)."""
    return "'" + s.replace("'", "''") + "'"
