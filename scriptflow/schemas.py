"""Column layouts of the engine's tables."""

from __future__ import annotations

SOURCES = "file string, ext string, text string, mtime_ns bigint, size bigint"
TOKENS = "file string, i int, type string, value string, line int, col int, raw string, off int"
REGISTRY = "kind string, name string"
SYMBOLS = "project string, kind string, name string"
FUNCTION_SIGNATURES = "name string, pos int, types array<string>"
LINE_MAP = "file string, out_line int, origin_file string, origin_line int"
DIAGNOSTICS = "file string, line int, `column` int, severity string, code string, message string, pass_no int, seq int"
CHANGED_LINES = "file string, line int"
BASELINE = "fingerprint string"
EDITS = "file string, line int, `column` int, start int, `end` int, replacement string, rule string"
#: The columns of a diagnostic in their order.
DIAGNOSTIC_COLUMNS = ["file", "line", "column", "severity", "code", "message", "pass_no", "seq"]
