"""Text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends of a text, as a pattern: CR LF first, then every single separator.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def lines_of(text: Column) -> Column:
    """The lines of a text without their ends; an end at the text's end begins no further line."""
    parts = F.split(text, LINE_END)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def without_trailing_blanks(line: Column) -> Column:
    return F.regexp_replace(line, "[ \t]++$", "")


def glob_pattern(glob: str) -> str:
    """A regular expression for a shell pattern in which * also crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            i = end
        else:
            out += c if c.isalnum() or c in "_/-" else f"\\{c}"
        i += 1
    return f"^{out}$"


def fingerprint(*parts: Column, digits: int = 24) -> Column:
    """The first hex digits of SHA-256 over the parts joined by |; null, 0 and empty parts are empty."""
    plain = [F.coalesce(F.when(p.cast("string") != "0", p.cast("string")), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *plain), 256), 1, digits)


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_xml(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")])


def escape_annotation(text: Column, prop: bool = False) -> Column:
    """Percent escapes of workflow annotations; properties also escape : and ,."""
    pairs = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")]
    return _replaced(text, pairs + [(":", "%3A"), (",", "%2C")] * prop)
