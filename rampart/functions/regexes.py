"""Regular expressions written for Python's `re`, made ready for Spark (Java) and SQL (RE2)."""

from __future__ import annotations

import re
from re import _constants, _parser

_UNICODE_CASE = re.compile(r"[^\x00-\x7f]|\\[xuUN0-9]")
_UNICODE_CLASS = re.compile(r"\\[swdbSWDB]")


def _escape_braces(pattern: str) -> str:
    """A brace that opens no repetition is a literal; Java wants it escaped."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            # \u{XXXX}-style escapes never occur in the rules; keep the pair as it is
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        elif not in_class and ch == "{":
            m = re.match(r"\{\d*,?\d*\}", pattern[i:])
            if m and m.group() not in ("{}", "{,}"):
                out.append(m.group())
                i += m.end()
                continue
            ch = r"\{"
        elif not in_class and ch == "}":
            ch = r"\}"
        out.append(ch)
        i += 1
    return "".join(out)


def java_regex(
    pattern: str, *, ignore_case: bool = False, multiline: bool = False, dotall: bool = False, unicode_case: bool = False
) -> str:
    """Same matches in Java as `re` gives: only \\n ends a line, classes are Unicode, and so is the
    case of expressions that may hold other letters than ASCII (`unicode_case`: of any)."""
    flags = "d"
    flags += "i" if ignore_case else ""
    flags += "u" if ignore_case and (unicode_case or _UNICODE_CASE.search(pattern)) else ""
    flags += "m" if multiline else ""
    flags += "s" if dotall else ""
    flags += "U" if _UNICODE_CLASS.search(pattern) else ""
    return f"(?{flags}){_escape_braces(pattern)}"


def sql_regex(pattern: str, *, ignore_case: bool = False, multiline: bool = False, dotall: bool = False) -> str:
    """RE2 form for oracle queries; `$` also matches before a last newline."""
    body = _escape_braces(pattern)
    if not multiline and body.endswith("$") and not body.endswith(r"\$"):
        body = body[:-1] + r"\n?\z"
    flags = ("i" if ignore_case else "") + ("m" if multiline else "") + ("s" if dotall else "")
    return (f"(?{flags})" if flags else "") + body


def spark_str(value: str) -> str:
    """A literal for Spark's parser, which reads backslash escapes."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def spark_name(column: str) -> str:
    """A column's name, or the path of a nested one, for Spark's parser."""
    return column if "." in column or "`" in column else f"`{column}`"


def sql_str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def required_literals(pattern: str, min_len: int = 3) -> list[str]:
    """ASCII literals that every match contains, in lower case, longest first.

    Read off the parsed expression: runs of plain characters outside alternations, options and
    repeats; groups that must match count too.  May be empty.  To be looked for in `fold`ed texts."""
    try:
        tree = _parser.parse(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return []
    runs: list[str] = [""]

    def walk(items) -> None:
        for op, value in items:
            if op is _constants.LITERAL and value < 128:
                runs[-1] += chr(value).lower()
            elif op is _constants.SUBPATTERN:
                if value[1] or value[2]:
                    runs.append("")  # flags change inside
                else:
                    walk(value[3])
            elif op is not _constants.AT:
                runs.append("")

    walk(tree)
    return sorted({r for r in runs if len(r) >= min_len}, key=lambda r: (-len(r), r))


#: Characters that match an ASCII letter when case is ignored, but are not its capital.
FOLDED = ("ſıK", "sik")


def fold(text: str) -> str:
    return text.lower().translate(str.maketrans(*FOLDED))
