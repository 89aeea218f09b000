"""Patterns of the query language (RE2 syntax, whole value) as Java patterns, and glob patterns."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException

# POSIX classes of RE2 and the Java classes that hold the same characters.
POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": "0-9", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}
SPACE = r"\t\n\f\r "


class BadPattern(ValueError):
    """Not a pattern of the language."""


def _compiles(pattern: str) -> bool:
    """Whether Java takes a pattern; without a session it is taken to."""
    context = SparkContext._active_spark_context
    if context is None:
        return True
    try:
        context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def _escape(pattern: str, k: int, in_class: bool) -> tuple[str, int]:
    if k + 1 >= len(pattern):
        raise BadPattern("trailing backslash")
    c = pattern[k + 1]
    if c == "s":
        return (SPACE if in_class else f"[{SPACE}]"), k + 2
    if c == "S":
        return (f"&&[^{SPACE}]" if in_class else f"[^{SPACE}]"), k + 2
    if m := re.compile(r"0[0-7]{0,2}|[1-7][0-7]{1,2}").match(pattern, k + 1):
        return f"\\x{{{int(m[0], 8):x}}}", m.end()
    if c == "C" or c in "123456789kXRZGhHvVNeo" or c == "z" and in_class:
        if c == "v":
            return r"\x0B", k + 2
        raise BadPattern(f"\\{c} is not part of the syntax")
    if c == "Q":
        end = pattern.find(r"\E", k + 2)
        literal = pattern[k + 2 : end if end >= 0 else len(pattern)]
        return "".join("\\" + x if not x.isalnum() else x for x in literal), end + 2 if end >= 0 else len(pattern)
    if c in "pP":
        m = re.compile(r"\^?\w|\{\^?\w+\}").match(pattern, k + 2)
        if not m:
            raise BadPattern("bad character class name")
        name, flip = m[0].strip("{}"), c
        if name.startswith("^"):
            name, flip = name[1:], "P" if c == "p" else "p"
        return f"\\{flip}{{{name if len(name) <= 2 else 'Is' + name}}}", m.end()
    if c == "x":
        m = re.compile(r"x(?:([0-9a-fA-F]{2})|\{([0-9a-fA-F]+)\})").match(pattern, k + 1)
        if not m:
            raise BadPattern("bad \\x escape")
        return f"\\x{{{m[1] or m[2]}}}", m.end()
    if c.isalpha() and c not in "dDwWbBAztnrfa":
        raise BadPattern(f"\\{c} is not part of the syntax")
    return pattern[k : k + 2], k + 2


def to_java(pattern: str) -> str:
    """The Java pattern of a whole-value match; BadPattern for what the language rejects."""
    out, k, in_class, open_groups = [], 0, False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            piece, k = _escape(pattern, k, in_class)
            out.append(piece)
        elif in_class:
            if c == "[":
                m = re.compile(r"\[:(\^?)(\w+):\]").match(pattern, k)
                if m and m[2] not in POSIX:
                    raise BadPattern(f"unknown class {m[0]}")
                if m and m[1]:
                    out.append(f"[^{POSIX[m[2]]}]")
                else:
                    out.append(POSIX[m[2]] if m else r"\[")
                k = m.end() if m else k + 1
            elif c == "]" and k > class_start:
                in_class = False
                out.append("]")
                k += 1
            else:
                out.append("\\" + c if c in "&[]" else c)
                k += 1
        elif c == "[":
            in_class = True
            negated = pattern.startswith("[^", k)
            out.append("[^" if negated else "[")
            k += 2 if negated else 1
            class_start = k  # a bracket here is an ordinary character
        elif c == "(":
            m = re.compile(r"\((?:\?(?:P?<(\w+)>|([imsU]*(?:-[imsU]+)?)([:)])))?").match(pattern, k)
            if pattern.startswith("(?", k) and m.end() == k + 1:
                raise BadPattern("group is not part of the syntax")
            if m[1]:
                out.append(f"(?<{m[1].replace('_', 'U')}{len(out)}>")
            elif m[3] is not None:
                if "U" in m[2]:
                    raise BadPattern("ungreedy flag isn't supported")
                out.append(f"(?{m[2]}{m[3]}")
            else:
                out.append("(")
            open_groups += m[3] != ")"
            k = m.end()
        elif c == ")":
            open_groups -= 1
            if open_groups < 0:
                raise BadPattern("unexpected )")
            out.append(c)
            k += 1
        elif c in "*+?" or c == "{" and re.compile(r"\{\d+(,\d*)?\}").match(pattern, k):
            m = re.compile(r"[*+?]\??|\{(\d+)(?:,(\d*))?\}\??").match(pattern, k)
            if m[1] and max(int(x) for x in m.groups() if x) > 1000 or m[1] and m[2] and int(m[2]) < int(m[1]):
                raise BadPattern("bad repeat count")
            if not out or out[-1] == "|" or out[-1].startswith("(") or re.match(r"[*+?{]", pattern[m.end() :]) and (pattern[m.end()] != "{" or re.match(r"\{\d", pattern[m.end() :])):
                raise BadPattern("nothing to repeat")
            out.append(m[0])
            k = m.end()
        else:
            out.append(r"\{" if c == "{" else r"\}" if c == "}" else c)
            k += 1
    if in_class or open_groups:
        raise BadPattern("unclosed bracket or group")
    found = rf"(?d)\A(?:{''.join(out)})\z"
    if not _compiles(found):
        raise BadPattern("bad pattern")
    return found


def glob_to_java(glob: str) -> str | None:
    """The Java pattern of a shell glob whose wildcards don't match a slash; None if the glob is malformed."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            m = re.compile(r"\[(\^?)((?:\\.|[^\]\\])+)\]", re.DOTALL).match(glob, k)
            if not m:
                return None
            out.append(f"[{m[1]}{re.sub(r'([&\[])', r'\\\1', m[2])}&&[^/]]" if m[1] else f"[{re.sub(r'([&\[])', r'\\\1', m[2])}]")
            k = m.end() - 1
        elif c == "\\":
            k += 1
            if k >= len(glob):
                return None
            out.append(re.escape(glob[k]))
        else:
            out.append(re.escape(c))
        k += 1
    found = rf"(?s)\A(?:{''.join(out)})\z"
    return found if _compiles(found) else None
