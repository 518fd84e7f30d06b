"""Regular expressions: dialect, named groups, one-pass capture."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

_SEP = "\u0001"

# Named classes inside brackets, as ASCII ranges.
POSIX_CLASSES = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
_POSIX = re.compile(r"\[:(\^?)([a-z]+):\]")
_FLAGS = re.compile(r"\(\?([a-zA-Z]*(?:-[a-zA-Z]+)?)([:)])")
_NAMED = re.compile(r"\(\?P?<([A-Za-z_][A-Za-z0-9_.\[\]]*)>")
_REPEAT = re.compile(r"(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})\??")
_CODE = re.compile(r"\\(?:[xuU]\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8}))")
_PROPERTY = re.compile(r"\\[pP](?:\{[^}]*\}|[A-Za-z])")
# Letters that may follow a backslash, apart from codes and properties.
_LETTER_ESCAPES = "aftnrvdDsSwWbBAz"


@dataclass(frozen=True)
class Pattern:
    """A Java pattern with numbered groups; ``names[i]`` names group ``numbers[i]``."""

    java: str
    names: tuple[str, ...]
    numbers: tuple[int, ...]
    groups: int
    optional: frozenset[str]


def translate(pattern: str, ignore_case: bool = False) -> Pattern:
    """Java form of a pattern written in the dialect of the rules.

    Named groups become numbered (Java refuses underscores in names), ``.`` stops
    at ``\\n`` only, ``$`` means the very end (the end of a line under the flag ``m``, which groups
    may set and take back), ``\\w \\d \\s \\b`` are Unicode, ``[[:alpha:]]`` and its kin are ASCII. Classes may be
    taken from one another (``--``), cut (``&&``) and told apart (``~~``); a repetition after a repetition repeats
    it. The dialect has no look-around, back-references or possessive and atomic forms.
    Raises ``re.error``-like ValueError when the pattern does not compile or has one of these.
    """
    names, numbers, group, unicode_classes = [], [], 0, ignore_case
    # Pieces in Java's spelling, and in the standard library's to see which groups are optional.
    out, plain = [], []
    multi, outer = False, []  # whether $ and ^ stop at lines here; the same of the groups around, and where they start
    atom, repeated = 0, False  # where the piece before starts, and whether it is a repetition
    i = 0

    def add(java: str, check: str) -> None:
        nonlocal atom, repeated
        atom, repeated = len(out), False
        out.append(java)
        plain.append(check)

    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            java, end = _escape(pattern, i)
            unicode_classes |= pattern[i + 1] in "wWdDsSbB"
            add(java, {"b": "\\b", "B": "\\B", "A": "\\A", "z": "\\Z"}.get(pattern[i + 1], "a"))
            i = end
        elif ch == "[":
            java, end = _char_class(pattern, i)
            unicode_classes |= re.search(r"(?<!\\)(?:\\\\)*\\[wWdDsS]", pattern[i:end]) is not None
            add(java, "a")
            i = end
        elif m := _REPEAT.match(pattern, i):
            if repeated:
                out[atom:] = ["(?:" + "".join(out[atom:]) + ")"]
                plain[atom:] = ["(?:" + "".join(plain[atom:]) + ")"]
            out.append(m[0])
            plain.append(m[0])
            repeated = True
            i = m.end()
        elif m := _NAMED.match(pattern, i):
            group += 1
            names.append(m[1])
            numbers.append(group)
            outer.append((multi, len(out)))
            add("(", "(")
            i = m.end()
        elif m := _FLAGS.match(pattern, i):
            on, _, off = m[1].partition("-")
            if "U" in on + off or "R" in on + off:
                raise ValueError(f"invalid regex {pattern!r}: flag of {m[0]} is not supported")
            if m[2] == ":":
                outer.append((multi, len(out)))
            multi = (multi or "m" in on) and "m" not in off
            # Unicode is the default of the dialect; in Java the letter means case folding only.
            kept = on.replace("u", ""), off.replace("u", "")
            text = kept[0] + ("-" + kept[1] if kept[1] else "")
            add(f"(?{text}{m[2]}" if text or m[2] == ":" else "", "(?:" if m[2] == ":" else "")
            i = m.end()
        elif pattern.startswith("(?", i):
            raise ValueError(f"invalid regex {pattern!r}: {pattern[i : i + 4]} is not of the dialect")
        else:
            if ch == "(":
                group += 1
                outer.append((multi, len(out)))
            add("\\z" if ch == "$" and not multi else ch, "\\Z" if ch == "$" else "\\{" if ch == "{" else ch)
            if ch == ")" and outer:
                multi, atom = outer.pop()
            i += 1
    flags = "(?d" + ("U" if unicode_classes else "") + ("iu" if ignore_case else "") + ")"
    try:
        loose = _optional_groups("".join(plain))
    except re.error as e:
        raise ValueError(f"invalid regex {pattern!r}: {e}") from e
    optional = frozenset(name for name, number in zip(names, numbers) if number in loose)
    return Pattern(flags + "".join(out), tuple(names), tuple(numbers), group, optional)


def _escape(pattern: str, i: int) -> tuple[str, int]:
    """Java form of the escape at ``i``, and where it ends."""
    if m := _CODE.match(pattern, i):
        return "\\x{" + (m[1] or m[2] or m[3] or m[4]) + "}", m.end()
    if m := _PROPERTY.match(pattern, i):
        return m[0], m.end()
    c = pattern[i + 1 : i + 2]
    if not c or c.isdigit() or (c.isalpha() and c not in _LETTER_ESCAPES):
        raise ValueError(f"invalid regex {pattern!r}: \\{c} is not of the dialect")
    return "\\x0B" if c == "v" else "\\" + c, i + 2


def _char_class(pattern: str, i: int) -> tuple[str, int]:
    """Java form of the class that opens at ``i``, and where it ends.

    Operators have equal rank and go from left to right; what stands side by side is joined first.
    """
    i += 1
    negated = pattern.startswith("^", i)
    i += negated
    left, operator, items = None, "", []

    def both() -> str:
        right = "".join(items) or "&&[^\\x{0}-\\x{10FFFF}]"  # nothing stands there: the empty class
        if left is None:
            return right
        if operator == "&&":
            return f"[{left}]&&[{right}]"
        if operator == "--":
            return f"[{left}]&&[^[{right}]]"
        return f"[[{left}]&&[^[{right}]]][[{right}]&&[^[{left}]]]"

    while pattern.startswith("-", i):  # signs at the beginning are themselves
        items.append("\\-")
        i += 1
    if not items and pattern.startswith("]", i):
        items.append("\\]")
        i += 1
    while i < len(pattern):
        two = pattern[i : i + 2]
        if pattern[i] == "]":
            body = both()
            return (f"[^[{body}]]" if negated and left is not None else f"[{'^' * negated}{body}]"), i + 1
        if two in ("&&", "--", "~~"):
            left, operator, items = both(), two, []
            i += 2
        elif m := _POSIX.match(pattern, i):
            ranges = POSIX_CLASSES.get(m[2])
            if ranges is None:
                raise ValueError(f"invalid regex {pattern!r}: unknown class {m[0]}")
            items.append(f"[^{ranges}]" if m[1] else ranges)
            i = m.end()
        elif pattern[i] == "[":
            inner, i = _char_class(pattern, i)
            items.append(inner)
        elif pattern[i] == "\\":
            escape, i = _escape(pattern, i)
            items.append(escape)
        else:
            items.append(pattern[i])
            i += 1
    raise ValueError(f"invalid regex {pattern!r}: a class is not closed")


def _optional_groups(pattern: str) -> set[int]:
    """Groups that may stay out of a match (under ``?``, ``*`` or ``|``)."""
    tree = re._parser.parse(pattern)  # the standard library's own reader; nothing is matched here
    found: set[int] = set()

    def walk(nodes, loose: bool) -> None:
        for op, arg in nodes:
            name = str(op)
            if name == "SUBPATTERN":
                if loose and arg[0]:
                    found.add(arg[0])
                walk(arg[3], loose)
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                walk(arg[2], loose or arg[0] == 0)
            elif name == "BRANCH":
                for branch in arg[1]:
                    walk(branch, True)

    walk(tree, False)
    return found


def search(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Unanchored match in the dialect of the rules."""
    return c.rlike(translate(pattern, ignore_case).java)


def captures(c: Column, java: str, layout: list[int | str]) -> Column:
    """Pieces of a match as ``ARRAY<STRING>``; element ``i`` is ``layout[i - 1]``: a group or fixed text.

    The pattern runs once per value, not once per group: a replace writes the
    pieces next to each other and a split takes them apart. ``java`` must match
    the whole value (``\\A…\\z``). A value that itself holds the separator
    is taken group by group. Ask ``matched`` whether there was a match.
    """
    template = "".join(f"{_SEP}${x}" if isinstance(x, int) else f"{_SEP}{x}" for x in layout)
    quick = F.split(F.regexp_replace(c, java, template), _SEP, -1)
    texts = F.array(*[F.lit("" if isinstance(x, int) else x) for x in layout])
    groups = F.array(*[F.lit(x if isinstance(x, int) else -1) for x in layout])

    def piece(group: Column, i: Column) -> Column:
        return F.when(group < 0, F.get(texts, i)).otherwise(F.call_function("regexp_extract", c, F.lit(java), group))

    slow = F.when(c.rlike(java), F.concat(F.array(F.lit("")), F.transform(groups, piece)))
    return F.when(F.contains(c, F.lit(_SEP)), slow).otherwise(quick)


def matched(caps: Column, layout: list[int | str]) -> Column:
    """Whether ``captures`` found the pattern."""
    return F.coalesce(F.size(caps) == len(layout) + 1, F.lit(False))


def whole(java: str) -> str:
    """Pattern for the whole value whose groups are those of the first match of ``java``."""
    m = re.match(r"\(\?([a-zA-Z]*)\)", java)
    flags, body = (m.group(1), java[m.end() :]) if m else ("", java)
    inner = f"(?{flags}:{body})" if flags else f"(?:{body})"
    return rf"\A(?s:.*?){inner}(?s:.*)\z"
