"""Log rules are written in a linear-time dialect; this reads it and writes Java regular expressions that match the same.

The dialect has no look-around and no back references; `$` is the end of the text, `\\s`, `\\b` and the like know ASCII
only, names of groups may begin with a digit, counts end at 1000. Nothing of a pattern is copied: every part is
written anew, so that no character means something else in Java. Java goes back on its steps where the dialect doesn't: a
pattern like `(a+)+$` can take long there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

TOP = 0x10FFFF
#: ASCII classes by name, as ranges.
POSIX = {
    "alnum": "09AZaz", "alpha": "AZaz", "ascii": "\x00\x7f", "blank": "\t\t  ", "cntrl": "\x00\x1f\x7f\x7f", "digit": "09", "graph": "!~", "lower": "az", "print": " ~",
    "punct": "!/:@[`{~", "space": "\t\r  ", "upper": "AZ", "word": "09AZ__az", "xdigit": "09AFaf",
}
PERL = {"d": "09", "s": "\t\n\f\r  ", "w": "09AZ__az"}
#: General categories, and what `C` holds without unassigned code points.
CATEGORIES = "L Lu Ll Lt Lm Lo M Mn Mc Me N Nd Nl No P Pc Pd Ps Pe Pi Pf Po S Sm Sc Sk So Z Zs Zl Zp Cc Cf Cs Co".split()
OTHER, NOT_OTHER = r"\p{Cc}\p{Cf}\p{Cs}\p{Co}", r"\p{L}\p{M}\p{N}\p{P}\p{S}\p{Z}\p{Cn}"
ESCAPES = {"a": "\a", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_JAVA_NAME = re.compile("[A-Za-z][A-Za-z0-9]*")
_WORD = "[0-9A-Za-z_]"
_BREAK = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NO_BREAK = rf"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"


class BadPattern(ValueError):
    """The dialect does not compile this pattern."""


@dataclass
class Part:
    """A piece of the result: its Java form, whether it can match nothing, the class items if it is one character of a list, its
    repeats (least, most), what it consists of, whether it is one character of any kind, and a text that every match holds."""

    java: str
    empty: bool = False
    items: str | None = None
    times: tuple[int, int] | None = None
    parts: list[Part] = field(default_factory=list)
    single: bool = False
    needs: str = ""


@dataclass(frozen=True)
class Compiled:
    java: str
    groups: int
    names: dict[str, int]
    empty: bool
    #: A character that every match holds, or ''.
    needs: str

    @property
    def replacing(self) -> str:
        """The form for replacements: an empty match right behind a match doesn't count, and isn't tried longer."""
        return rf"(?>{self.java})(?:(?!\G)|\A)" if self.empty else self.java


def _char(c: str) -> str:
    return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):X}}}"


def _ranges(pairs: str) -> list[tuple[int, int]]:
    return sorted((ord(pairs[i]), ord(pairs[i + 1])) for i in range(0, len(pairs), 2))


def _items(ranges: list[tuple[int, int]], negated: bool) -> str:
    if negated:
        edges = [-1, *(x for r in ranges for x in r), TOP + 1]
        ranges = [(a + 1, b - 1) for a, b in zip(edges[::2], edges[1::2]) if a + 1 <= b - 1]
    return "".join(_char(chr(a)) if a == b else f"{_char(chr(a))}-{_char(chr(b))}" for a, b in ranges)


class Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.flags = {"i": False, "m": False, "s": False, "U": False}
        self.count, self.names = 0, {}

    # -- small steps

    def take(self, s: str) -> bool:
        if self.text.startswith(s, self.at):
            self.at += len(s)
            return True
        return False

    def more(self) -> bool:
        return self.at < len(self.text)

    def next(self) -> str:
        if not self.more():
            raise BadPattern("unexpected end")
        self.at += 1
        return self.text[self.at - 1]

    def folded(self, java: str) -> str:
        return f"(?iu:{java})" if self.flags["i"] else java

    def one_of(self, items: str, negated: bool = False) -> Part:
        """A character of a class, or none of it."""
        if not items:  # nothing is in it, or everything
            return Part("(?s:.)" if negated else r"(?!)", items=None)
        java = self.folded(f"[{'^' if negated else ''}{items}]")
        return Part(java, items=None if negated or self.flags["i"] else items, single=True)

    # -- escapes and classes

    def escape(self) -> str:
        """The character of an escape, the backslash being taken."""
        c = self.next()
        if c in "01234567":
            if c != "0" and not (self.more() and self.text[self.at] in "01234567"):
                raise BadPattern("back reference")
            digits = c
            while len(digits) < 3 and self.more() and self.text[self.at] in "01234567":
                digits += self.next()
            return chr(int(digits, 8))
        if c == "x":
            if self.take("{"):
                end = self.text.find("}", self.at)
                code, self.at = self.text[self.at : max(end, 0)], end + 1
            else:
                code = self.next() + self.next()
            if not re.fullmatch("[0-9A-Fa-f]+", code) or int(code, 16) > TOP:
                raise BadPattern("bad code point")
            return chr(int(code, 16))
        if c in ESCAPES:
            return ESCAPES[c]
        if c.isascii() and not c.isalnum():
            return c
        raise BadPattern(f"bad escape {c!r}")

    def shorthand(self) -> str | None:
        r"""The items of \d, \S, \pL, \P{Greek} and the like, if one stands here."""
        c = self.text[self.at + 1 : self.at + 2] if self.text.startswith("\\", self.at) else ""
        if c and c.lower() in PERL:
            self.at += 2
            return _items(_ranges(PERL[c.lower()]), c.isupper())
        if c not in ("p", "P"):
            return None
        self.at += 2
        negated, name = c == "P", self.next()
        if name == "{":
            end = self.text.find("}", self.at)
            if end < 0:
                raise BadPattern("bad Unicode class")
            name, self.at = self.text[self.at : end], end + 1
            if name.startswith("^"):
                negated, name = not negated, name[1:]
        if name == "Any":
            return "" if negated else _items([(0, TOP)], False)
        if name == "C":
            return NOT_OTHER if negated else OTHER
        if name not in CATEGORIES and not re.fullmatch("[A-Z][a-z]+(_[A-Z][a-z]+)*", name):
            raise BadPattern(f"unknown class {name!r}")
        return f"\\{'P' if negated else 'p'}{{{name if name in CATEGORIES else 'script=' + name}}}"

    def bracket(self) -> Part:
        """A class in brackets, the opening one being taken."""
        negated, items, first = self.take("^"), [], True
        while first or not self.text.startswith("]", self.at):
            first = False
            if not self.more():
                raise BadPattern("missing ]")
            if self.text.startswith("[:", self.at) and (end := self.text.find(":]", self.at + 2)) >= 0:
                name = self.text[self.at + 2 : end]
                if name.removeprefix("^") not in POSIX:
                    raise BadPattern(f"unknown class {name!r}")
                items.append(_items(_ranges(POSIX[name.removeprefix("^")]), name.startswith("^")))
                self.at = end + 2
                continue
            if (short := self.shorthand()) is not None:
                items.append(short)
                continue
            low = high = self.class_char()
            if self.text.startswith("-", self.at) and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                high = self.class_char()
                if high < low:
                    raise BadPattern("bad range")
            items.append(_items([(ord(low), ord(high))], False))
        self.at += 1
        return self.one_of("".join(items), negated)

    def class_char(self) -> str:
        if not self.more():
            raise BadPattern("missing ]")
        c = self.next()
        return self.escape() if c == "\\" else c

    # -- repeats

    def count_at(self) -> tuple[int, int] | None:
        """(least, most) of a {n,m} that begins here and its end taken; most is -1 for none. None if it is plain text."""
        m = re.compile(r"\{(0|[1-9][0-9]*)(,(0|[1-9][0-9]*)?)?\}").match(self.text, self.at)
        if not m:
            return None
        low = int(m[1])
        high = low if m[2] is None else int(m[3]) if m[3] else -1
        if max(low, high) > 1000 or 0 <= high < low:
            raise BadPattern("bad repeat count")
        self.at = m.end()
        return low, high

    def repeated(self, part: Part, low: int, high: int, sign: str) -> Part:
        lazy = self.take("?") != self.flags["U"]
        java = f"{part.java if part.single else f'(?:{part.java})'}{sign}{'?' if lazy else ''}"
        out = Part(java, part.empty or low == 0, None, (low, high) if sign[0] == "{" else None, [part], needs=part.needs if low else "")
        if max(low, high) >= 2 and sign[0] == "{" and not _within(out, 1000):
            raise BadPattern("repeat counts multiply to over 1000")
        return out

    # -- the whole

    def atom(self) -> Part:
        c = self.next()
        if c == ".":
            return Part("(?s:.)" if self.flags["s"] else "[^\\n]", single=True)
        if c == "[":
            return self.bracket()
        if c == "^":
            return Part(r"(?:\A|(?<=\n))" if self.flags["m"] else r"\A", True)
        if c == "$":
            return Part(r"(?:(?=\n)|\z)" if self.flags["m"] else r"\z", True)
        if c == "\\":
            if not self.more():
                raise BadPattern("backslash at the end")
            kind = self.text[self.at]
            if kind in "AzbB":
                self.at += 1
                return Part({"A": r"\A", "z": r"\z", "b": _BREAK, "B": _NO_BREAK}[kind], True)
            self.at -= 1
            if (short := self.shorthand()) is not None:
                return self.one_of(short)
            self.at += 1
            c = self.escape()
        return self.literal(c)

    def literal(self, c: str) -> Part:
        plain = not self.flags["i"]
        return Part(self.folded(_char(c)), items=_char(c) if plain else None, single=True, needs=c if plain else "")

    def group(self) -> tuple[str, dict] | None:
        """What an opening bracket, taken, opens: (Java form, flags outside), or None for flags alone."""
        outside = dict(self.flags)
        if not self.take("?"):
            self.count += 1
            return "(", outside
        if m := re.compile(r"P?<([^>]*)>").match(self.text, self.at):
            if not re.fullmatch("[0-9A-Za-z_]+", m[1]) or m[1] in self.names:
                raise BadPattern("bad group name")
            self.at = m.end()
            self.count += 1
            self.names[m[1]] = self.count
            return f"(?<{m[1]}>" if _JAVA_NAME.fullmatch(m[1]) else "(", outside
        m = re.compile(r"([imsU]*)(-[imsU]+)?([:)])").match(self.text, self.at)
        if not m:
            raise BadPattern("unknown group")
        self.at = m.end()
        self.flags |= dict.fromkeys(m[1], True) | dict.fromkeys((m[2] or "-")[1:], False)
        return ("(?:", outside) if m[3] == ":" else None

    def read(self) -> Part:
        open_groups: list[tuple[str, dict, list[list[Part]]]] = []
        branches: list[list[Part]] = [[]]
        was_repeat = False
        while self.more():
            c, repeat = self.text[self.at], was_repeat
            was_repeat, now = False, branches[-1]
            if c == "(":
                self.at += 1
                if opened := self.group():
                    open_groups.append((*opened, branches))
                    branches = [[]]
            elif c == ")":
                if not open_groups:
                    raise BadPattern("unexpected )")
                self.at += 1
                inner = _any_of(branches)
                java, self.flags, branches = open_groups.pop()
                bare = java == "(?:" and inner.single
                branches[-1].append(inner if bare else Part(f"{java}{inner.java})", inner.empty, None, None, [inner], needs=inner.needs))
            elif c == "|":
                self.at += 1
                branches.append([])
            elif c in "*+?" or (c == "{" and (count := self.count_at())):
                low, high = {"*": (0, -1), "+": (1, -1), "?": (0, 1)}[c] if c != "{" else count
                self.at += c != "{"
                if repeat or not now:
                    raise BadPattern("nothing to repeat")
                sign = c if c != "{" else f"{{{low}}}" if low == high else f"{{{low},{'' if high < 0 else high}}}"
                now[-1] = self.repeated(now[-1], low, high, sign)
                was_repeat = True
            elif self.take("\\Q"):
                end = self.text.find("\\E", self.at)
                stop = len(self.text) if end < 0 else end
                now += map(self.literal, self.text[self.at : stop])
                self.at = stop + 2 * (end >= 0)
            else:
                now.append(self.atom())
        if open_groups:
            raise BadPattern("missing )")
        return _any_of(branches)


def _within(part: Part, limit: int) -> bool:
    """Do nested counts multiply to at most `limit`?"""
    todo = [(part, limit)]
    while todo:
        p, n = todo.pop()
        if p.times:
            low, high = p.times
            if high == 0:
                continue
            most = low if high < 0 else high
            if most > n:
                return False
            n = n // most if most > 0 else n
        todo += [(x, n) for x in p.parts]
    return True


def _any_of(branches: list[list[Part]]) -> Part:
    """Branches of parts in a row; single characters become one class, for which Java needs no stack."""
    parts = [p for b in branches for p in b]
    if len(branches) > 1 and all(len(b) == 1 and b[0].items is not None for b in branches):
        items = "".join(b[0].items for b in branches)
        return Part(f"[{items}]", items=items, single=True)
    if len(parts) == 1 and len(branches) == 1:
        return parts[0]
    needs = min((p.needs for p in parts if p.needs and len(branches) == 1), key=str.isalnum, default="")
    return Part("|".join("".join(p.java for p in b) for b in branches), any(all(p.empty for p in b) for b in branches), None, None, parts, needs=needs)


@lru_cache(maxsize=1000)
def compiled(pattern: str) -> Compiled:
    """Read a pattern; BadPattern if the dialect refuses it."""
    reader = Reader(pattern)
    part = reader.read()
    return Compiled(part.java, reader.count, reader.names, part.empty, part.needs)


def to_java(pattern: str) -> str | None:
    """The Java form, or None for a pattern the dialect would not compile, or an empty one. What the dialect takes and Java
    doesn't know, like a script of a later Unicode version, fails the job."""
    try:
        return compiled(pattern).java if pattern else None
    except BadPattern:
        return None


def replacement(text: str, pattern: str) -> str:
    """The Java form of a replacement: $1 and ${name} stand for groups, $1x names the group '1x', unknown groups are empty,
    $$ is a dollar sign, a $ before anything else and backslashes are plain."""
    known = compiled(pattern)
    out, at, after_group = [], 0, False

    def plain(s: str) -> str:
        s = s.replace("\\", "\\\\").replace("$", r"\$")
        return "\\" + s if after_group and s[:1].isdigit() else s

    for m in re.finditer(r"\$(?:\{(\w+)\}|(\w+)|(\$))", text):
        if m.start() > at:
            out.append(plain(text[at : m.start()]))
            after_group = False
        at = m.end()
        name = m[1] or m[2]
        if m[3]:
            out.append(r"\$")
            after_group = False
            continue
        if name in known.names and _JAVA_NAME.fullmatch(name):
            out.append(f"${{{name}}}")
            after_group = False
            continue
        number = int(name) if re.fullmatch("0|[1-9][0-9]{0,7}", name) else known.names.get(name, -1)
        if 0 <= number <= known.groups:
            out.append(f"${number}")
            after_group = True
    return "".join([*out, plain(text[at:])])
