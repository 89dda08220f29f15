"""Which elements the style sheets of a page hide: the cascade of ``display`` and ``visibility``.

Sheets are read with their blocks (media, supports, layers, nested rules), selectors are matched in the tree, and the
last of the most specific declarations decides, important ones first. Media are those of a screen (``SCREEN``,
``KEYWORDS``); states that need a user (hover, focus, target) never match.
"""

from __future__ import annotations

import re
from itertools import islice
from typing import Callable, Iterator

#: The screen that media queries are asked about: pixels, dots an inch, bits.
SCREEN = {"width": 1280, "height": 800, "device-width": 1280, "device-height": 800, "aspect-ratio": 1.6,
          "device-aspect-ratio": 1.6, "resolution": 96, "device-pixel-ratio": 1, "color": 8, "color-index": 0,
          "monochrome": 0, "grid": 0, "inline-size": 1280, "block-size": 800}
KEYWORDS = {"orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine",
            "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference",
            "prefers-reduced-transparency": "no-preference", "prefers-reduced-data": "no-preference", "forced-colors": "none",
            "inverted-colors": "none", "scripting": "enabled", "update": "fast", "display-mode": "browser",
            "overflow-block": "scroll", "overflow-inline": "scroll", "color-gamut": "srgb", "dynamic-range": "standard",
            "video-dynamic-range": "standard"}
_UNITS = {"": 1, "px": 1, "em": 16, "rem": 16, "ex": 8, "ch": 8, "in": 96, "cm": 96 / 2.54, "mm": 96 / 25.4, "pt": 4 / 3,
          "pc": 16, "vw": 12.8, "vh": 8, "dpi": 1, "dpcm": 2.54, "dppx": 96, "x": 96}
_DISPLAY = frozenset("none block inline inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell "
                     "table-row-group table-header-group table-footer-group table-column table-column-group table-caption "
                     "list-item run-in contents flow flow-root ruby ruby-base ruby-text math box inherit initial unset revert "
                     "revert-layer".split())
_VISIBILITY = frozenset("visible hidden collapse inherit initial unset revert revert-layer".split())

_LITERAL = re.compile(r"""/\*.*?(?:\*/|\Z)|("(?:[^"\\\n]++|\\.)*+"?|'(?:[^'\\\n]++|\\.)*+'?)|url\(\s*+[^"'()\s][^)]*+\)|<!--|-->"""
                      r"""|<!\[CDATA\[|\]\]>""", re.S)
_STOP = re.compile(r"[{};]")
_DECLARATION = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)((?:\s+[a-z-]+)*)\s*(!\s*important)?\s*\Z", re.I)
_IDENT = r"(?:\\[0-9a-fA-F]{1,6}\s?|\\.|[\w-]|[^\x00-\x7f])+"
_PART = re.compile(rf"""(?P<tag>(?:(?:{_IDENT}|\*)?\|)?(?:{_IDENT}|\*))|\#(?P<id>{_IDENT})|\.(?P<cls>{_IDENT})|(?P<up>&)"""
                   rf"""|\[\s*(?P<name>{_IDENT})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>"\d+"|{_IDENT})\s*(?P<case>[iIsS])?\s*)?\]"""
                   rf"""|::(?P<element>{_IDENT}(?:\([^)]*\))?)|:(?P<pseudo>{_IDENT})(?P<call>\()?""")
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", re.S)
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*\Z", re.I)


def _plain(ident: str) -> str:
    if "\\" not in ident:
        return ident
    return _ESCAPE.sub(lambda m: m[2] or (chr(int(m[1], 16)) if 0 < int(m[1], 16) < 0x110000 else "\ufffd"), ident)


def _split(text: str) -> list[str]:
    """Parts between the commas outside of brackets."""
    out, depth, at = [], 0, 0
    for m in re.finditer(r"[()\[\],]", text):
        if m[0] in "([":
            depth += 1
        elif m[0] in ")]":
            depth -= 1
        elif not depth:
            out.append(text[at:m.start()])
            at = m.end()
    return [*out, text[at:]]


def _closing(text: str, at: int) -> int:
    """The place of the bracket that closes the one before ``at``."""
    depth = 1
    for m in re.compile(r"[()]").finditer(text, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.start()
    return len(text)


# ------------------------------------------------------------------ media
def _number(text: str) -> float | None:
    if m := re.fullmatch(r"\s*([+-]?(?:\d+\.?\d*|\.\d+))\s*/\s*(\d+\.?\d*|\.\d+)\s*", text):
        return float(m[1]) / float(m[2]) if float(m[2]) else None
    m = re.fullmatch(r"\s*([+-]?(?:\d+\.?\d*|\.\d+))([a-z]*)\s*", text)
    return float(m[1]) * _UNITS[m[2]] if m and m[2] in _UNITS else None


def _feature(text: str) -> bool | None:
    """Whether a screen has a media feature; none if it is not known."""
    text = text.strip()
    if m := re.fullmatch(r"(?:-webkit-|-moz-|-o-)?(?:(min|max)-+(?:-moz-)?)?([a-z-]+)\s*(?::(.*))?", text, re.S):
        bound, name, value = m[1], m[2], m[3]
        if name in SCREEN:
            if value is None:
                return None if bound else SCREEN[name] != 0
            asked = _number(value)
            if asked is None:
                return None
            return SCREEN[name] >= asked if bound == "min" else SCREEN[name] <= asked if bound else SCREEN[name] == asked
        if name in KEYWORDS and not bound:
            return KEYWORDS[name] not in ("none", "no-preference") if value is None else KEYWORDS[name] == value.strip()
        return None
    parts = re.split(r"(<=|>=|<|>|=)", text)
    if len(parts) not in (3, 5):
        return None
    sides = [SCREEN[x.strip()] if x.strip() in SCREEN else _number(x) for x in parts[::2]]
    if None in sides:
        return None
    holds = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
             "=": lambda a, b: a == b}
    return all(holds[op](a, b) for op, a, b in zip(parts[1::2], sides, sides[1:]))


def _condition(text: str, feature: Callable[[str], bool | None]) -> bool | None:
    """The value of features in brackets under not, and, or; none if it hangs on an unknown one."""
    values, words, at = [], [], 0
    for _ in range(len(text)):
        m = re.compile(r"\s*(?:(not|and|or)\b\s*|([a-z-]*)\()", re.I).match(text, at)
        if not m:
            break
        if m[1]:
            words.append(m[1].lower())
            at = m.end()
            continue
        stop = _closing(text, m.end())
        inner = text[m.end():stop]
        value = (_condition(inner, feature) if not m[2] and re.match(r"\s*(\(|not\b|[a-z-]+\()", inner) else feature(inner))
        if words and words[-1] == "not":
            words.pop()
            value = None if value is None else not value
        values.append(value)
        at = stop + 1
    if text[at:].strip() or not values or len(words) != len(values) - 1 or len(set(words)) > 1:
        return None
    if "or" in words:
        return True if True in values else None if None in values else False
    return False if False in values else None if None in values else True


def on_screen(queries: str) -> bool:
    """Whether a list of media queries holds for the screen."""
    def one(query: str) -> bool:
        query = query.strip().lower()
        m = re.fullmatch(r"(?:(not|only)\s+)?([a-z-]+)(?:\s+and\b\s*(.+))?", query, re.S)
        if not m or m[2] in ("not", "only", "and", "or"):
            return _condition(query, _feature) is True
        holds, rest = m[2] in ("all", "screen"), _condition(m[3], _feature) if m[3] else True
        holds = False if not holds else rest
        return (holds is False) if m[1] == "not" else holds is True
    return not queries.strip() or any(map(one, _split(queries)))


# ------------------------------------------------------------------ selectors
class _Compound:
    #: ``walked``: nodes from which the places that ``joint`` leads to are known not to fit the compounds before.
    __slots__ = ("tag", "ids", "classes", "tests", "joint", "walked")

    def __init__(self):
        self.tag, self.ids, self.classes, self.tests, self.joint, self.walked = "", set(), set(), [], "", set()


def _never(node) -> bool:
    return False


def _after(node, same: bool = False) -> int:
    """How many siblings follow, or those of the same element."""
    if node.parent is None:
        return 0
    return node.parent.kins[node.tag] - 1 - node.kin if same else len(node.parent.elements) - 1 - node.place


def _nth(text: str, back: bool, same: bool) -> Callable:
    text, _, of = text.partition(" of ")
    m = _NTH.match(text)
    if not m or of:
        return _never
    if m[1]:
        a, b = 2, 1 if m[1].lower() == "odd" else 0
    elif m[5]:
        a, b = 0, int(m[5])
    else:
        a, b = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2]), int((m[3] or "+") + (m[4] or "0"))

    def test(node) -> bool:
        k = 1 + (_after(node, same) if back else node.kin if same else node.place)
        return k == b if not a else (k - b) % a == 0 and (k - b) // a >= 0
    return test


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Callable:
    def test(node) -> bool:
        own, asked = node.attrs.get(name), value
        if own is None or op is None:
            return own is not None
        if fold:
            own, asked = own.lower(), asked.lower()
        if op == "=":
            return own == asked
        if op == "~=":
            return asked in own.split()
        if op == "|=":
            return own == asked or own.startswith(asked + "-")
        return bool(asked) and (own.startswith(asked) if op == "^=" else own.endswith(asked) if op == "$=" else asked in own)
    return test


_STATES = {
    "root": lambda n: n.parent is None, "scope": lambda n: n.parent is None,
    "empty": lambda n: not any(x for x in n.children),
    "first-child": lambda n: n.place == 0, "last-child": lambda n: _after(n) == 0,
    "only-child": lambda n: n.place == 0 and _after(n) == 0, "only-of-type": lambda n: n.kin == 0 and _after(n, True) == 0,
    "first-of-type": lambda n: n.kin == 0, "last-of-type": lambda n: _after(n, True) == 0,
    "checked": lambda n: n.tag == "input" and "checked" in n.attrs or n.tag == "option" and "selected" in n.attrs,
    "disabled": lambda n: "disabled" in n.attrs,
    "enabled": lambda n: "disabled" not in n.attrs and n.tag in ("input", "button", "select", "textarea", "option", "fieldset"),
    "link": lambda n: n.tag in ("a", "area") and "href" in n.attrs, "any-link": lambda n: n.tag in ("a", "area") and "href" in n.attrs,
    "required": lambda n: "required" in n.attrs, "defined": lambda n: "-" not in n.tag,
    "open": lambda n: "open" in n.attrs,
}


class Selectors:
    """A selector list, read when first asked for; nested lists refer to the list around them."""

    def __init__(self, text: str, strings: list[str], up: "Selectors | None" = None, relative: bool = False):
        self.text, self.strings, self.up, self.relative, self._parsed = text, strings, up, relative, None

    @property
    def parsed(self) -> list[tuple[list[_Compound], tuple[int, int, int]]]:
        if self._parsed is None:
            try:
                self._parsed = [self._complex(x) for x in _split(self.text)]
            except (ValueError, RecursionError):
                self._parsed = []                     # one that is not valid makes the list void
        return self._parsed

    def weight(self) -> tuple[int, int, int]:
        return max((w for _, w in self.parsed), default=(0, 0, 0))

    def matches(self, node) -> bool:
        return any(matches(parts, node) for parts, _ in self.parsed)

    def _complex(self, text: str):
        text = text.strip()
        if self.up is not None and not self.relative and ("&" not in text or text[:1] in "+>~"):
            text = "& " + text
        parts, weight, at, joint = [], [0, 0, 0], 0, ""
        if self.relative:
            m = re.match(r"([>+~]?)\s*", text)
            joint, at = m[1] or " ", m.end()
        while at < len(text):
            one, start = _Compound(), at
            one.joint, joint = joint, ""
            while m := _PART.match(text, at):
                if m["tag"] and at != start:
                    raise ValueError(text)
                at = self._add(one, m, text, weight)
            if at == start:
                raise ValueError(text)
            parts.append(one)
            m = re.compile(r"\s*([>+~]?)\s*").match(text, at)
            joint = m[1] or (" " if m.end() > at else "")
            at = m.end()
            if at < len(text) and not joint:
                raise ValueError(text)
        if not parts or joint.strip():
            raise ValueError(text)
        return parts, tuple(weight)

    def _add(self, one: _Compound, m: re.Match, text: str, weight: list[int]) -> int:
        def heavier(by) -> None:
            weight[:] = [a + b for a, b in zip(weight, by)]
        if m["tag"]:
            name = _plain(m["tag"].rpartition("|")[2])
            if name != "*":
                one.tag = name.lower()
                heavier((0, 0, 1))
        elif m["id"]:
            one.ids.add(_plain(m["id"]))
            heavier((1, 0, 0))
        elif m["cls"]:
            one.classes.add(_plain(m["cls"]))
            heavier((0, 1, 0))
        elif m["up"]:
            one.tests.append(self.up.matches if self.up is not None else _STATES["root"])
            heavier(self.up.weight() if self.up is not None else (0, 0, 0))
        elif m["name"]:
            value = m["value"] or ""
            value = self.strings[int(value[1:-1])] if value[:1] == '"' else _plain(value)
            one.tests.append(_attribute(_plain(m["name"]).lower(), m["op"], value, (m["case"] or "").lower() == "i"))
            heavier((0, 1, 0))
        elif m["element"]:
            one.tests.append(_never)
        else:
            name, end, inner = m["pseudo"].lower(), m.end(), ""
            if m["call"]:
                stop = _closing(text, end)
                inner, end = text[end:stop], stop + 1
            if name in ("is", "where", "not", "matches", "any", "-webkit-any", "-moz-any", "has"):
                nested = Selectors(inner, self.strings, self.up, relative=True) if name == "has" else Selectors(inner, self.strings)
                if name not in ("has",) and "&" in inner:
                    nested.up, nested.text = self.up, ",".join(x if "&" in x else ":is(" + x + ")" for x in _split(inner))
                if name == "not":
                    if not nested.parsed:
                        raise ValueError(text)
                    one.tests.append(lambda n: not nested.matches(n))
                elif name == "has":
                    one.tests.append(lambda n: _has(nested, n))
                else:
                    one.tests.append(nested.matches)
                heavier((0, 0, 0) if name == "where" else nested.weight())
                return end
            if name.startswith("nth-"):
                one.tests.append(_nth(inner, "last" in name, name.endswith("of-type")))
            elif name in ("before", "after", "first-line", "first-letter"):
                one.tests.append(_never)
            else:
                one.tests.append(_STATES.get(name, _never))
            heavier((0, 1, 0))
            return end
        return m.end()


def _fits(one: _Compound, node) -> bool:
    return ((not one.tag or one.tag == node.tag) and (not one.ids or one.ids == {node.attrs.get("id")})
            and (not one.classes or one.classes <= set(node.attrs.get("class", "").split()))
            and all(test(node) for test in one.tests))


def _above(node) -> Iterator:
    while (node := node.parent) is not None:
        yield node


def _before(node) -> Iterator:
    return (node.parent.elements[i] for i in range(node.place - 1, -1, -1)) if node.parent else iter(())


def matches(parts: list[_Compound], node, top=None) -> bool:
    """Whether a chain of compounds fits, from the last one up; of a relative one (``top``) the first joint leads there."""
    def reach(one: _Compound, node) -> Iterator:
        if one.joint == ">":
            if node.parent is not None:
                yield node.parent
            return
        if one.joint == "+":
            yield from islice(_before(node), 1)
            return
        marks = [node]
        for i, x in enumerate(_above(node) if one.joint == " " else _before(node), 1):
            yield x
            if top is None and id(x) in one.walked:
                break
            if i % 32 == 0:
                marks.append(x)
        if top is None:
            one.walked.update(map(id, marks))              # asked for the next place: none of these led on
    if top is None and id(node) in parts[-1].walked:
        return False
    if not _fits(parts[-1], node):
        return False
    if len(parts) == 1 and top is None:
        return True
    # depth first over the places that each compound may fit, each place once
    seen, todo = set(), [(len(parts) - 1, reach(parts[-1], node))]
    while todo:
        k, places = todo[-1]
        found = next(places, None)
        if found is None:
            todo.pop()
            continue
        if k == 0:
            if found is top:
                return True
            continue
        if (k - 1, id(found)) in seen:
            continue
        seen.add((k - 1, id(found)))
        if _fits(parts[k - 1], found):
            if k == 1 and top is None:
                return True
            todo.append((k - 1, reach(parts[k - 1], found)))
    return False


def _has(nested: Selectors, node) -> bool:
    for parts, _ in nested.parsed:
        todo = list(node.parent.elements[node.place + 1:] if parts[0].joint in "+~" and node.parent else node.elements)
        while todo:
            x = todo.pop()
            if matches(parts, x, node):
                return True
            todo += x.elements
    return False


# ------------------------------------------------------------------ sheets
def declaration(text: str) -> tuple[str, str, bool] | None:
    """``property, value, important`` of a declaration of display or visibility that is valid."""
    if not (m := _DECLARATION.match(text.strip())):
        return None
    name, value = m[1].lower(), m[2].lower()
    valid = value in _VISIBILITY and not m[3] if name == "visibility" else value in _DISPLAY or value.startswith("-")
    return (name, value, bool(m[4])) if valid and not (value == "none" and m[3]) else None


def inline(text: str) -> list[tuple[str, str, bool]]:
    """The declarations of a style attribute."""
    if "display" not in text.lower() and "visibility" not in text.lower():
        return []
    text = _LITERAL.sub(" ", text)
    return [x for part in text.split(";") if (x := declaration(part))]


class Rules:
    """The declarations of display and visibility in a page's sheets, by what their selectors end in."""

    def __init__(self, sheets: list[str]):
        self.by_key: dict[str, list] = {}
        self.layers: dict[str, int] = {}
        self.count = 0
        for sheet in sheets:
            if re.search("display|visibility", sheet, re.I):
                self._read(sheet)

    def __bool__(self) -> bool:
        return bool(self.by_key)

    def _read(self, sheet: str) -> None:
        strings: list[str] = []

        def literal(m: re.Match) -> str:
            if not m[1]:
                return " " if m[0][:1] != "u" else "url()"
            body = m[1][1:]
            strings.append(_plain(body[:-1] if body[-1:] == m[1][0] else body))
            return f'"{len(strings) - 1}"'
        css, at = _LITERAL.sub(literal, sheet), 0
        stack: list[tuple[Selectors | None, bool, str]] = [(None, True, "")]      # selectors, in force, layer
        for m in _STOP.finditer(css):
            around, on, layer = stack[-1]
            part = css[at:m.start()].strip()
            if around is None and part[:1] != "@" and (m[0] == ";" or m[0] == "}" and len(stack) == 1):
                continue                                   # belongs to what opens the next block
            at = m.end()
            if m[0] == "{":
                stack.append(self._open(part, around, on, layer, strings))
                continue
            if part[:6].lower() == "@layer" and m[0] == ";":
                for name in part[6:].split(","):
                    self.layers.setdefault(layer + name.strip() + ".", len(self.layers))
            elif on and around is not None and (said := declaration(part)):
                self._keep(around, said, layer)
            if m[0] == "}" and len(stack) > 1:
                stack.pop()
        around, on, layer = stack[-1]
        if on and around is not None and (said := declaration(css[at:])):
            self._keep(around, said, layer)

    def _open(self, part: str, around, on: bool, layer: str, strings: list[str]):
        if part[:1] != "@":
            return Selectors(part, strings, around), on, layer
        m = re.match(r"@([\w-]+)(.*)", part, re.S)
        name, rest = (m[1].lower(), m[2].strip()) if m else ("", "")
        if name == "media":
            return around, on and on_screen(rest), layer
        if name == "supports":
            return around, on and _condition(rest, lambda _: True) is True, layer
        if name == "container":
            return around, on and _condition(re.sub(r"^(?!not\b)[\w-]+\s+(?=\(|not\b)", "", rest.lower()), _feature) is True, layer
        if name == "layer":
            layer += (rest or f"#{len(self.layers)}") + "."
            self.layers.setdefault(layer, len(self.layers))
            return around, on, layer
        if name == "scope":
            m = re.match(r"\(", rest)
            inner = rest[1:_closing(rest, 1)] if m else "*"
            return Selectors(inner, strings, around), on, layer
        return around, False, layer                        # keyframes, fonts, pages: no elements

    def _keep(self, selectors: Selectors, said: tuple[str, str, bool], layer: str) -> None:
        self.count += 1
        for parts, weight in selectors.parsed:
            last = parts[-1]
            key = ("#" + min(last.ids) if last.ids else "." + min(last.classes) if last.classes else last.tag or "*")
            self.by_key.setdefault(key, []).append((parts, weight, self.count, said, layer))

    def _rank(self, layer: str, important: bool) -> int:
        # outside of layers wins, of layers the last; important ones the other way round
        rank = self.layers.get(layer, 0) if layer else len(self.layers)
        return -rank if important else rank

    def said(self, node) -> dict[str, str]:
        """What holds for a node: its own style and the sheets, by importance, layer, weight and order."""
        best: dict[str, tuple] = {}

        def offer(said, rank) -> None:
            name, value, important = said
            if name not in best or best[name][0] <= (important, *rank):
                best[name] = (important, *rank), value
        if self.by_key:
            attrs = node.attrs
            keys = [node.tag, "*"]
            if "class" in attrs:
                keys += ["." + x for x in set(attrs["class"].split())]
            if "id" in attrs:
                keys.append("#" + attrs["id"])
            for key in keys:
                for parts, weight, order, said, layer in self.by_key.get(key, ()):
                    rank = (0, self._rank(layer, said[2]), weight, order)
                    if said[0] in best and best[said[0]][0] > (said[2], *rank):
                        continue
                    try:
                        if matches(parts, node):
                            offer(said, rank)
                    except RecursionError:
                        pass                               # selectors nested hundreds deep
        if "style" in node.attrs:
            for order, said in enumerate(inline(node.attrs["style"])):
                offer(said, (1, 0, (0, 0, 0), order))
        return {name: value for name, (_, value) in best.items()}
