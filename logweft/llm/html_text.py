"""Layout-aware HTML extraction.

A page is read into a tree as a browser would (void elements, raw text elements, tags that are implied or closed by
others, misnested ends), elements that are not displayed are left out (the ``hidden`` attribute, inline styles, the
cascade of the page's own style sheets on a screen, and elements that never show), and the rest is laid out as text:
white space collapsed, blocks on lines of their own with collapsed margins, lists with markers and indents, preformatted text as
it stands, and tables with their cells aligned in columns.

A map-only job over Arrow batches of pages.
"""

from __future__ import annotations

import re
from html import unescape
from typing import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logweft.llm import common as c, html_style

# Fixed values of HTML: element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
NEVER_SHOWN = frozenset("head script style template noscript noframes noembed iframe title datalist audio video "
                        "canvas area param source track rp".split())
#: Inside svg and math: elements that never show, those that hold HTML, tags that end the drawing or formula, elements
#: that show one child only, and those whose text stands apart.
DRAWN_NEVER = frozenset("annotation annotation-xml clippath defs desc filter lineargradient marker mask metadata pattern "
                        "radialgradient symbol".split())
HOLDS_HTML = frozenset("annotation-xml foreignobject desc title mi mn mo ms mtext".split())
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing "
                       "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
ONE_CHILD = frozenset("maction semantics switch".split())
APART = frozenset("text foreignobject mtr mtd".split())
#: Blocks, with the blank lines a browser leaves around them.
BLOCKS = {**dict.fromkeys("address article aside body center dd details dialog div dt fieldset figcaption footer form "
                          "header hgroup html legend li main nav optgroup option search section summary tr td th thead "
                          "tbody tfoot caption".split(), 0),
          **dict.fromkeys("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split(), 1)}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                     "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul "
                     "li dt dd xmp".split())
#: A start tag closes the open elements of the first set, unless one of the second stands in between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
          "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
          "tr": ({"td", "th", "tr", "caption"}, {"table"}),
          **dict.fromkeys(("thead", "tbody", "tfoot"), ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"})),
          **dict.fromkeys(("rt", "rp"), ({"rt", "rp"}, {"ruby"})),
          **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), ({"h1", "h2", "h3", "h4", "h5", "h6"}, {"div", "section"}))}
SCOPE = frozenset("table td th caption template button body html".split()) | HOLDS_HTML
TABLE_PARTS = frozenset("table td th tr thead tbody tfoot caption".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)"""
                    r"""|[^\s>"'][^\s>]*+)?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    #: ``foreign``: of svg or math; ``body``: attributes of the body, at the root; the last five are set where style sheets ask for them.
    __slots__ = ("tag", "attrs", "children", "foreign", "body", "parent", "elements", "place", "kin", "kins")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, foreign: bool = False):
        self.tag, self.attrs, self.children, self.foreign = tag, attrs or {}, [], foreign


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        value = m[2] or ""
        if value[:1] in ("'", '"'):
            value = value[1:-1] if value[-1:] == value[0] and len(value) > 1 else value[1:]
        out.setdefault(m[1].lower(), unescape(value))
    return out


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of a page, and its style sheets."""
    root = Node("html")
    root.body = {}
    stack, styles, at = [root], [], 0
    open_at: dict[str, list[int]] = {}                # places in the stack by element, so that no depth costs a walk

    def push(node: Node) -> None:
        open_at.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        while len(stack) > i:
            open_at[stack.pop().tag].pop()

    def last(tags) -> int:
        return max([open_at[x][-1] for x in tags if open_at.get(x)], default=0)

    def close(tags, barriers) -> None:
        if i := last(tags):
            barrier = last(barriers)
            while i > barrier:
                # several may be open inside each other (a cell in a row)
                cut(i)
                i = last(tags)

    def text(raw: str, plain: bool = False) -> None:
        if raw:
            if stack[-1].tag == "head" and raw.strip():
                cut(len(stack) - 1)
            # a drawing shows the text of its text elements
            if not open_at.get("svg") or last(("svg",)) < last(("text", "foreignobject")) or not raw.strip():
                stack[-1].children.append(raw if plain else unescape(raw))

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            return root, styles
        text(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if stack[-1].foreign and m[0].startswith("<![CDATA["):
                end = page.find("]]>", m.start() + 9)
                text(page[m.start() + 9:end if end >= 0 else len(page)], plain=True)
                at = end + 3 if end >= 0 else len(page)
            continue
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            i = last((tag,))
            if i and i >= last(("table",) if tag in TABLE_PARTS else SCOPE):
                cut(i)
            continue
        if tag in ("html", "body"):
            if tag == "body":
                close({"head"}, ())
            for name, value in _attributes(m[3]).items():
                (root.body if tag == "body" else root.attrs).setdefault(name, value)
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            cut(len(stack) - 1)
        attrs = _attributes(m[3]) if m[3] else None
        if stack[-1].foreign and (tag in BREAKS_OUT or tag == "font" and attrs and not attrs.keys().isdisjoint(("color", "face", "size"))):
            while stack[-1].foreign and stack[-1].tag not in HOLDS_HTML:
                cut(len(stack) - 1)
        foreign = tag in ("svg", "math") or stack[-1].foreign and stack[-1].tag not in HOLDS_HTML
        if foreign:
            node = Node(tag, attrs, True)
            stack[-1].children.append(node)
            if m[3].endswith("/"):
                continue
            if tag not in ("style", "script"):
                push(node)
                continue
        else:
            if tag in CLOSES_P:
                close({"p"}, SCOPE)
            if tag in CLOSES:
                tags, barriers = CLOSES[tag]
                close(tags, barriers | HOLDS_HTML)
            if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr")
                stack[-1].children.append(row)
                push(row)
            node = Node(tag, attrs)
            stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            body = page[at:end.start()] if end else page[at:]
            at = end.end() if end else len(page)
            if tag == "style":
                if (node.attrs.get("type", "").strip().lower() in ("", "text/css")
                        and html_style.on_screen(node.attrs.get("media", "")) and not open_at.get("template")):
                    styles.append(body)
            elif tag in ("textarea", "xmp"):
                node.children.append(unescape(body) if tag == "textarea" else body)
        elif tag not in VOID and not m[3].endswith("/") or tag in BLOCKS and tag not in VOID:
            push(node)


def _link(root: Node) -> None:
    """Parents and places of all elements, under a body as browsers add it."""
    def place(node: Node, children: list) -> None:
        node.elements, node.kins = [x for x in children if not isinstance(x, str)], {}
        for i, child in enumerate(node.elements):
            child.parent, child.place, child.kin = node, i, node.kins.get(child.tag, 0)
            node.kins[child.tag] = child.kin + 1

    body = Node("body", root.body)
    body.children = [x for x in root.children if isinstance(x, str) or x.tag != "head"]
    root.parent, root.place, root.kin = None, 0, 0
    place(root, [*(x for x in root.children if not isinstance(x, str) and x.tag == "head"), body])
    place(body, body.children)
    todo = list(root.elements[:-1] + body.elements)
    while todo:
        node = todo.pop()
        place(node, node.children)
        todo += node.elements


#: Inputs that show their value as a label.
LABELLED_INPUTS = ("submit", "reset", "button")


def keep_displayed(root: Node, styles: list[str]) -> None:
    """Takes everything out of a tree that is not displayed.

    Styles that hide the whole body or root are not followed: pages hide themselves until their scripts have run.
    """
    rules = html_style.Rules(styles)
    if rules:
        _link(root)
    language = root.attrs.get("lang", "en").partition("-")[0].lower()
    todo, changed, unseen = [(root, True)], [], []
    while todo:
        node, seen = todo.pop()
        kept = []
        only = None
        if node.foreign and node.tag in ONE_CHILD:
            only = next((x for x in node.children if not isinstance(x, str) and language in (
                y.strip().partition("-")[0].lower() for y in x.attrs.get("systemlanguage", language).split(","))), node)
        closed = node.tag == "details" and not node.foreign and "open" not in node.attrs
        if closed:                                     # its first summary alone is on the screen
            only = next((x for x in node.children if not isinstance(x, str) and x.tag == "summary"), node)
        for child in node.children:
            if isinstance(child, str):
                if seen and not closed:
                    kept.append(child)
                continue
            tag, attrs = child.tag, child.attrs
            button = tag == "input" and not child.foreign and attrs.get("type", "").lower() in LABELLED_INPUTS
            if tag in NEVER_SHOWN or tag == "input" and not button or child.foreign and tag in DRAWN_NEVER or only not in (None, child):
                continue
            said = rules.said(child) if rules or "style" in attrs else {}
            display = said.get("display", "revert")
            if display == "none" or display.startswith("revert") and (
                    child.foreign and attrs.get("display") == "none" or "hidden" in attrs and not child.foreign
                    or tag == "dialog" and "open" not in attrs):
                continue
            usual = ("hidden" if tag == "mphantom" else attrs.get("visibility", "inherit")) if child.foreign else "inherit"
            visibility = said.get("visibility", usual)
            visible = visibility in ("visible", "initial") or visibility not in ("hidden", "collapse") and seen
            if button:                                 # its label
                if visible and attrs.get("value"):
                    kept.append(attrs["value"])
                    changed.append((node, kept))
                continue
            kept.append(child)
            todo.append((child, visible))
            if not visible:
                unseen.append((child, node))
        if len(kept) != len(node.children):
            changed.append((node, kept))
    for node, kept in changed:
        node.children = kept
    # unseen elements that show nothing inside go too, but cells keep their place in the row
    gone: set[int] = set()
    for node, _ in reversed(unseen):
        if node.tag not in ("td", "th") and all(not isinstance(x, str) and id(x) in gone for x in node.children):
            gone.add(id(node))
    for parent in {id(parent): parent for node, parent in unseen if id(node) in gone}.values():
        parent.children = [x for x in parent.children if isinstance(x, str) or id(x) not in gone]


class _Lines:
    """Finished lines, with margins that collapse; groups of lines in them are indented when all are written out."""

    def __init__(self, mark: str = ""):
        self.mark = mark                               # before the first line, blanks of its width before the others
        self.lines: list[str | _Lines] = []
        self.margin = 0
        self.inline: list[str] = []

    def gap(self, n: int) -> None:
        self.flush()
        self.margin = max(self.margin, n)

    def add(self, lines: list[str | _Lines]) -> None:
        if lines:
            if self.lines:
                self.lines += [""] * self.margin
            self.margin = 0
            self.lines += lines

    def flush(self) -> None:
        if self.inline:
            text = _BLANK.sub(" ", "".join(self.inline)).strip(" ")
            self.inline = []
            if text:
                self.add([text.replace("\xa0", " ")])

    def written(self) -> list[str]:
        """The lines with the marks and indents of the groups around them; empty lines stay empty."""
        out: list[str] = []
        groups, indent, begun = [(self, iter(self.lines))], 0, 0         # the first ``begun`` groups have a line
        while groups:
            line = next(groups[-1][1], None)
            if line is None:
                group, _ = groups.pop()
                if begun > len(groups):
                    begun -= 1
                    indent -= len(group.mark)
            elif isinstance(line, str):
                marks = "".join([g.mark for g, _ in groups[begun:]])
                out.append(" " * indent + marks + line if line else line)
                indent, begun = indent + len(marks), len(groups)
            else:
                groups.append((line, iter(line.lines)))
        return out


#: A step of the layout: it yields the steps it needs, is sent their results, and returns its own.
Step = Generator["Step", object, object]


def _run(step: Step):
    """The result of a step; those that wait for others are on a list, so that pages may be nested to any depth."""
    waiting, result = [step], None
    while waiting:
        try:
            step = waiting[-1].send(result)
        except StopIteration as done:
            waiting.pop()
            result = done.value
        else:
            waiting.append(step)
            result = None
    return result


class _Layout:
    def __init__(self):
        self.in_list = 0

    def lines(self, node: Node, mark: str = "") -> Step:
        out = _Lines(mark)
        yield self.flow(node, out)
        out.flush()
        return out

    def flow(self, node: Node, out: _Lines) -> Step:
        for child in node.children:
            if isinstance(child, str):
                out.inline.append(child)
            elif child.tag == "br":
                if out.inline and "".join(out.inline).strip():
                    out.flush()
                else:
                    out.flush()
                    out.margin += 1 if out.lines else 0
            elif child.tag not in BLOCKS:
                if child.tag == "textarea":
                    out.gap(0)
                    out.add(child.children[0].split("\n") if child.children and child.children[0] else [])
                elif child.foreign and (child.tag in APART or child.tag == "tspan" and ("x" in child.attrs or "y" in child.attrs)):
                    out.inline.append(" ")
                    yield self.flow(child, out)
                    out.inline.append(" ")
                else:
                    yield self.flow(child, out)
            else:
                margin = 0 if self.in_list and child.tag in ("ul", "ol", "menu") else BLOCKS[child.tag]
                out.gap(margin)
                yield self.block(child, out)
                out.gap(margin)

    def block(self, node: Node, out: _Lines) -> Step:
        tag = node.tag
        if tag in ("ul", "ol", "menu"):
            yield self.items(node, out)
        elif tag == "table":
            out.add((yield self.table(node)))
        elif tag in ("pre", "xmp"):
            text = self.raw_text(node).removeprefix("\n").rstrip("\n")
            out.add([x.rstrip("\r") for x in text.split("\n")] if text.strip() else [])
        elif tag in ("blockquote", "dd"):
            inner = yield self.lines(node, "  ")
            out.add([inner] if inner.lines else [])
        else:
            yield self.flow(node, out)

    def raw_text(self, node: Node) -> str:
        parts, todo = [], [iter(node.children)]
        while todo:
            child = next(todo[-1], None)
            if child is None:
                todo.pop()
            elif isinstance(child, str):
                parts.append(child)
            elif child.tag == "br":
                parts.append("\n")
            else:
                todo.append(iter(child.children))
        return "".join(parts)

    def items(self, node: Node, out: _Lines) -> Step:
        number = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
        loose = Node("div")
        for child in node.children:
            if isinstance(child, str) or child.tag != "li":
                loose.children.append(child)         # text and nested lists straight in a list
                continue
            yield self.flow(loose, out)
            out.flush()
            loose.children.clear()
            if re.fullmatch(r"-?\d{1,9}", child.attrs.get("value", "")):
                number = int(child.attrs["value"])
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            self.in_list += 1
            item = yield self.lines(child, mark)
            self.in_list -= 1
            out.add([item] if item.lines else [mark.strip()])
        inner = yield self.lines(loose, "  ")
        out.add([inner] if inner.lines else [])

    def table(self, node: Node) -> Step:
        head, rows = [], []

        def collect(part: Node) -> Step:
            for child in part.children:
                if isinstance(child, str):
                    if child.strip():
                        head.append(_BLANK.sub(" ", child).strip())
                elif child.tag == "tr":
                    rows.append([x for x in child.children if not isinstance(x, str) and x.tag in ("td", "th")])
                    rest = Node("div")
                    rest.children = [x for x in child.children if isinstance(x, str) or x.tag not in ("td", "th")]
                    head.extend((yield self.lines(rest)).written())
                elif child.tag in ("thead", "tbody", "tfoot"):
                    yield collect(child)
                else:
                    head.extend((yield self.lines(child)).written())
        yield collect(node)
        placed: list[dict[int, tuple[list[str], int]]] = []
        taken: dict[tuple[int, int], bool] = {}
        for r, cells in enumerate(rows):
            line, col = {}, 0
            for cell in cells:
                while (r, col) in taken:
                    col += 1
                span = self.span(cell, "colspan")
                for k in range(1, min(self.span(cell, "rowspan"), len(rows) - r)):
                    for j in range(span):
                        taken[(r + k, col + j)] = True
                line[col] = ((yield self.lines(cell)).written(), span)
                col += span
            placed.append(line)
        width: dict[int, int] = {}
        for line in placed:
            for col, (lines, span) in line.items():
                if span == 1:
                    width[col] = max([width.get(col, 0), *map(len, lines)])
        starts, at = {}, 0
        for col in range(1 + max([0, *(col + span for line in placed for col, (_, span) in line.items())])):
            starts[col] = at
            at += width[col] + 2 if col in width and width[col] else 0
        out = list(head)
        for line in placed:
            for k in range(max([0, *(len(lines) for lines, _ in line.values())])):
                text = ""
                for col in sorted(line):
                    cell = line[col][0][k] if k < len(line[col][0]) else ""
                    if cell:
                        text = text.ljust(starts[col]) if len(text) <= starts[col] else text + "  "
                        text += cell
                out.append(text.rstrip(" "))
        return out

    @staticmethod
    def span(cell: Node, name: str) -> int:
        value = cell.attrs.get(name, "1")
        return min(1000, max(1, int(value))) if re.fullmatch(r"\d{1,9}", value) else 1


def page_text(page: str | None) -> str:
    """All visible text of a page, laid out; empty for null."""
    if not page:
        return ""
    root, styles = parse(page)
    keep_displayed(root, styles)
    return "\n".join(_run(_Layout().lines(root)).written()).strip("\n")


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """All columns of ``pages`` and the visible text in ``out`` (another column of that name is replaced).

    Null or empty pages give an empty text; rows are independent, so repeated rows, null ids and other columns pass
    through; an empty table gives an empty result. Pages of any size are read whole.
    """
    c.prepare(pages.sparkSession)
    pages = pages.drop(out)
    schema = pages.withColumn(out, F.lit("")).schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([page_text(x) for x in batch.column(html_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, out])
    return pages.mapInArrow(of, schema)
