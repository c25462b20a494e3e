"""HTML to text as a page shows it: a tree builder with implied tags, visibility rules, and a layout of blocks, lists and tables."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from statuta.llm.text import id_and_text, slices

TOKEN = re.compile(r"<!--(?:.*?(?:-->|\Z))|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
CSS = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[{};]""", re.S)
MEDIA = re.compile(r"(?:(only|not)\s+)?([a-z]+)", re.I)
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z][a-z -]*?)\s*(!\s*important)?\s*(?=;|$)", re.I)
COMMENT = re.compile(r"/\*.*?\*/", re.S)
#: Selectors: compounds of an element, classes, ids and attributes, with what stands between them: a space or ``>``.
COMPOUND = re.compile(r"""(\*|[a-z][\w-]*)?((?:[.#][\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:"[^"]*"|'[^']*'|[\w-]+)\s*)?\])*)""", re.I)
PART = re.compile(r"""([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[\w-]+)\s*)?\]""")
BETWEEN = re.compile(r"\s*(>)\s*|\s+")
BLANK = re.compile(r"[ \t\n\r\f]+")
#: The largest column span that HTML allows.  Indentation grows up to so many columns and alignment pads a table by at most so
#: many characters (beyond them the widest columns stand unaligned), which bounds the memory of a page; text is always whole.
MOST_SPAN, MOST_INDENT, MOST_PADDING = 1000, 2000, 1 << 24

# Words that display and visibility may have.
DISPLAYS = frozenset("none block inline inline-block flow flow-root list-item contents flex inline-flex grid inline-grid ruby run-in table inline-table table-row table-cell table-caption table-row-group table-header-group table-footer-group table-column table-column-group inherit initial unset revert revert-layer math -webkit-box -webkit-inline-box -ms-flexbox -webkit-flex".split())
VISIBILITIES = frozenset("visible hidden collapse inherit initial unset revert revert-layer".split())
# Element names of the HTML standard by how they are parsed and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style title template noscript iframe noembed noframes object audio video canvas datalist".split())
#: Inside svg and math: what isn't drawn where it stands; and the math elements whose parts stand apart.
UNDRAWN = frozenset("defs symbol clippath mask pattern marker metadata desc filter lineargradient radialgradient".split())
NO_MATH = frozenset("annotation annotation-xml mphantom".split())
APART = frozenset("mfrac msub msup msubsup munder mover munderover mroot mmultiscripts mtable mtr mtd".split())
#: Where elements are svg's or math's, where HTML begins again inside, and the HTML elements that end svg and math.
FOREIGN = frozenset("svg math".split())
AGAIN_HTML = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
BREAKS_OUT = frozenset("b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp li dd dt".split())
BLOCK = CLOSES_P | frozenset("html body caption legend option optgroup tr thead tbody tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre table figure fieldset hr".split())
SCOPES = frozenset("html table td th caption template button object".split())
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}


#: What an end tag doesn't look past, where it isn't SCOPES.
TABLE_STOP = dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot", "caption"), frozenset(["table"])) | {"table": frozenset()}


class Node:
    __slots__ = ("attrs", "children", "gone", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.gone = tag, attrs, [], False


def attributes(source: str) -> dict[str, str]:
    """The attributes of a start tag; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(source):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


def parse(html: str) -> tuple[Node, list[str], int]:
    """The element tree, the texts of its style sheets, and how deep elements nest."""
    root = Node("html", {})
    stack, styles, at, length, deepest = [root], [], 0, len(html), 1
    is_open: Counter[str] = Counter()

    def push(node: Node) -> None:
        nonlocal deepest
        stack.append(node)
        is_open[node.tag] += 1
        deepest = max(deepest, len(stack))

    def cut(i: int) -> None:
        for node in stack[i:]:
            is_open[node.tag] -= 1
        del stack[i:]

    def close(tags: set[str], until: set[str]) -> None:
        i = len(stack) - 1
        left = sum(is_open[t] for t in tags)
        while left and i > 0:
            tag = stack[i].tag
            if tag in tags:
                cut(i)
                left = sum(is_open[t] for t in tags)
            elif tag in until:
                return
            i -= 1

    def foreign() -> int:
        """Where the svg or math on the stack is whose elements come next, 0 for none."""
        if not (is_open["svg"] or is_open["math"]):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in FOREIGN:
                return i
            if stack[i].tag in AGAIN_HTML:
                return 0
        return 0

    while at < length:
        found = TOKEN.search(html, at)
        if found is None:
            break
        if found.start() > at:
            stack[-1].children.append(unescape(html[at : found.start()]))
        if html.startswith("<![CDATA[", found.start()) and foreign():
            end = html.find("]]>", found.start())
            stack[-1].children.append(html[found.start() + 9 : end if end >= 0 else length])
            at = end + 3 if end >= 0 else length
            continue
        at = found.end()
        ending, tag, source = found.groups()
        if tag:
            tag = tag.lower()
            if tag in ("html", "body", "head"):
                if tag != "head" and source:
                    root.attrs = {**attributes(source), **root.attrs}
                continue
            if tag in BREAKS_OUT and (outer := foreign()):
                cut(outer)
            if source.endswith("/") and tag not in VOID and (tag in FOREIGN or foreign()):
                stack[-1].children.append(Node(tag, attributes(source[:-1])))
                continue
            if tag in CLOSES_P:
                close({"p"}, SCOPES)
            if tag in CLOSED_BY:
                close(*CLOSED_BY[tag])
                if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                    row = Node("tr", {})
                    stack[-1].children.append(row)
                    push(row)
            elif tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                cut(len(stack) - 1)
            node = Node(tag, attributes(source) if source.strip(" /\n\t") else {})
            stack[-1].children.append(node)
            if tag in RAW:
                end = re.compile(f"</{tag}[\\s/>]", re.I).search(html, at)
                content = html[at : end.start() if end else length]
                at = html.find(">", end.start()) + 1 if end else length
                at = at or length
                if tag == "style":
                    if on_screen(node.attrs.get("media", "")):
                        styles.append(content)
                elif tag in ("textarea", "xmp"):
                    node.children.append(unescape(content) if tag == "textarea" else content)
            elif tag not in VOID:
                push(node)
        elif ending:
            ending = ending.lower()
            if ending == "br":
                stack[-1].children.append(Node("br", {}))
                continue
            if not is_open[ending]:
                continue
            stop = TABLE_STOP.get(ending, SCOPES)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == ending:
                    cut(i)
                    break
                if stack[i].tag in stop:
                    break
    if at < length:
        stack[-1].children.append(unescape(html[at:]))
    return root, styles, deepest


def on_screen(media: str) -> bool:
    """Whether a media query list holds on every screen; conditions on the screen's features don't."""
    for one in media.split(","):
        m = MEDIA.fullmatch(one.strip())
        if not one.strip() or (m and (m[2].lower() in ("all", "screen")) != ((m[1] or "").lower() == "not")):
            return True
    return False


def style_rules(css: str) -> Iterator[tuple[str, str, bool]]:
    """``(selectors, declarations, whether in a layer)`` of the rules that hold on every screen, without the rules nested in them."""
    css = CSS.sub(lambda m: "" if m[0][:2] == "/*" else m[0], css)
    #: Open blocks: selectors (None for an at-rule), whether it holds, its own declarations, whether it is in a layer.
    blocks: list[tuple[str | None, bool, list[str], bool]] = []
    start = 0

    def closed(end: int) -> Iterator[tuple[str, str, bool]]:
        selectors, holds, own, layered = blocks.pop()
        if selectors is not None and holds:
            yield selectors, "".join([*own, css[start:end]]), layered

    for mark in CSS.finditer(css):
        kind, begin = mark[0], css[start : mark.start()].strip()
        if kind == "{":
            holds, layered = not blocks or (blocks[-1][0] is None and blocks[-1][1]), bool(blocks) and blocks[-1][3]
            if begin[:1] == "@":
                name, _, media = re.sub(r"^(@[\w-]+)", r"\1 ", begin).partition(" ")
                holds = holds and (name.lower() == "@layer" or (name.lower() == "@media" and on_screen(media)))
                blocks.append((None, holds, [], layered or name.lower() == "@layer"))
            else:
                blocks.append((begin, holds, [], layered))
        elif kind == "}":
            if blocks:
                yield from closed(mark.start())
        elif kind == ";":
            if blocks and blocks[-1][0] is not None:
                blocks[-1][2].append(css[start : mark.end()])
            elif begin[:1] != "@":
                continue
        else:
            continue
        start = mark.end()
    while blocks:
        yield from closed(len(css))
        start = len(css)


#: One compound of a selector: element ("" for any), attributes with their values (None for any), classes, and whether its
#: ancestor in the selector must be its parent.
Compound = tuple[str, list[tuple[str, str | None]], set[str], bool]


def selector(source: str) -> list[Compound] | None:
    """The compounds of a selector, or None if it holds anything else (states, generated content, siblings)."""
    out, at, child = [], 0, False
    while at < len(source):
        m = COMPOUND.match(source, at)
        if m is None or not m[0]:
            return None
        classes, wanted = set(), []
        for kind, name, attribute, value in PART.findall(m[2]):
            if kind == ".":
                classes.add(name)
            elif kind == "#":
                wanted.append(("id", name))
            else:
                wanted.append((attribute.lower(), value.strip("\"'") if value else None))
        out.append(("" if m[1] in (None, "*") else m[1].lower(), wanted, classes, child))
        at = m.end()
        if at < len(source):
            m = BETWEEN.match(source, at)
            if m is None:
                return None
            child, at = m[1] is not None, m.end()
    return out or None


def specificity(source: str, compounds: list[Compound]) -> tuple[int, int, int]:
    """How many ids, classes and attributes, and elements a selector names."""
    parts = [kind for kind, *_ in PART.findall(source)]
    return parts.count("#"), len(parts) - parts.count("#"), sum(bool(tag) for tag, *_ in compounds)


def declared(body: str) -> list[tuple[str, str, bool]]:
    """``(property, value, important)`` of the declarations of display and visibility that are valid."""
    if "isplay" not in body and "isibility" not in body and "ISPLAY" not in body and "ISIBILITY" not in body:
        return []
    found = ((p.lower(), " ".join(v.lower().split()), bool(i)) for p, v, i in DECLARED.findall(COMMENT.sub("", body)))
    return [(p, v, i) for p, v, i in found if all(word in (DISPLAYS if p == "display" else VISIBILITIES) for word in v.split(" "))]


class Cascade:
    """The declarations of display and visibility of all style sheets, and which of them win for an element.

    Among rules that fit an element the important ones win, then inline style, then rules outside layers (inside them if important), then
    the more specific selector, then the later rule.  Selectors are matched from the root down: an element fits the first j parts of a selector if it fits the
    j-th and its parent, or any ancestor, fits those before.
    """

    def __init__(self, styles: list[str]):
        #: Parts of selectors in order, one number each: the part, whether it is the first, what a selector that ends here declares.
        self.parts: list[tuple[Compound, bool, list[tuple[str, str, tuple]]]] = []
        self.by_key: dict[str, list[int]] = {}
        order = 0
        for style in styles:
            for selectors, body, layered in style_rules(style):
                if not (rules := declared(body)):
                    continue
                for one in selectors.split(","):
                    order += 1
                    if compounds := selector(one.strip()):
                        weight = specificity(one, compounds)
                        said = [(p, v, (important, False, layered if important else not layered, weight, order)) for p, v, important in rules]
                        for j, part in enumerate(compounds):
                            self.by_key.setdefault(self._key(part), []).append(len(self.parts))
                            self.parts.append((part, j == 0, said if j == len(compounds) - 1 else []))

    @staticmethod
    def _key(part: Compound) -> str:
        tag, wanted, classes, _ = part
        ids = [value for name, value in wanted if name == "id" and value is not None]
        return f"#{ids[0]}" if ids else f".{min(classes)}" if classes else tag or "*"

    def matched(self, node: Node, above: list[set[int]], seen: dict[int, int]) -> set[int]:
        """The parts that end at an element, given those of its ancestors."""
        if not self.parts:
            return set()
        keys = ["*", node.tag]
        if node.attrs:
            keys += [f".{c}" for c in set(node.attrs.get("class", "").split())]
            if "id" in node.attrs:
                keys.append(f"#{node.attrs['id']}")
        out, parent = set(), above[-1] if above else set()
        for key in keys:
            for i in self.by_key.get(key, ()):
                part, first, _ = self.parts[i]
                if (first or (i - 1 in parent if part[3] else seen.get(i - 1))) and fits(node, part):
                    out.add(i)
        return out

    def winners(self, node: Node, matched: set[int]) -> dict[str, str]:
        best: dict[str, tuple] = {}
        said = [x for i in matched for x in self.parts[i][2]]
        if "style" in node.attrs:
            said += [(p, v, (important, True, True, (0, 0, 0), n)) for n, (p, v, important) in enumerate(declared(node.attrs["style"]))]
        for name, value, weight in said:
            if name not in best or weight >= best[name][0]:
                best[name] = weight, value
        return {name: value for name, (_, value) in best.items()}


def fits(node: Node, one: Compound) -> bool:
    tag, wanted, classes, _ = one
    if tag and tag != node.tag:
        return False
    if classes and not classes.issubset(node.attrs.get("class", "").split()):
        return False
    return all(name in node.attrs and (value is None or node.attrs[name] == value) for name, value in wanted)


def style_away(root: Node, cascade: Cascade) -> None:
    """Marks the elements that aren't displayed, and takes the text out of those that are hidden but hold something visible."""
    above: list[set[int]] = []  # the parts that end at each ancestor
    seen: dict[int, int] = {}  # how many ancestors each part ends at
    hidden: list[Node] = []  # in document order
    shown_below: set[int] = set()  # hidden elements with something visible inside
    todo: list[tuple[Node, int, bool]] = [(root, 0, False)]
    chain: list[Node] = []
    while todo:
        node, depth, was_hidden = todo.pop()
        while len(above) > depth:
            for i in above.pop():
                seen[i] -= 1
            chain.pop()
        matched = cascade.matched(node, above, seen)
        wins = cascade.winners(node, matched) if matched or "style" in node.attrs else {}
        display = wins.get("display")
        if display is None or display in ("revert", "revert-layer"):
            node.gone = "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs)
        else:
            node.gone = display == "none"
        if node.gone:
            continue
        visibility = wins.get("visibility")
        is_hidden = was_hidden if visibility in (None, "inherit", "unset", "revert", "revert-layer") else visibility in ("hidden", "collapse")
        if is_hidden:
            hidden.append(node)
        elif was_hidden:
            for x in reversed(chain):
                if id(x) in shown_below:
                    break
                shown_below.add(id(x))
        above.append(matched)
        chain.append(node)
        for i in matched:
            seen[i] = seen.get(i, 0) + 1
        todo += [(child, depth + 1, is_hidden) for child in node.children if isinstance(child, Node)]
    for node in hidden:
        if id(node) in shown_below:
            node.children = [c for c in node.children if isinstance(c, Node)]
        else:
            node.gone = True


class Layout:
    """Lines of text of a subtree."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.open_space = False
        self.gap = False
        self.indent, self.marker, self.pre = "", "", 0
        self.n_items = self.n_tables = 0

    def visible(self, node: Node) -> bool:
        return not (node.gone or node.tag in UNSEEN or (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden"))

    def text(self, value: str) -> None:
        if self.pre:
            first, *rest = value.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.line.append(first)
            for x in rest:
                self.flush(keep=True)
                self.line.append(x)
            return
        words = BLANK.sub(" ", value)
        if words[:1] == " ":
            self.open_space = bool(self.line) or self.open_space
            words = words[1:]
        if not words:
            return
        if self.open_space and self.line:
            self.line.append(" ")
        self.open_space = words[-1] == " "
        self.line.append(words.rstrip(" "))

    def flush(self, keep: bool = False) -> None:
        """Ends the line; an empty one only counts if ``keep``."""
        self.open_space = False
        value = "".join(self.line)
        if not self.pre:
            value = value.strip(" ")
        if value or keep:
            self.put(value)
        self.line = []

    def put(self, value: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        if self.marker and (value or not self.pre):
            value, self.marker = self.marker + value, ""
            self.lines.append(value.rstrip() if not self.pre else value)
        else:
            self.lines.append((self.indent + value).rstrip())

    def block(self, spaced: bool) -> None:
        self.flush()
        if spaced and not self.marker:
            self.gap = True

    def children(self, node: Node, kids: list | None = None) -> None:
        for child in node.children if kids is None else kids:
            if isinstance(child, str):
                self.text(child)
            elif self.visible(child):
                self.element(child)

    def element(self, node: Node) -> None:
        tag = node.tag
        if tag == "br":
            self.flush(keep=True)
        elif tag == "table":
            self.table(node)
        elif tag in ("ul", "ol", "menu", "dir"):
            self.list(node)
        elif tag == "details" and "open" not in node.attrs:
            self.block(False)
            self.children(node, [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1])
            self.block(False)
        elif tag == "input":
            if node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number"):
                self.text(f" {node.attrs.get('value', '')} ")
        elif tag == "pre" or tag in ("textarea", "xmp"):
            self.block(tag == "pre")
            self.pre += 1
            kids = list(node.children)
            if kids and isinstance(kids[0], str) and kids[0][:1] == "\n":
                kids[0] = kids[0][1:]
            self.children(node, kids)
            self.flush(keep=bool("".join(self.line)))
            self.pre -= 1
            self.block(tag == "pre")
        elif tag == "select":
            self.select(node)
        elif tag == "svg":
            self.svg(node, False)
        elif tag == "math":
            self.math(node)
        elif tag in BLOCK:
            spaced, inner = tag in SPACED, self.indent
            self.block(spaced)
            if tag in ("blockquote", "dd"):
                self.indent = deeper(self.indent, 2)
            self.children(node)
            self.flush()
            self.indent = inner
            self.block(spaced)
        else:
            if tag in ("td", "th", "rp"):
                self.text(" ")
            self.children(node)
            if tag in ("td", "th"):
                self.text(" ")

    def svg(self, node: Node, drawn: bool) -> None:
        """The text elements of a drawing, each apart; texts drawn through ``use`` only aren't followed."""
        for child in node.children:
            if isinstance(child, str):
                if drawn:
                    self.text(child)
                continue
            tag, attrs = child.tag, child.attrs
            if tag in UNDRAWN or not self.visible(child) or attrs.get("display", "").strip() == "none" or attrs.get("visibility", "").strip() in ("hidden", "collapse"):
                continue
            apart = tag in ("text", "foreignobject") or (tag == "tspan" and not attrs.keys().isdisjoint(("x", "y", "dy")))
            if apart:
                self.text(" ")
            self.children(child) if tag == "foreignobject" else self.svg(child, drawn or tag == "text")
            if apart:
                self.text(" ")

    def math(self, node: Node) -> None:
        for child in node.children:
            if isinstance(child, str):
                self.text(child.strip())
            elif child.tag not in NO_MATH and self.visible(child):
                self.children(child) if child.tag in AGAIN_HTML else self.math(child) if child.tag[:1] == "m" or child.tag == "semantics" else self.element(child)
            if node.tag in APART:
                self.text(" ")

    def select(self, node: Node) -> None:
        """The option that a closed menu shows; all options, one a line, of a list box."""
        size = node.attrs.get("size", "").strip()
        box = "multiple" in node.attrs or (size.isdecimal() and len(size) < 9 and int(size) > 1)
        options: list[tuple[Node, bool]] = []

        def words(part: Node) -> str:
            out, todo = [], [part]
            while todo:
                one = todo.pop()
                if isinstance(one, str):
                    out.append(one)
                elif one is part or self.visible(one):
                    todo += reversed(one.children)
            return "".join(out)

        def gather(part: Node, off: bool) -> None:
            for child in part.children:
                if isinstance(child, str) or not self.visible(child):
                    continue
                if child.tag == "option":
                    options.append((child, off or "disabled" in child.attrs))
                else:
                    if child.tag == "optgroup" and box:
                        options.append((child, True))
                    gather(child, off or (child.tag == "optgroup" and "disabled" in child.attrs))

        gather(node, False)
        if not box:
            options = [x for x in options if "selected" in x[0].attrs][-1:] or [x for x in options if not x[1]][:1]
        for option, _ in options:
            if box:
                self.flush()
            self.text(f" {option.attrs.get('label') or (words(option) if option.tag == 'option' else '')} ")
        if box:
            self.flush()

    def list(self, node: Node) -> None:
        nested = bool(self.indent or self.marker)
        self.block(not nested)
        outer = self.indent
        items = [c for c in node.children if isinstance(c, Node) and c.tag == "li" and self.visible(c)]
        step = -1 if node.tag == "ol" and "reversed" in node.attrs else 1
        number = whole(node.attrs.get("start"), len(items) if step < 0 else 1)
        for child in node.children:
            if isinstance(child, str):
                self.text(child)
            elif not self.visible(child):
                continue
            elif child.tag == "li":
                self.flush()
                if self.marker:
                    self.put("")
                number = whole(child.attrs.get("value"), number)
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += step
                self.n_items += 1
                self.marker, self.indent = outer + mark, deeper(outer, len(mark))
                self.children(child)
                self.flush()
                if self.marker:
                    self.put("")
                self.gap = False
                self.indent = outer
            else:
                self.element(child)
        self.flush()
        self.block(not nested)

    def table(self, node: Node) -> None:
        self.block(True)
        self.n_tables += 1
        rows, captions, order = [], [], {"thead": 0, "tfoot": 2}

        def gather(part: Node, rank: int) -> None:
            for child in part.children:
                if isinstance(child, str):
                    if child.strip():
                        self.text(child)
                elif not self.visible(child):
                    continue
                elif child.tag == "tr":
                    rows.append((rank, child))
                elif child.tag in ("thead", "tbody", "tfoot"):
                    gather(child, order.get(child.tag, 1))
                elif child.tag == "caption":
                    captions.append(child)
                elif child.tag not in ("col", "colgroup"):
                    self.element(child)

        gather(node, 1)
        self.flush()
        for caption in captions:
            self.children(caption)
            self.flush()
        rows.sort(key=lambda r: r[0])
        grid, widths, taken = [], {}, {}
        for _, row in rows:
            column, line = 0, []
            for cell in row.children:
                if isinstance(cell, str) or not self.visible(cell):
                    continue
                while taken.get(column, 0) > 0:
                    column += 1
                inner = Layout()
                inner.children(cell) if cell.tag in ("td", "th") else inner.element(cell)
                inner.flush()
                self.n_items += inner.n_items
                self.n_tables += inner.n_tables
                span = [self.span(cell, "colspan"), self.span(cell, "rowspan")]
                width = max(map(len, inner.lines), default=0)
                if span[0] == 1:
                    widths[column] = max(widths.get(column, 0), width)
                line.append((column, inner.lines))
                for c in range(column, column + span[0]):
                    if span[1] > 1:
                        taken[c] = span[1]
                column += span[0]
            taken = {c: n - 1 for c, n in taken.items() if n > 1}
            grid.append(line)
        for column in sorted(widths, key=widths.__getitem__, reverse=True):
            if sum(widths.values()) * len(grid) <= MOST_PADDING:
                break
            widths[column] = 0
        starts, place = {}, 0
        for column in range(max((c for line in grid for c, _ in line), default=-1) + 1):
            starts[column] = place
            if widths.get(column):
                place += widths[column] + 2
        for line in grid:
            for k in range(max((len(x) for _, x in line), default=0)):
                value = ""
                for column, lines in line:
                    if k < len(lines) and lines[k]:
                        value = value.ljust(starts[column]) if len(value) <= starts[column] else value + "  "
                        value += lines[k]
                self.put(value)
        self.block(True)

    @staticmethod
    def span(cell: Node, name: str) -> int:
        value = cell.attrs.get(name, "1").strip()
        return max(1, min(int(value), MOST_SPAN)) if value.isdecimal() and len(value) < 9 else 1


def whole(value: str | None, otherwise: int) -> int:
    """The whole number that an attribute holds."""
    m = re.match(r"\s*([+-]?\d{1,9})(?!\d)", value or "", re.A)
    return int(m[1]) if m else otherwise


def deeper(indent: str, by: int) -> str:
    return indent + " " * min(by, MOST_INDENT - len(indent))


def render(html: str | None) -> tuple[str, int, int]:
    """``(text, list items, tables)`` of a page."""
    if not html:
        return "", 0, 0
    root, styles, deepest = parse(html)
    style_away(root, Cascade(styles))
    # the layout calls itself for each level, a few frames a level
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6 * deepest + 1000))
    page = Layout()
    if page.visible(root):
        page.children(root)
        page.flush()
    return "\n".join(page.lines).replace("\xa0", " ").strip("\n"), page.n_items, page.n_tables


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: page_id, text, n_chars, n_lines, n_items, n_tables.

    Null and empty pages, and pages that show nothing, have empty text; bytes that are no markup are text.  Pages of any
    length and depth are read whole.  Repeated rows each give their row, other columns are not read, and no pages give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="html"):
            shown = [render(x) for x in batch.column("html").to_pylist()]
            texts = [t for t, _, _ in shown]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array([n for _, n, _ in shown], pa.int64()), pa.array([n for _, _, n in shown], pa.int64())],
                ["page_id", "text", "n_chars", "n_lines", "n_items", "n_tables"],
            )

    rows = id_and_text(pages, id_col, html_col, "page_id", "html")
    return rows.mapInArrow(run, "page_id long, text string, n_chars long, n_lines long, n_items long, n_tables long")
