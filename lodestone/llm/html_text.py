"""HTML extraction: a tree builder with implied tags, and a renderer that keeps the layout."""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, insort
from collections.abc import Iterator
from html import unescape
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import narrow, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag; in the second set it is decoded.
RAW, DECODED = frozenset("script style xmp iframe noembed noframes noscript".split()), frozenset("textarea title".split())
#: Elements that are never rendered.
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title datalist object audio video canvas area base link meta param source track rp".split())
#: Elements of svg and math that are never rendered where they stand.
FOREIGN_UNSEEN = frozenset("desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml mphantom".split())
#: Elements of svg and math that hold HTML, and start tags that end svg and math.
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Elements outside the flow of blocks that stand apart from their neighbours: stray cells, labels and cells of svg and math.
APART = frozenset("td th tr text foreignobject mtd mtr".split())
#: Elements that may stand in the head.
HEAD = frozenset("base link meta noscript script style template title".split())
#: Block elements with an empty line around them, and without.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol menu dl table figure fieldset hr".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption".split())
#: Block elements whose start ends an open paragraph.
ENDS_P = (BLOCK - frozenset("dt dd option optgroup legend caption html body".split())) | {"dt", "dd", "xmp", "plaintext"}
#: A start tag ends the nearest open element of the second column, unless one of the third is nearer.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist", "table"}),
    "optgroup": ({"optgroup", "option"}, {"select", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
#: Where end tags and implied ends stop looking.
SCOPE = frozenset("table td th caption html template".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr colgroup".split())
IN_TABLE = frozenset("caption colgroup col tbody thead tfoot tr td th script style template".split())
#: Fixed values, as in browsers: the deepest nesting (what lies deeper is put there), and the most
#: columns and rows that a cell may span.
DEEPEST, MOST_COLUMNS, MOST_ROWS = 256, 1000, 65534
#: Bounds of the layout, so that it doesn't outgrow the text: levels that are indented, and the width up to
#: which a cell aligns what follows it, and that of a row beyond which cells just follow each other.
#: Longer lines stay whole and push what follows to the right.
INDENTED, WIDEST, ALIGNED = 16, 120, 400
#: Columns in which cells from above are minded.
COLUMNS = 4096
#: What display makes of an element: a block, part of a line, or part of a line that stands apart.
SHAPES = {
    **dict.fromkeys("block flow-root list-item flex grid table -webkit-box -webkit-flex table-row table-row-group table-header-group table-footer-group table-caption".split(), "block"),
    **dict.fromkeys("inline contents ruby".split(), "inline"),
    **dict.fromkeys("inline-block inline-flex inline-grid inline-table table-cell -webkit-inline-box -webkit-inline-flex".split(), "apart"),
}
#: Whose children are boxes of their own, whatever they are.
SPLIT = frozenset("flex grid inline-flex inline-grid -webkit-box -webkit-flex -webkit-inline-box -webkit-inline-flex".split())
#: Controls, which stand apart in a line, and the kinds of input whose value is shown.
CONTROLS = frozenset("button select textarea input".split())
TEXT_INPUTS = frozenset(["", "text", "search", "email", "url", "tel", "number", "submit", "button", "reset", "date", "time", "month", "week", "datetime-local"])
#: What white-space keeps: all, line breaks only, or nothing.
KEPT = {"pre": "pre", "pre-wrap": "pre", "break-spaces": "pre", "pre-line": "lines", "normal": "", "nowrap": "", "initial": ""}

#: A whole tag of the usual form; it holds no other <, so trying costs no more than to the next one.
_USUAL = re.compile(r"(/?)([a-zA-Z][^\s/><]*)\s*((?:[^\s=/\"'<>]+=(?:\"[^\"<]*\"|'[^'<]*')\s*)*)(/?)>")
_USUAL_ATTRIBUTE = re.compile(r"([^\s=]+)=(?:\"([^\"]*)\"|'([^']*)')")
_TAG_NAME, _BETWEEN, _KEY, _EQUALS, _BARE = (re.compile(x) for x in (r"(/?)([a-zA-Z][^\s/>]*)", r"[\s/]*", r"[^\s/>][^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
_DECLARED = re.compile(r"(display|visibility|white-space)\s*:\s*([\w-]+(?:\s+[\w-]+)*)\s*(!\s*important)?\Z", re.I)
#: Comments, and what else style sheets may be wrapped in; strings, escapes and what ends a piece of a sheet.
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->|<!\[CDATA\[|\]\]>", re.S)
_CSS_MARK = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|url\([^)\"']*\)|\\.|[{};]", re.S)
_SELECTOR = re.compile(r"(?:[^\s>+~\[(]|\[[^\]]*\]|\([^)]*\))+|[>+~]")
_LISTED = re.compile(r",(?![^(\[]*[)\]])")
_ATTRIBUTE = r"\[\s*[\w-]+\s*(?:[~|^$*]?=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\]"
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+|" + _ATTRIBUTE + r"|:(?:first|last|only)-child|:root|:not\([^()]*\))*)\Z")
_PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?)=\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*)?\]|:(first-child|last-child|only-child|root)|:not\(([^()]*)\)")
_FEATURE = re.compile(r"(min-|max-)?(width|height)\s*(?::|(<=|>=|<|>|=))\s*([\d.]+)(px|em|rem|)\Z")
#: The screen that media queries are judged for, in pixels, and the features that it has.
SCREEN = {"width": 1280, "height": 800}
TRAITS = frozenset(["color", "hover", "any-hover", "orientation:landscape", "hover:hover", "any-hover:hover", "pointer:fine", "any-pointer:fine", "pointer", "any-pointer", "grid:0", "update:fast", "update", "scripting:enabled", "scripting", "prefers-color-scheme:light", "prefers-reduced-motion:no-preference", "prefers-contrast:no-preference", "forced-colors:none", "display-mode:browser"])
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Characters that the renderer uses itself.
_MARKS = dict.fromkeys((0, 1, 2))


class Element:
    __slots__ = ("tag", "attributes", "children", "foreign")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, foreign: bool = False) -> None:
        self.tag, self.attributes, self.foreign = tag, attributes or {}, foreign
        self.children: list[Element | str] = []


class Tags:
    """Reads a page's markup forward only: each character is looked at a bounded number of times."""

    def __init__(self, html: str) -> None:
        self.html, self.without = html, set()  # quotation marks that don't come any more

    def _closing(self, mark: str, at: int) -> int:
        if mark in self.without:
            return -1
        end = self.html.find(mark, at)
        if end < 0:
            self.without.add(mark)
        return end

    def read(self, at: int) -> tuple[int, bool, str, dict[str, str], bool] | None:
        """The tag at a <: its end, whether it is an end tag, its name, attributes and whether it closes
        itself; None if it never ends. Of equal attributes the first counts; a quotation mark counts after
        an equals sign, if another follows anywhere."""
        html = self.html
        if m := _USUAL.match(html, at + 1):
            attributes: dict[str, str] = {}
            if m[3]:
                for k, a, b in _USUAL_ATTRIBUTE.findall(m[3]):
                    attributes.setdefault(k.lower(), unescape(a or b))
            return m.end(), bool(m[1]), m[2].lower(), attributes, bool(m[4])
        m = _TAG_NAME.match(html, at + 1)
        attributes, pos = {}, m.end()
        while True:
            between = _BETWEEN.match(html, pos)
            pos = between.end()
            if pos >= len(html):
                return None
            if html[pos] == ">":
                return pos + 1, bool(m[1]), m[2].lower(), attributes, between[0].endswith("/")
            key, value = _KEY.match(html, pos), ""
            pos = key.end()
            if equals := _EQUALS.match(html, pos):
                pos = equals.end()
                if html[pos : pos + 1] in ("'", '"') and (end := self._closing(html[pos], pos + 1)) >= 0:
                    value, pos = html[pos + 1 : end], end + 1
                else:
                    bare = _BARE.match(html, pos)
                    value, pos = bare[0], bare.end()
            attributes.setdefault(key[0].lower(), unescape(value))


def parse(html: str) -> Element:
    """The tree of a page. Any text is accepted; missing html, head, body, tbody, tr and end tags are implied."""
    root = Element("html")
    body = Element("body")
    root.children.append(head := Element("head"))
    root.children.append(body)
    stack = [root]

    def in_body() -> None:
        if len(stack) == 1 or stack[1] is head:
            stack[1:] = [body]

    def close(tags: set[str], stop: frozenset[str] | set[str]) -> None:
        for i in range(len(stack) - 1, 1, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    def place(node: Element | str) -> None:
        """Into the open element; what a table can't hold goes before the table."""
        top = stack[-1]
        if top.tag in TABLE_PARTS and not (node.tag in IN_TABLE if isinstance(node, Element) else not node.strip()):
            i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "table") if any(s.tag == "table" for s in stack) else 0
            if i:
                around = stack[i - 1].children
                around.insert(next((k for k in range(len(around) - 1, -1, -1) if around[k] is stack[i]), len(around)), node)
                return
        top.children.append(node)

    def foreign() -> int:
        """Where in the stack the svg or math stands whose content is read, or 0."""
        for i in range(len(stack) - 1, 1, -1):
            if stack[i].tag in ("svg", "math"):
                return i
            if not stack[i].foreign or stack[i].tag in HOLDS_HTML:
                return 0
        return 0

    def text(s: str) -> None:
        if len(stack) == 1 or stack[1] is head:
            if not s.strip():
                return
            in_body()
        place(s)

    tags, at, n, begin = Tags(html), 0, len(html), 0  # text begins before at if a < there is only text
    while True:
        start = html.find("<", at)
        if start < 0:
            if begin < n:
                text(unescape(html[begin:]))
            break
        letter = html[start + 1 : start + 2]
        if not (letter in ("!", "?", "/") or letter.isascii() and letter.isalpha()):
            at = start + 1
            continue
        name = letter if letter != "/" else html[start + 2 : start + 3]
        found = tags.read(start) if name.isascii() and name.isalpha() else (0, False, "", {}, False)
        if not found:  # it never ends
            text(unescape(html[begin:]))
            break
        if start > begin:
            text(unescape(html[begin:start]))
        at, is_end, tag, attributes, closed = found
        if not tag:  # comments and what browsers take for such
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = n if end < 0 else end + 3
            elif html.startswith("<![CDATA[", start) and foreign():
                end = html.find("]]>", start)
                at = n if end < 0 else end + 3
                text(html[start + 9 : end if end >= 0 else n])
            else:
                at = html.find(">", start) + 1 or n
            begin = at
            continue
        begin = at
        if is_end:
            if tag == "p" and not any(e.tag == "p" for e in stack):
                in_body()
                place(Element("p"))
            elif tag == "br":
                in_body()
                place(Element("br"))
            elif tag == "head":
                stack[1:] = [body] if len(stack) > 1 and stack[1] is head else stack[1:]
            elif tag not in ("html", "body"):
                close({tag}, SCOPE - {tag} if tag not in TABLE_PARTS | {"td", "th", "caption"} else {"table"} - {tag})
            continue
        if tag in ("html", "body", "head"):
            known = {"html": root, "body": body, "head": head}[tag]
            known.attributes = {**attributes, **known.attributes}
            if tag == "head" and len(stack) == 1:
                stack.append(head)
            elif tag == "body":
                in_body()
            continue
        if len(stack) == 1 and tag in HEAD:
            stack.append(head)
        elif (len(stack) == 1 or stack[1] is head) and tag not in HEAD:
            in_body()
        if (outer := foreign()) and tag in ENDS_FOREIGN:
            del stack[outer:]
            outer = 0
        within = bool(outer) or tag in ("svg", "math")
        if within and closed:
            place(Element(tag, attributes, True))
            continue
        if tag in ENDS_P:
            close({"p"}, SCOPE | {"button"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag == "table" and stack[-1].tag in TABLE_PARTS:
            close({"table"}, set())
        if tag in ("td", "th", "tr") and any(s.tag == "table" for s in stack):  # implied table parts
            if stack[-1].tag == "table":
                stack[-1].children.append(part := Element("tbody"))
                stack.append(part)
            if tag != "tr" and stack[-1].tag in ("tbody", "thead", "tfoot"):
                stack[-1].children.append(part := Element("tr"))
                stack.append(part)
        node = Element(tag, attributes, within)
        place(node)
        if tag in RAW or tag in DECODED:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            raw = html[at : end.start() if end else n]
            node.children.append(unescape(raw) if tag in DECODED else raw)
            at = begin = n if not end else (html.find(">", end.start()) + 1 or n)
        elif tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)
    return root


def walk(root: Element) -> Iterator[Element]:
    todo = [root]
    while todo:
        e = todo.pop()
        yield e
        todo += [c for c in reversed(e.children) if isinstance(c, Element)]


def _feature(f: str) -> bool:
    """Whether a media feature, without its brackets, holds on SCREEN; unknown ones don't."""
    f = f.strip()
    if m := re.match(r"([\d.]+(?:px|em|rem|))\s*(<=?|>=?)\s*(width|height)\s*(.*)\Z", f):  # 400px <= width <= 700px
        return _feature(m[3] + {"<": ">", ">": "<"}[m[2][0]] + m[2][1:] + m[1]) and (not m[4] or _feature(m[3] + m[4]))
    if m := _FEATURE.match(f):
        try:
            has, asked = SCREEN[m[2]], float(m[4]) * (1 if m[5] in ("", "px") else 16)
        except ValueError:
            return False
        how = {"min-": ">=", "max-": "<="}.get(m[1]) or m[3] or "="
        return {"<=": has <= asked, ">=": has >= asked, "<": has < asked, ">": has > asked, "=": has == asked}[how]
    return re.sub(r"\s*:\s*", ":", f) in TRAITS or f in SCREEN


def holds(media: str) -> bool:
    """Whether a list of media queries holds on SCREEN. What can't be read doesn't."""
    media = " ".join(media.lower().split())
    if not media:
        return True

    def query(q: str) -> bool:
        q = q.strip()
        plain = re.match(r"(not |only )?([a-z-]+)(?: and (.*))?\Z", q)
        if plain and plain[2] != "not":
            return (plain[2] in ("all", "screen") and (not plain[3] or condition(plain[3]))) != (plain[1] == "not ")
        return condition(q)

    def condition(c: str) -> bool:
        parts, depth, start = [], 0, 0
        for i, x in enumerate(c):  # the bracketed parts and the words between them
            if x == "(":
                if not depth:
                    parts.append(c[start:i].strip())
                    start = i + 1
                depth += 1
            elif x == ")":
                depth -= 1
                if not depth:
                    parts.append(c[start:i])
                    start = i + 1
        if depth or c[start:].strip() or not parts:
            return False
        words, inner = parts[::2], parts[1::2]
        found = [condition(p) if "(" in p else condition(f"({p.strip()[4:]})") if p.strip().startswith("not ") else _feature(p) for p in inner]
        if words == ["not"]:
            return not found[0]
        if words[0] == "not" or any(w not in ("and", "or", "and not", "or not") for w in words[1:]) or words[0]:
            return False
        found = [f != w.endswith(" not") for f, w in zip(found, words, strict=True)]
        return any(found) if "or" in words[1:] else all(found)

    return any(map(query, media.split(",")))


def declarations(css: str) -> Iterator[tuple[str, bool, str]]:
    """(selectors, whether in a layer, declaration) of what holds on SCREEN, in order. Of at-rules media
    (if it holds), supports (unless it negates) and layer count; others, and rules nested in rules, don't."""
    css, start = _CSS_COMMENT.sub("", css), 0
    blocks = [("", True, False)]  # selectors, whether it holds, whether in a layer
    for m in _CSS_MARK.finditer(css):
        if m[0] not in ("{", "}", ";"):
            continue
        piece, start = css[start : m.start()].strip(), m.end()
        selectors, active, layer = blocks[-1]
        if m[0] != "{":
            if selectors and active and piece:
                yield selectors, layer, piece
            if m[0] == "}" and len(blocks) > 1:
                blocks.pop()
        elif not piece.startswith("@"):
            blocks.append((piece or "?", active and not selectors, layer))
        else:
            name = re.match(r"@[\w-]*", piece)[0].lower()
            what = piece[len(name) :]
            applies = holds(what) if name == "@media" else not re.search(r"\bnot\b", what) if name == "@supports" else name == "@layer"
            blocks.append((selectors, active and applies, layer or name == "@layer"))
    if blocks[-1][0] and blocks[-1][1] and css[start:].strip():
        yield blocks[-1][0], blocks[-1][2], css[start:].strip()


class Compound:
    """What one element has to be: of a tag, with classes, ids and attributes, at a place among its
    siblings, and not like others."""

    __slots__ = ("tag", "classes", "ids", "attributes", "places", "nots", "weight", "sign")

    def __init__(self, tag: str, classes: frozenset, ids: frozenset, attributes: tuple, places: frozenset, nots: tuple) -> None:
        self.tag, self.classes, self.ids, self.attributes, self.places, self.nots = tag, classes, ids, attributes, places, nots
        own = [len(ids), len(classes) + len(attributes) + len(places), int(bool(tag))]
        for group in nots:
            own = [x + y for x, y in zip(own, max(c.weight for c in group), strict=True)]
        self.weight = own
        self.sign = (tag, classes, ids, attributes, places, tuple(tuple(c.sign for c in group) for group in nots))

    @classmethod
    def read(cls, s: str) -> Compound | None:
        m = _COMPOUND.match(s)
        if not m or not s:
            return None
        classes, ids, attributes, places, nots = set(), set(), [], set(), []
        for p in _PART.finditer(m[2]):
            if p[1]:
                (classes if p[1] == "." else ids).add(p[2])
            elif p[3]:
                attributes.append((p[3].lower(), p[4], next((x for x in p.groups()[4:7] if x is not None), None)))
            elif p[8]:
                places.add(p[8])
            else:
                group = [cls.read(x.strip()) for x in p[9].split(",")]
                if not all(group):
                    return None
                nots.append(tuple(group))
        return cls("" if m[1] in (None, "*") else m[1].lower(), frozenset(classes), frozenset(ids), tuple(attributes), frozenset(places), tuple(nots))

    def keys(self) -> list[str]:
        """What an element must have among its own keys to fit, the more telling first."""
        return ["#" + i for i in sorted(self.ids)] + ["." + c for c in sorted(self.classes)] + ["[" + k for k, _, _ in self.attributes] + [self.tag] * bool(self.tag)


def _has(value: str | None, how: str | None, wanted: str | None) -> bool:
    if value is None or wanted is None:
        return value is not None
    if not how:
        return value == wanted
    if not wanted:
        return False
    return {"~": wanted in value.split(), "|": value == wanted or value.startswith(wanted + "-"), "^": value.startswith(wanted), "$": value.endswith(wanted), "*": wanted in value}[how]


def keys_of(e: Element) -> list[str]:
    """By what the rules for an element are found."""
    a = e.attributes
    return ["", e.tag, *(["#" + a["id"]] if "id" in a else []), *("." + c for c in set(a.get("class", "").split())), *("[" + k for k in a)]


class Rule:
    """A selector's compounds and what stands between them, a declaration, and its rank. What is found
    out about an element's ancestors and earlier siblings is kept, so each is looked at once."""

    __slots__ = ("chain", "links", "what", "value", "rank", "above", "before")

    def __init__(self, chain: list[Compound], links: list[str], what: str, value: str, rank: tuple) -> None:
        self.chain, self.links, self.what, self.value, self.rank = chain, links, what, value, rank
        self.above: dict[tuple[int, int], bool] = {}
        self.before: dict[tuple[int, int], bool] = {}

    def ancestors(self) -> list[Compound]:
        """Compounds that one of the ancestors of a fitting element fits."""
        return [c for c, link in zip(self.chain, self.links[1:], strict=False) if link in (" ", ">")]


class Styles:
    """What isn't displayed, with all it holds, what shape each element has, what visibility and which
    white space: by elements that never are displayed, attributes, style elements and inline styles, of
    which the one that wins in a browser counts. Selectors: tags, classes, ids, attributes, :not(), :root,
    first, last and only children; descendants, children and siblings. Others are no rules. Media are
    judged for SCREEN.

    Rules are found by what their last compound needs of the element, and among these by what they
    need of one of its ancestors, in both by what the fewest rules need; so a rule costs something only
    where it may hold."""

    def __init__(self, root: Element) -> None:
        self.won: dict[int, dict[str, tuple]] = {}  # of elements that rules hold for
        self.up: dict[int, Element] = {}
        self.place: dict[int, tuple[list[Element], int]] = {}
        rules = self._rules(root)
        if rules:
            self._apply(root, rules)

    def _rules(self, root: Element) -> list[Rule]:
        found, n = [], 0
        for e in walk(root):
            if e.tag == "style" and e.children and holds(e.attributes.get("media", "")):
                for selectors, layer, piece in declarations(str(e.children[0])):
                    if m := _DECLARED.match(piece):
                        n += 1
                        found += [(s, layer, m[1].lower(), m[2].lower(), bool(m[3]), n) for s in _LISTED.split(selectors)]
        best: dict[tuple, Rule] = {}  # of rules for the same elements the one that wins
        known: dict[str, Compound | None] = {}
        for s, layer, what, value, strong, n in found:
            chain, links, link = [], [], ""
            for token in _SELECTOR.findall(s.strip()):
                if token in (">", "+", "~"):
                    if not chain or link not in ("", " "):
                        chain = []
                        break
                    link = token
                    continue
                if token not in known:
                    known[token] = Compound.read(token)
                chain.append(known[token])
                links.append(link if len(chain) > 1 else "")
                link = " "
            if not chain or not all(chain) or link != " ":
                continue
            rank = (strong, False, layer == strong, *[sum(x) for x in zip(*(c.weight for c in chain), strict=True)], n)
            sign = (what, tuple(c.sign for c in chain), tuple(links))
            if sign not in best or rank > best[sign].rank:
                best[sign] = Rule(chain, links, what, value, rank)
        return list(best.values())

    def _apply(self, root: Element, rules: list[Rule]) -> None:
        uses: dict[str, int] = {}
        for r in rules:
            for k in {k for c in r.chain for k in c.keys()}:
                uses[k] = uses.get(k, 0) + 1
        index: dict[str, dict[str, list[Rule]]] = {}
        for r in rules:
            own = min(r.chain[-1].keys(), key=uses.get, default="")
            far = min((k for c in r.ancestors() for k in c.keys()), key=uses.get, default="")
            index.setdefault(own, {}).setdefault(far, []).append(r)
        if any(len(r.chain) > 1 or r.chain[-1].places or any(c.places for g in r.chain[-1].nots for c in g) for r in rules):
            for e in walk(root):
                kids = [c for c in e.children if isinstance(c, Element)]
                for i, c in enumerate(kids):
                    self.up[id(c)], self.place[id(c)] = e, (kids, i)
        on_path: dict[str, int] = {}  # keys of the open elements, and how many have them
        todo: list[tuple[Element, list[str] | None]] = [(root, None)]
        while todo:
            e, opened = todo.pop()
            if opened is not None:
                for k in opened:
                    on_path[k] -= 1
                    if not on_path[k]:
                        del on_path[k]
                continue
            keys, won = keys_of(e), {}
            for k in keys:
                groups = index.get(k)
                if not groups:
                    continue
                for far in ("", *(on_path if len(on_path) < len(groups) else groups)):
                    if far in groups and (not far or far in on_path):
                        for r in groups[far]:
                            if (r.what not in won or r.rank > won[r.what][0]) and self._at(r, e, len(r.chain) - 1):
                                won[r.what] = (r.rank, r.value)
            if won:
                self.won[id(e)] = won
            kids = [c for c in e.children if isinstance(c, Element)]
            if kids:
                for k in keys[1:]:
                    on_path[k] = on_path.get(k, 0) + 1
                todo.append((e, keys[1:]))
                todo += [(c, None) for c in reversed(kids)]

    def _fits(self, e: Element, c: Compound) -> bool:
        a = e.attributes
        return (
            (not c.tag or c.tag == e.tag)
            and (not c.classes or c.classes <= set(a.get("class", "").split()))
            and (not c.ids or c.ids <= {a.get("id")})
            and all(_has(a.get(k), how, v) for k, how, v in c.attributes)
            and (not c.places or self._placed(e, c.places))
            and not any(self._fits(e, x) for group in c.nots for x in group)
        )

    def _placed(self, e: Element, places: frozenset) -> bool:
        kids, i = self.place.get(id(e), ([e], 0))
        first, last = i == 0, i == len(kids) - 1
        is_ = {"first-child": first, "last-child": last, "only-child": first and last, "root": id(e) not in self.up}
        return all(is_[p] for p in places)

    def _previous(self, e: Element) -> Element | None:
        kids, i = self.place.get(id(e), ([], 0))
        return kids[i - 1] if i else None

    def _at(self, r: Rule, e: Element | None, k: int) -> bool:
        """Whether the beginning of a rule's chain, up to k, ends at e."""
        if e is None or not self._fits(e, r.chain[k]):
            return False
        if not k:
            return True
        link = r.links[k]
        if link == ">":
            return self._at(r, self.up.get(id(e)), k - 1)
        if link == "+":
            return self._at(r, self._previous(e), k - 1)
        if link == " ":
            return self._any(r, self.up.get(id(e)), k - 1, r.above, lambda x: self.up.get(id(x)))
        return self._any(r, self._previous(e), k - 1, r.before, self._previous)

    def _any(self, r: Rule, e: Element | None, k: int, known: dict, onward) -> bool:  # noqa: ANN001
        """Whether the chain up to k ends at e or at one of those that follow onward."""
        met = []
        while e is not None and (id(e), k) not in known:
            met.append(e)
            e = onward(e)
        found = e is not None and known[id(e), k]
        for x in reversed(met):
            found = found or self._at(r, x, k)
            known[id(x), k] = found
        return found

    def _declared(self, e: Element) -> dict[str, tuple]:
        won = self.won.get(id(e), {})
        if "style" in e.attributes:
            won = dict(won)
            for n, piece in enumerate(_CSS_COMMENT.sub("", e.attributes["style"]).split(";")):
                if m := _DECLARED.match(piece.strip()):
                    rank = (bool(m[3]), True, n)
                    if m[1].lower() not in won or rank > won[m[1].lower()][0]:
                        won[m[1].lower()] = (rank, m[2].lower())
        return won

    def __call__(self, e: Element, seen: bool = True) -> tuple[bool, bool]:
        """Whether e is left out with all it holds, and whether it is visible, its parent being so or not."""
        if e.tag in UNSEEN or (e.foreign and e.tag in FOREIGN_UNSEEN):
            return True, False
        own = "hidden" in e.attributes or (e.tag == "dialog" and "open" not in e.attributes)  # as browsers have it without styles
        won = self._declared(e)
        if not won:
            return own, seen
        display, visibility = won.get("display", ((), "revert"))[1], won.get("visibility", ((), "inherit"))[1]
        gone = (own if display.startswith("revert") else display == "none") or (visibility == "collapse" and e.tag in TABLE_PARTS)
        return gone, False if visibility in ("hidden", "collapse") else True if visibility in ("visible", "initial") else seen

    def shape(self, e: Element) -> tuple[str, bool]:
        """Whether e is a block, inline, or inline and apart, and whether its children are boxes of their own."""
        display = self._declared(e).get("display", ((), ""))[1]
        usual = "block" if e.tag in BLOCK else "apart" if e.tag in APART or e.tag in CONTROLS else "inline"
        if display in ("initial", "unset"):
            return "inline", False
        return SHAPES.get(display, usual), display in SPLIT

    def space(self, e: Element, outer: str | None) -> str | None:
        """What e keeps of its white space, its parent keeping some; None is what the flow does."""
        return KEPT.get(self._declared(e).get("white-space", ((), "inherit"))[1], outer)


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in s)


def _number(value: str | None, default: int, most: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", value or "")
    return min(int(m[1]), most) if m else default


def marker(n: int, kind: str) -> str:
    """The mark of an item of a numbered list: its number, or by the list's type letters or Roman numerals
    where these exist."""
    if kind in ("a", "A") and n > 0:
        s = ""
        while n:
            n, k = divmod(n - 1, 26)
            s = chr(ord(kind) + k) + s
        return s + ". "
    if kind in ("i", "I") and 0 < n < 4000:
        s = ""
        for value, digits in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "M CM D CD C XC L XL X IX V IV I".split(), strict=True):
            s += digits * (n // value)
            n %= value
        return (s if kind == "I" else s.lower()) + ". "
    return f"{n}. "


class Renderer:
    """Lines of one flow of content; nested flows (items, cells, quotes) have a renderer of their own.

    What is not visible keeps its place as a space; what it holds may be visible again."""

    def __init__(self, styles: Styles, pre: bool = False, seen: bool = True, depth: int = 0, space: str | None = None) -> None:
        self.styles, self.pre, self.seen, self.depth, self.space = styles, pre, seen, depth, space
        self.split = False  # whether what is visited stands in a box of boxes
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.margin = 0  # empty lines owed before what comes next

    def flush(self) -> None:
        if not self.inline:
            return
        s = "".join(self.inline)
        self.inline = []
        if self.pre:
            s = s.removesuffix("\n")
            rows = s.split("\n") if s else []
        else:
            rows = [_SPACE.sub(" ", r).strip(" ") for r in s.split("\0")]
            if rows and not rows[-1]:
                rows.pop()
            if "\1" in s or "\2" in s:  # spaces and tabs that are kept
                rows = [r.replace("\1", " ").replace("\2", "\t") for r in rows]
        self.put(rows, 0)

    def put(self, rows: list[str], margin: int) -> None:
        if rows:
            if self.lines:
                self.lines += [""] * max(self.margin, margin)
            self.lines += rows
            self.margin = margin

    def owe(self, margin: int) -> None:
        self.margin = max(self.margin, margin)

    def within(self, e: Element, seen: bool, pre: bool | None = None) -> list[str]:
        inner = Renderer(self.styles, self.pre if pre is None else pre, seen, self.depth + 1, None if pre else self.space)
        inner.space = self.styles.space(e, inner.space)
        for c in e.children:
            inner.visit(c)
        inner.flush()
        return inner.lines

    def indented(self, rows: list[str], first: str, rest: str) -> list[str]:
        if self.depth >= INDENTED:
            first, rest = first.lstrip(" "), ""
        return [((rest if k else first) + r).rstrip(" ") if r or not k else "" for k, r in enumerate(rows)]

    def text(self, s: str) -> str:
        """Text with what is kept of its white space told by other characters, as the flow's end folds it."""
        if self.pre:
            return _SPACE.sub(" ", s) if self.space == "" else s
        s = s.translate(_MARKS)
        if self.space == "pre":
            return s.replace("\r\n", "\n").replace("\n", "\0").replace(" ", "\1").replace("\t", "\2")
        return s.replace("\r\n", "\n").replace("\n", "\0") if self.space == "lines" else s

    def visit(self, c: Element | str) -> None:
        if isinstance(c, str):
            if self.seen:
                self.inline.append(self.text(c))
            elif c:
                self.inline.append(" ")
            return
        outer, space, split = self.seen, self.space, self.split
        gone, self.seen = self.styles(c, outer)
        if not gone:
            self.space, self.split = self.styles.space(c, space), False
            self.element(c, split)
        self.seen, self.space, self.split = outer, space, split

    def element(self, c: Element, boxed: bool = False) -> None:
        """boxed: whether c stands in a box of boxes, and so apart from its siblings."""
        tag = c.tag
        shape, split = self.styles.shape(c)
        if tag == "br":
            self.inline.append("\n" if self.pre else "\0")
        elif tag == "input":
            if self.seen and c.attributes.get("type", "").lower() in TEXT_INPUTS:
                self.inline += [" ", self.text(c.attributes.get("value") or c.attributes.get("placeholder", "")), " "]
        elif shape != "block" and tag != "table":
            spaced = shape == "apart" or boxed
            if spaced:
                self.inline.append(" ")
            if tag == "textarea" and self.space is None:
                self.space = "pre"
            self.split = split
            for k, x in enumerate(c.children):
                self.visit(x.removeprefix("\n") if tag == "textarea" and not k and isinstance(x, str) else x)
            if spaced:
                self.inline.append(" ")
        else:
            self.flush()
            margin = 1 if tag in SPACED else 0
            if tag in ("ul", "ol", "menu"):
                self.put(self.items(c), margin)
            elif tag == "table":
                self.put(self.grid(c), margin)
            elif tag == "pre":
                rows = self.within(c, self.seen, True)
                self.put(rows[1:] if rows and not rows[0] else rows, margin)
            elif tag == "hr":
                self.put(["---"] if self.seen else [], margin)
            elif tag in ("blockquote", "dd"):
                self.put(self.indented(self.within(c, self.seen), "    ", "    "), margin)
            elif tag == "li":  # outside a list
                self.put(self.item(c, "- ", self.seen), 0)
            elif tag == "details" and "open" not in c.attributes:
                for x in c.children:
                    if isinstance(x, Element) and x.tag == "summary":
                        self.visit(x)
            else:
                self.owe(margin)
                self.split = split
                for x in c.children:
                    self.visit(x)
                self.flush()
                self.owe(margin)

    def item(self, e: Element, mark: str, seen: bool) -> list[str]:
        rows = self.within(e, seen)
        if not seen and not rows:
            return []
        return self.indented(rows or [""], mark if seen else " " * len(mark), " " * len(mark))

    def items(self, e: Element) -> list[str]:
        shown = {id(c): state for c in e.children if isinstance(c, Element) and c.tag == "li" and not (state := self.styles(c, self.seen))[0]}
        numbered, back, kind = e.tag == "ol", "reversed" in e.attributes, e.attributes.get("type", "1")
        n = _number(e.attributes.get("start"), len(shown) if back else 1, 10**9)
        rows: list[str] = []
        line = Renderer(self.styles, self.pre, self.seen, self.depth + 1, self.space)  # of items that are no blocks

        def end() -> None:
            nonlocal line
            line.flush()
            rows.extend(line.lines)
            line = Renderer(self.styles, self.pre, self.seen, self.depth + 1, self.space)

        for c in e.children:
            if isinstance(c, str) and not c.strip():
                continue
            if isinstance(c, Element) and c.tag == "li":
                if id(c) not in shown:
                    continue
                if self.styles.shape(c)[0] != "block":
                    line.split = True
                    line.visit(c)
                    continue
                end()
                n = _number(c.attributes.get("value"), n, 10**9)
                rows += self.item(c, marker(n, c.attributes.get("type", kind)) if numbered else "- ", shown[id(c)][1])
                n += -1 if back else 1
            else:
                end()
                inner = Renderer(self.styles, self.pre, self.seen, self.depth + 1, self.space)
                inner.visit(c)
                inner.flush()
                rows += self.indented(inner.lines, "  ", "  ")
        end()
        return rows

    def grid(self, e: Element) -> list[str]:
        """Rows with each column as wide as its widest cell, up to WIDEST, two spaces between columns; the
        caption on top, the foot below the body. A cell of many lines makes a row of as many."""
        caption: list[str] = []
        parts: dict[str, list[tuple[Element, bool]]] = {"thead": [], "tbody": [], "tfoot": []}
        for c in e.children:
            if isinstance(c, Element):
                gone, seen = self.styles(c, self.seen)
                if gone:
                    continue
                if c.tag == "caption":
                    caption += self.within(c, seen)
                elif c.tag in parts:
                    for r in c.children:
                        if isinstance(r, Element) and r.tag == "tr":
                            state = self.styles(r, seen)
                            if not state[0]:
                                parts[c.tag].append((r, state[1]))
        rows: list[list[tuple[int, int, list[str], bool]]] = []
        taken: dict[int, tuple[int, int]] = {}  # column: the row up to which a cell from above covers it, and where that cell ends
        for y, (r, seen) in enumerate([*parts["thead"], *parts["tbody"], *parts["tfoot"]]):
            cells, col = [], 0
            for c in r.children:
                if isinstance(c, Element) and c.tag in ("td", "th"):
                    gone, cell_seen = self.styles(c, seen)
                    if gone:
                        continue
                    first, until = col, MOST_ROWS + len(rows) + y
                    while (over := taken.get(col)) and over[0] > y:
                        until, col = min(until, over[0]), over[1]
                    if col > first:  # so that the next row goes there at once
                        taken[first] = until, col
                    span = max(1, _number(c.attributes.get("colspan"), 1, MOST_COLUMNS))
                    deep = max(1, _number(c.attributes.get("rowspan"), 1, MOST_ROWS))
                    right = c.attributes.get("align", "").lower() == "right" or "text-align:right" in c.attributes.get("style", "").replace(" ", "").lower()
                    cells.append((col, span, self.within(c, cell_seen), right))
                    if deep > 1:
                        taken.update(dict.fromkeys(range(col, min(col + span, COLUMNS)), (y + deep, col + span)))
                    col += span
            rows.append(cells)
        wide: dict[int, int] = {}
        for cells in rows:  # single cells set the widths
            for col, span, lines, _ in cells:
                if span == 1 and (need := max(map(width, lines), default=0)):
                    wide[col] = max(wide.get(col, 0), min(WIDEST, need))
        used = sorted(wide)
        for cells in rows:  # then spanning ones widen their last column; columns without text take no room
            for col, span, lines, _ in cells:
                if span > 1 and (need := min(WIDEST, max(map(width, lines), default=0))):
                    last = col + span - 1
                    before = used[bisect_left(used, col) : bisect_left(used, last)]
                    room = sum(wide[k] for k in before)
                    if last in wide or need > room + 2 * max(0, len(before) - 1):
                        if last not in wide:
                            insort(used, last)
                        wide[last] = max(wide.get(last, 0), need - room - 2 * len(before), 1)
        start, x = {}, 0
        for k in used:
            start[k] = x
            x += wide[k] + 2
        out = list(caption)
        for cells in rows:
            placed = []  # cells with lines, where each begins and its room
            for col, span, lines, right in cells:
                own = used[bisect_left(used, col) : bisect_left(used, col + span)] if any(lines) else []
                if own:
                    placed.append((lines, start[own[0]], start[own[-1]] + wide[own[-1]] - start[own[0]], right))
            for i in range(max((len(lines) for lines, *_ in placed), default=0)):
                row, at = [], 0
                for lines, left, room, right in placed:
                    if i < len(lines) and lines[i]:
                        size = width(lines[i])
                        gap = max(min(ALIGNED, left + (max(0, room - size) if right else 0)) - at, 2 if at else 0)
                        row += [" " * gap, lines[i]]
                        at += gap + size
                out.append("".join(row).rstrip(" "))
        return out


def title(root: Element) -> str | None:
    found = next((e for e in walk(root) if e.tag == "title"), None)
    return _SPACE.sub(" ", "".join(c for c in found.children if isinstance(c, str))).strip(" ") if found else None


def extract(html: str | None) -> tuple[str | None, str]:
    """(title, visible text) of a page."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))
    root = parse(html or "")
    return title(root), "\n".join(Renderer(Styles(root), depth=-1).within(root, True))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [extract(h.as_py()) for h in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in made], pa.string()), pa.array([x for _, x in made], pa.string())], ["page_id", "title", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages(page_id, html): page_id, title, text.

    Row by row, without a shuffle. A null or empty page has the text '' and a null title, as has a
    page without one. Time grows with the length of a page, whatever it holds, and so does the text.
    Repeated rows repeat; empty tables give no rows; other columns are not read, whatever their names.
    Ties can't occur. Nesting beyond DEEPEST (256) is flattened, and no text is lost by it, nor by the
    bounds of the layout: levels beyond INDENTED (16) are indented no more; a cell aligns what follows
    it up to WIDEST (120) columns, and a row up to ALIGNED (400), cells beyond follow each other; cells from
    above are minded in the first COLUMNS (4,096) columns of a table. Every style rule is judged for
    every element it may hold for, however many there are. Labels of svg and formulas of math are text of their line; what svg only shows
    through a use element is left out. A tag that never ends is text."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return narrow(pages, "page_id", "html").mapInArrow(_extracted, f"page_id {kind}, title string, text string")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_text over pages, all rows and whole pages."""
    return extract_text(table(spark, sf_dir, "pages"))
