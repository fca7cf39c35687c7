"""Problem 1: statements that still carry HTML, Markdown, wiki or LaTeX markup, made clean text.

Method: tree scoring. Formulas and code are set aside; what the four syntaxes say about blocks, links and
emphasis becomes one kind of marks, and from these a tree of blocks is built. A paragraph earns points
for its length and commas; they pass in full to its parent, half to its grandparent and a falling share
to the next ancestors (``ANCESTORS`` in all), and every container's sum is discounted by the share of its text that is link
text. The best container is kept, and its siblings that score near it or look like text or structure.
Headings, lists, code blocks, quotes, tables and formulas come out in one plain notation.

Everything is decided within a record, so the operator is a map over the rows without any shuffle.

Defined results
* a null text gives a null clean text and no kinds; an empty or blank one gives an empty text;
* text without markup comes back as it is, but for runs of blanks; unclosed constructs are text;
* constructs in a part that is not kept still count as kinds; code is never searched for other markup;
* formulas ($..$, $$..$$, \\(..\\), \\[..\\]) are content and are copied letter by letter;
* characters of the private planes 15 and 16 are removed: they stand for the parts set aside;
* any depth of nesting and any number of parts is read, in time that grows with the length; lists, quotes and headings
  within more than ``DEEP`` of their kind are shown as plain paragraphs there;
* a text that cannot be read comes back as it is, with the reason in ``failure``;
* repeated rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")

# fixed values: names of HTML elements
BLOCK_TAGS = "article aside blockquote body div dl dd dt fieldset figure footer form header h1 h2 h3 h4 h5 h6 hr html li main nav ol p section table tbody td tfoot th thead tr ul center"
INLINE_TAGS = "a abbr acronym address b big br cite code del dfn em font head i img input ins kbd label link mark math meta noscript q ref s samp script small source span strike strong style sub sup svg tt title u var wbr nowiki pre button iframe caption col colgroup details summary time"
BOILERPLATE = {"nav", "footer", "aside", "form", "header"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
STRUCTURE = HEADINGS | {"ul", "ol", "li", "code", "table", "blockquote", "math"}

_ALL_TAGS = "|".join(sorted((BLOCK_TAGS + " " + INLINE_TAGS).split(), key=len, reverse=True))
_BLOCKS = set(BLOCK_TAGS.split())

#: Marks: open NAME, close NAME, end of name, link from, link to; parts set aside count up from HELD and LOW.
OPEN, CLOSE, END, LINK, UNLINK, HELD = "\U000f0000", "\U000f0001", "\U000f0002", "\U000f0003", "\U000f0004", 0xF0010
#: A part set aside is two characters, one of each private plane; so there can be more of them than a text has characters.
LOW, SPAN = 0x100000, 0xFFE0
_PRIVATE = re.compile("[\U000f0000-\U0010ffff]")
_HELD = re.compile("([\U000f0010-\U000fffff])([\U00100000-\U0010ffff])")

#: What begins a part that is set aside; of several at one place the first holds.
_OPENER = re.compile(
    r"""(?P<fence>```|~~~)|(?P<comment><!--)|<(?P<pre>pre|script|style)\b[^<>]*>
    |\\begin\{(?P<verb>verbatim|lstlisting|minted)\*?\}|\\begin\{(?P<display>equation|align|gather|multline|eqnarray|displaymath)\*?\}
    |(?P<dollars>\$\$)|(?P<dollar>(?<!\\)\$)|(?P<round>\\\()|(?P<square>\\\[)|<(?P<code>code|tt|kbd|samp)\b[^<>]*>|(?P<tick>(?<!`)`)""",
    re.I | re.X,
)
_TICK = re.compile(r"`[^`\n]+`(?!`)")
#: What no text without markup has; one of these or a line that begins like a block.
_TRIGGER = re.compile(r"[<&\\`*_~]|''|\[\[|\{\{|\]\(|\[https?:|^[ \t]{0,3}(?:#{1,6}\s|>|=)|^.*\|.*$|^={2,}|^-{3,}\s*$|^[ \t]*(?:[-*+•]|\d+[.)])\s", re.M)
_TAG = re.compile(rf"<(/?)({_ALL_TAGS})(?=[\s/>])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_DOCTYPE = re.compile(r"<!doctype[^<>]*>|<\?xml[^<>]*\?>", re.I)
_ENTITY = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

_WIKI_HEADING = re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\n](?:[^\n]*?[^=\n])?)[ \t]*\1[ \t]*$", re.M)
_WIKI_FILE = re.compile(r"\[\[\s*(?:category|file|image)\s*:[^\[\]]*\]\]", re.I)
_WIKI_LINK = re.compile(r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]")
_WIKI_OUTER = re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:\s+([^\[\]\n]*))?\](?!\()")
_TEMPLATE = re.compile(r"\{\{\s*([A-Za-z][\w \-:/']*?)\s*(?:\|([^{}]*))?\}\}")
_WIKI_EMPHASIS = re.compile(r"(?<![\w'’)\]}])('{2,3}|'{5})(?=[^\s'])((?:[^\n']|'(?!'))*[^\s'])\1(?![\w'])")

_MD_HEADING = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
_MD_SETEXT = re.compile(r"^(?=[^\n|]*\w)([^\n|]+)\n(={3,}|-{3,})[ \t]*$", re.M)
_MD_IMAGE_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\(([^()\s]*(?:\s+\"[^\"]*\")?)\)")
_MD_QUOTE = re.compile(r"^[ ]{0,3}>[ \t]?(?=[^\s=])", re.M)
_MD_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$", re.M)
_MD_STRONG = re.compile(r"(?<![\w\\*])(\*\*\*|\*\*)(?=[^\s*])((?:(?!\n\n)[^*])+?)(?<=\S)\1(?!\*)|(?<![\w\\])(__)(?=[^\s_])([^_\n]+?)(?<=\S)__(?!\w)")
_MD_EM = re.compile(r"(?<![\w\\*)\]}])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w\\_)\]}^])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])")
_MD_STRIKE = re.compile(r"~~(?=\S)([^~\n]+?)(?<=\S)~~")

_TEX_QUOTE = re.compile(r"``((?:(?!``|'').)+?)''", re.S)
_TEX_HEADING = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\s*\{([^{}]*)\}")
_TEX_ENV = re.compile(r"\\(begin|end)\s*\{([A-Za-z]+)\*?\}(?:\[[^\[\]\n]*\])?")
_TEX_ITEM = re.compile(r"\\item\b[ \t]*(?:\[([^\[\]\n]*)\])?")
_TEX_DROP = re.compile(r"(?<![ \t~])[ \t~]*\\(?:label|cite[a-z]*|bibitem|hspace|vspace|color|pagestyle|index|input|include|usepackage|documentclass)\*?\s*(?:\[[^\[\]\n]*\]\s*)*\{[^{}]*\}")
_TEX_REF = re.compile(r"\\(?:[a-zA-Z]*ref)\*?\s*\{[^{}]*\}")
_TEX_NOTE = re.compile(r"\\(?:footnote|thanks|marginpar)\s*\{([^{}]*)\}")
_TEX_COLOUR = re.compile(r"\\(?:textcolor|colorbox|href)\s*(?:\[[^\[\]\n]*\])?\{[^{}]*\}\s*\{([^{}]*)\}")
_TEX_WRAP = re.compile(r"\\[A-Za-z]+\*?\s*(?:\[[^\[\]\n]*\])?\{([^{}]*)\}")
_TEX_WORD = re.compile(r"\\(?:\\|[A-Za-z]+\*?[ \t]?|[%&_#{}$,;:!@~'\"`^=.-])")
_TEX_TIE = re.compile(r"(?<=\w)~(?=[\w\\])")
# fixed values: environments that are lists, and what a character escape stands for
LIST_ENVS = {"itemize": "ul", "enumerate": "ol", "description": "ul"}
ESCAPES = {"\\%": "%", "\\&": "&", "\\_": "_", "\\#": "#", "\\{": "{", "\\}": "}", "\\$": "$", "\\\\": "\n", "\\@": ""}
TEX_LEVEL = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}

_LIST_LINE = re.compile(r"^[ \t]*([-*+•]|\d{1,3}[.)])[ \t]+(?=\S)", re.M)
_MARK = re.compile(f"[{OPEN}{CLOSE}][a-z0-9]+{END}")
_BLANKS = re.compile(r"[ \t\xa0]+")
#: Longer runs of blanks and of empty lines mean no more than these, and cost time in every pattern.
_WIDE, _TALL = re.compile(r"[ \t]{9,}"), re.compile(r"\n(?:[ \t]*\n){3,}")
#: Ancestors that a paragraph passes points to, and how deep lists, quotes and the like are shown within each other.
ANCESTORS, DEEP = 5, 32


def block(name: str, text: str) -> str:
    return f"{OPEN}{name}{END}{text}{CLOSE}{name}{END}"


class Aside:
    """Parts set aside, each standing in the text as two private characters."""

    def __init__(self):
        self.parts: list[tuple[str, str]] = []

    def put(self, kind: str, text: str) -> str:
        high, low = divmod(len(self.parts), SPAN)
        self.parts.append((kind, text))
        return chr(HELD + high) + chr(LOW + low)

    def plain(self, text: str) -> str:
        while _HELD.search(text):
            text = _HELD.sub(lambda m: self.parts[(ord(m[1]) - HELD) * SPAN + ord(m[2]) - LOW][1], text)
        return text


class Ends:
    """Where the parts of a text end. What has no end after one place has none after a later one, so each is looked for in vain once."""

    def __init__(self, text: str):
        self.text, self.gone = text, set()

    def find(self, end: str, start: int) -> int:
        """The place behind the next end (plain text, or a pattern if it begins with a bracket), or -1."""
        if end in self.gone:
            return -1
        if end[0] == "(":
            m = re.compile(end, re.I).search(self.text, start)
            at = m.end() if m else -1
        else:
            at = self.text.find(end, start)
            at = at + len(end) if at >= 0 else -1
        if at < 0:
            self.gone.add(end)
        return at

    def of(self, m: re.Match) -> int:
        """The place behind the part that an opener begins, or -1 if it begins none."""
        kind, start = m.lastgroup, m.end()
        if kind == "fence":
            return self.find(m[0], start)
        if kind == "comment":
            return self.find("-->", start)
        if kind in ("pre", "code"):
            return self.find(rf"(?:</{m[kind].lower()}\s*>)", start)
        if kind in ("verb", "display"):
            return self.find(rf"(?:\\end\{{{m[kind].lower()}\*?\}})", start)
        if kind in ("round", "square"):
            return self.find("\\)" if kind == "round" else "\\]", start + 1)
        if kind == "tick":
            t = _TICK.match(self.text, m.start())
            return t.end() if t else -1
        at = self.find("$", start)  # a formula in dollars holds none
        if kind == "dollar":
            return at if at > start + 1 else -1
        return at + 1 if at > start + 1 and self.text.startswith("$", at) else -1


def _set_aside(text: str, kinds: set[str]) -> tuple[str, Aside]:
    aside, ends, out, done, pos = Aside(), Ends(text), [], 0, 0
    while (m := _OPENER.search(text, pos)) is not None:
        end = ends.of(m)
        if end < 0:
            pos = m.start() + 1
            continue
        out += [text[done : m.start()], _part(m.lastgroup, text[m.start() : end], kinds, aside)]
        done = pos = end
    return "".join(out) + text[done:], aside


def _part(kind: str, s: str, kinds: set[str], aside: Aside) -> str:
    if kind in ("dollars", "dollar", "round", "square"):
        return aside.put("math", s)
    if kind == "display":
        kinds.add("latex")
        body = re.sub(r"\\(?:begin|end)\{[a-z]+\*?\}|\\label\{[^{}]*\}", "", s, flags=re.I).strip()
        return block("math", aside.put("math", f"$${body}$$"))
    if kind == "fence":
        kinds.add("markdown")
        return block("code", aside.put("code", re.sub(r"^[\w+#-]*\n", "", s[3:-3]).strip("\n")))
    if kind == "tick":
        kinds.add("markdown")
        return aside.put("tick", s)
    if kind == "verb":
        kinds.add("latex")
        return block("code", aside.put("code", re.sub(r"\\(?:begin|end)\{[a-z]+\*?\}(?:\[[^\[\]\n]*\])?", "", s, flags=re.I).strip("\n")))
    kinds.add("html")
    if kind == "comment" or s[1:7].lower() in ("script", "style>", "style "):
        return ""
    inner = html.unescape(re.sub(r"</?[a-zA-Z][^<>]*>", "", s))
    return block("code", aside.put("code", inner.strip("\n"))) if kind == "pre" else aside.put("tick", f"`{inner}`")


def _html(text: str, kinds: set[str]) -> str:
    def tag(m: re.Match) -> str:
        kinds.add("html")
        close, name = m[1], m[2].lower()
        if name == "br":
            return "\n"
        if name == "hr":
            return "\n\n"
        if name == "a":
            return UNLINK if close else LINK
        if name in ("sub", "sup"):
            return ("}" if close else "_{" if name == "sub" else "^{") if not m[3].endswith("/") else ""
        if name in _BLOCKS:
            return f"{CLOSE if close else OPEN}{name}{END}"
        return ""

    def entity(m: re.Match) -> str:
        if m[1][0] != "#" and m[1] + ";" not in html5:
            return m[0]
        kinds.add("html")
        return html.unescape(m[0]).replace("\xa0", " ")

    if "<" in text:
        text, n = _DOCTYPE.subn("", text)
        if n:
            kinds.add("html")
        text = _TAG.sub(tag, text)
    return _ENTITY.sub(entity, text) if "&" in text else text


def _wiki(text: str, kinds: set[str]) -> str:
    def template(m: re.Match) -> str:
        name, args = m[1].lower(), dict(re.findall(r"(?:^|\|)\s*(\w+)\s*=\s*([^|]*)", m[2] or ""))
        if name == "eqn":
            return block("math", " = ".join(x.strip() for x in (args.get("l", ""), args.get("r", "")) if x.strip()))
        return ""

    n = 0
    if "==" in text:
        text, k = _WIKI_HEADING.subn(lambda m: block(f"h{len(m[1])}", m[2]), text)
        n += k
    if "[" in text:
        text, k = _WIKI_FILE.subn("", text)
        text, j = _WIKI_LINK.subn(lambda m: f"{LINK}{m[2] if m[2] else m[1]}{UNLINK}", text)
        text, i = _WIKI_OUTER.subn(lambda m: f"{LINK}{m[1] or ''}{UNLINK}", text)
        n += k + j + i
    if "{{" in text:
        for _ in range(4):  # templates within templates
            text, k = _TEMPLATE.subn(template, text)
            n += k
            if not k:
                break
    if "''" in text:
        for _ in range(3):
            text, k = _WIKI_EMPHASIS.subn(r"\2", text)
            n += k
    if n:
        kinds.add("wiki")
    return text


def _markdown(text: str, kinds: set[str]) -> str:
    n = 0
    if "#" in text:
        text, k = _MD_HEADING.subn(lambda m: block(f"h{len(m[1])}", m[2]), text)
        n += k
    if "===" in text or "---" in text:
        text, k = _MD_SETEXT.subn(lambda m: block("h1" if m[2][0] == "=" else "h2", m[1].strip()), text)
        n += k
    if "|" in text and "--" in text and _MD_RULE.search(text):
        n += 1
        lines, out, i = text.split("\n"), [], 0
        while i < len(lines):
            if i + 1 < len(lines) and "|" in lines[i] and _MD_RULE.match(lines[i + 1]):
                rows = [lines[i]]
                i += 2
                while i < len(lines) and "|" in lines[i]:
                    rows.append(lines[i])
                    i += 1
                cells = (" | ".join(c.strip() for c in r.strip().strip("|").split("|")) for r in rows)
                out.append(block("table", "".join(block("tr", c) for c in cells)))
            else:
                out.append("" if _MD_RULE.match(lines[i]) else lines[i])
                i += 1
        text = "\n".join(out)
    if "](" in text:
        text, k = _MD_IMAGE_LINK.subn(lambda m: f"{LINK}{m[1]}{UNLINK}", text)
        n += k
    if ">" in text:
        lines, quoted, out = text.split("\n"), [], []
        for line in lines + [None]:
            if line is not None and (m := _MD_QUOTE.match(line)):
                n += 1
                quoted.append(line[m.end() :])
                continue
            if quoted:
                out.append(block("blockquote", "\n".join(quoted)))
                quoted = []
            if line is not None:
                out.append(line)
        text = "\n".join(out)
    if "*" in text or "_" in text:
        text, k = _MD_STRONG.subn(lambda m: m[2] or m[4], text)
        text, j = _MD_EM.subn(lambda m: m[1] or m[2], text)
        n += k + j
    if "~~" in text:
        text, k = _MD_STRIKE.subn(r"\1", text)
        n += k
    if n:
        kinds.add("markdown")
    return text


def _latex(text: str, kinds: set[str]) -> str:
    n = 0
    if "``" in text:
        text, k = _TEX_QUOTE.subn(r'"\1"', text)
        n += k
    if "\\" in text:
        text, k = _TEX_WORD.subn(lambda m: m[0], text)
        n += k

        def env(m: re.Match) -> str:
            name = LIST_ENVS.get(m[2].lower(), "blockquote" if m[2].lower() in ("quote", "quotation") else "div")
            return f"{OPEN if m[1] == 'begin' else CLOSE}{name}{END}"

        text = _TEX_ENV.sub(env, text)
        text = _TEX_DROP.sub("", text)
        text = _TEX_REF.sub("[ref]", text)
        text = _TEX_TIE.sub(" ", text)
        text = _TEX_ITEM.sub(lambda m: f"{OPEN}li{END}" + (f"{m[1]} " if m[1] else ""), text)
        text = _TEX_HEADING.sub(lambda m: block(f"h{TEX_LEVEL[m[1]]}", m[2]), text)
        text = _TEX_COLOUR.sub(r"\1", text)
        for _ in range(4):  # wrappers within wrappers
            text, k = _TEX_NOTE.subn(r" (\1)", text)
            text, j = _TEX_WRAP.subn(r"\1", text)
            if not k + j:
                break
        text = _TEX_WORD.sub(lambda m: ESCAPES.get(m[0], ""), text)
    if n:
        kinds.add("latex")
    return text


class Node:
    __slots__ = ("name", "up", "parts", "points", "length", "linked", "at", "size")

    def __init__(self, name: str, up: Node | None):
        self.name, self.up = name, up
        self.parts: list[Node | str] = []
        self.points, self.length, self.linked = 0.0, 0, 0
        self.at, self.size = 0, 1

    def density(self) -> float:
        return self.linked / self.length if self.length else 0.0


# fixed values: an open element of the left kind ends when one of the right kinds begins
ENDED_BY = {"li": {"li"}, "p": _BLOCKS | {"code"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


def build(text: str) -> Node:
    """The tree of blocks of a text whose markup has become marks."""
    root = at = Node("root", None)
    pos = 0
    opened: dict[str, int] = {}  # by name, how many are open
    for m in _MARK.finditer(text):
        if m.start() > pos:
            at.parts.append(text[pos : m.start()])
        pos = m.end()
        name = m[0][1:-1]
        if m[0][0] == OPEN:
            while at.up is not None and name in ENDED_BY.get(at.name, ()) and not (at.name == "p" and name == "math"):
                opened[at.name] -= 1
                at = at.up
            node = Node(name, at)
            at.parts.append(node)
            at = node
            opened[name] = opened.get(name, 0) + 1
        elif opened.get(name):  # an end without a beginning is ignored
            while at.name != name:
                opened[at.name] -= 1
                at = at.up
            opened[name] -= 1
            at = at.up
    if pos < len(text):
        at.parts.append(text[pos:])
    return root


def score(root: Node) -> list[Node]:
    """Points, lengths and link lengths of all nodes; the containers, outermost first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    for i, node in enumerate(order):
        node.at = i
    for node in reversed(order):
        own = "".join(p for p in node.parts if isinstance(p, str))
        if own.strip():
            linked = sum(len(x) for x in re.findall(f"{LINK}([^{UNLINK}]*)", own)) if LINK in own else 0
            size = len(own.strip())
            node.length += size
            node.linked += linked
            if node.name not in ("code", "math") and node.name not in HEADINGS:
                for run in re.split(r"\n\s*\n", own):  # each run of text is a paragraph
                    n = len(run.strip())
                    if n >= 25:
                        points = 1 + run.count(",") + min(n // 100, 3)
                        # the block that holds the text is the paragraph, unless text stands freely in a container
                        up, level = (node if node.name in ("root", "div", "section", "article", "main", "body") else node.up), 0
                        while up is not None and level < ANCESTORS:
                            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                            up, level = up.up, level + 1
        if node.up is not None:
            node.up.length += node.length
            node.up.linked += node.linked
            node.up.size += node.size
    return order


def choose(root: Node) -> set[int]:
    """The nodes (by place in the order) that are kept: the best container, and siblings along its ancestors."""
    order = score(root)
    value = [n.points * (1 - n.density()) if n.name not in BOILERPLATE else 0.0 for n in order]
    best = max(range(len(order)), key=lambda i: (value[i], -i))  # of equals the outermost
    keep = {best}
    node = order[best]
    while node.up is not None:
        near = max(10.0, 0.2 * value[best])
        for p in node.up.parts:
            if not isinstance(p, Node) or p is node or p.name in BOILERPLATE:
                continue
            d = p.density()
            if value[p.at] >= near or p.name in STRUCTURE and d < 0.5 or (p.length > 80 and d < 0.25) or (0 < p.length <= 80 and d == 0):
                keep.add(p.at)
        node = node.up
        keep.add(~node.at)  # its own loose text is kept, its other children are not
    return keep


def render(root: Node, keep: set[int], aside: Aside) -> str:
    out: list[str] = []

    def flush(text: str, prefix: str = "") -> None:
        for run in re.split(r"\n\s*\n", text):
            run = "\n".join(x for x in (_BLANKS.sub(" ", line).strip() for line in run.split("\n")) if x)
            if run:
                out.append(prefix + run)

    def walk(node: Node, inside: bool, depth: int, mark: str, level: int) -> Iterator[Iterator]:
        """Yields the walks of the children where they belong; level: how many blocks with a form of their own are around it."""
        name = node.name
        if name in BOILERPLATE and inside and node.up is not None and node.density() > 0.3:
            return
        if name == "code":
            out.append("```\n" + "".join(p for p in node.parts if isinstance(p, str)).strip("\n") + "\n```")
            return
        number, text, any_text, before = 0, [], False, len(out)
        formed = name in HEADINGS or name in ("li", "blockquote", "ul", "ol", "table", "thead", "tbody")
        for p in node.parts:
            if isinstance(p, str):
                text.append(p)
                any_text |= bool(p.strip())
                continue
            kept = inside or p.at in keep
            if kept or ~p.at in keep:
                if p.name in ("td", "th"):
                    cell = "".join(q for q in p.parts if isinstance(q, str)).strip()
                    text.append((" | " if any_text else "") + cell)
                    any_text |= bool(cell)
                    for q in p.parts:
                        if isinstance(q, Node):
                            yield walk(q, kept, depth, "", level + formed)
                    continue
                flush("".join(text))
                text, any_text = [], False
                number += p.name == "li"
                yield walk(p, kept, depth + (name in ("ul", "ol")), f"{number}. " if name == "ol" else "- ", level + formed)
        flush("".join(text))
        if level >= DEEP:
            return
        if name in HEADINGS:
            joined = " ".join(" ".join(out[before:]).split())
            out[before:] = ["#" * int(name[1]) + " " + joined] if joined else []
        elif name == "li":
            out[before:] = ["  " * max(0, depth - 1) + mark + "\n".join(out[before:])] if len(out) > before else []
        elif name == "blockquote":
            out[before:] = ["> " + "\n> ".join("\n".join(out[before:]).split("\n"))] if len(out) > before else []
        elif formed:
            out[before:] = ["\n".join(out[before:])] if len(out) > before else []

    stack = [walk(root, root.at in keep, 0, "", 0)]
    while stack:  # a deep tree needs no deep stack of calls
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        else:
            stack.append(child)
    text = "\n\n".join(out).replace(LINK, "").replace(UNLINK, "")
    return aside.plain(text)


def _lists(text: str) -> str:
    """Lines that begin like list items become items of a list."""
    out, items, kind = [], [], ""
    for line in text.split("\n") + [None]:
        m = line is not None and _LIST_LINE.match(line)
        if m and OPEN not in line[: m.end()]:
            new = "ol" if m[1][0].isdigit() else "ul"
            if items and new != kind:
                out.append(block(kind, "".join(items)))
                items = []
            kind = new
            items.append(block("li", line[m.end() :]))
            continue
        if items:
            out.append(block(kind, "".join(items)))
            items = []
        if line is not None:
            out.append(line)
    return "\n".join(out)


def clean(text: str) -> tuple[str, list[str], int]:
    """The clean text, the kinds of markup, and the blocks of the tree."""
    text = _PRIVATE.sub("", text)
    kinds: set[str] = set()
    if not _TRIGGER.search(text):
        return "\n".join(_BLANKS.sub(" ", x).strip() for x in text.split("\n")).strip(), [], 1
    text, aside = _set_aside(text, kinds)
    text = _TALL.sub("\n\n\n", _WIDE.sub(" " * 8, text))
    if _TRIGGER.search(text) or OPEN in text:
        text = _html(text, kinds)
        text = _latex(text, kinds)
        text = _wiki(text, kinds)
        text = _markdown(text, kinds)
        text = _lists(text)
    if OPEN not in text and LINK not in text:
        text = "\n".join(_BLANKS.sub(" ", x).strip() for x in text.split("\n"))
        return aside.plain(re.sub(r"\n{3,}", "\n\n", text).strip()), sorted(kinds), 1
    root = build(text)
    keep = choose(root)
    return render(root, keep, aside).strip(), sorted(kinds), root.size


def clean_or_keep(text: str | None) -> tuple[str | None, list[str], int, str | None]:
    """clean(), and why it failed: one text that it cannot read is kept as it is and does not end the job."""
    if text is None:
        return None, [], 0, None
    try:
        return *clean(text), None
    except Exception as e:
        return text, [], 1, f"{type(e).__name__}: {e}"[:200]


SCHEMA = "clean string, kinds array<string>, blocks int, failure string"


def clean_markup(df: DataFrame, key: str = "doc_id", text: str = "statement") -> DataFrame:
    """(key, clean, kinds, blocks, failure) of every row."""
    base = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [clean_or_keep(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.list_(pa.string())), pa.array([x[2] for x in done], pa.int32()), pa.array([x[3] for x in done], pa.string())],
                names=["doc_id", "clean", "kinds", "blocks", "failure"],
            )

    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, {SCHEMA}").withColumnRenamed("doc_id", key)
