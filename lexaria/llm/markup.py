"""Clean text and structure from HTML, Markdown, wiki and LaTeX, and removal of what a site repeats."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexaria.session import stored

_SPACE = re.compile(r"\s+")
#: Tags of HTML (fixed values); of these, the ones of wiki text don't tell HTML.
HTML_TAGS = """a abbr address article aside b blockquote body br button caption center cite code dd del div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html
i iframe img input label li link main meta nav ol option p pre q s script section select small span strike strong style sub sup table tbody td tfoot th thead title tr tt u ul var video""".split()
WIKI_TAGS = ("ref", "references", "math", "nowiki", "pre", "syntaxhighlight", "source", "gallery")
_TAG = re.compile(r"<(/?)(" + "|".join(sorted(HTML_TAGS, key=len, reverse=True)) + r")\b((?:\s[^<>]*)?/?)>", re.I)
_ANY_TAG = re.compile(r"</?[a-zA-Z][\w:-]*(?:\s[^<>]*)?/?>", re.S)
#: Elements that make a text an HTML one; others, and divisions, also stand in Markdown and wiki text.
_HTML_BLOCK = re.compile(r"<(?:p|h[1-6]|li|ul|ol|html|body|section|article)\b[^<>]*>", re.I)
_REFERENCE = re.compile(r"&(?:#\d+|#x[0-9a-f]+|[a-z]+\d*);", re.I)
_TEX = re.compile(
    r"\\(?:(?:sub)*section|paragraph|chapter|text(?:bf|it|tt|sc|rm)|emph|underline|cite\w*|footnote|begin|end|item|label|ref|documentclass|usepackage|maketitle|title|author|includegraphics|href|url)\b|\{\\(?:it|bf|em|tt|sc|sl|rm)\b|``[^`'\n]+''"
)
_WIKI = re.compile(r"\[\[[^\[\]\n]+\]\]|\[https?://[^\s\[\]]+ [^\[\]\n]+\]|'''?[^'\n]+'''?|^={2,6}[^=\n].*?={2,6}\s*$|\{\{[^{}]+\}\}|^\{\||<(?:ref|math|nowiki|syntaxhighlight|references)\b", re.M)
_MD = re.compile(
    r"!?\[[^\[\]\n]*\](?:\([^()\n]*\)|\[[^\[\]\n]*\])|\*\*[^*\n]+\*\*|__[^_\n]+__|(?<![*\w])\*[^*\s][^*\n]*\*(?![*\w])|(?<![_\w])_[^_\s][^_\n]*_(?![_\w])|~~[^~\n]+~~|`[^`\n]+`|^#{1,6} .|^(?:```|~~~)|^(?:[-*+]|\d+[.)]) \S|^.+\n(?:={3,}|-{3,})\s*$|^> ",
    re.M,
)
_SPECIAL = re.compile(r"[<\\`\[{*_#=~$&'>]|^\d+[.)] |^[-+] |^    \S|^-{3,}\s*$", re.M)
_HOLD = re.compile("\x00(\\d+)\x01")


def squeeze(s: str) -> str:
    return _SPACE.sub(" ", s).strip()


@dataclass(eq=False, slots=True)
class Element:
    """A node of a text's element tree. ``text`` is its own clean content; blocks hold elements, lists hold items. ``mark`` is the hash of the subtree."""

    kind: str
    text: str = ""
    children: list["Element"] = field(default_factory=list)
    raw: list[str] = field(default_factory=list)
    mark: int = 0


@dataclass
class Parsed:
    syntaxes: list[str]
    root: Element


class _Holder:
    """Keeps code and formulas out of the way of the rules for running text."""

    def __init__(self):
        self.kept: list[Element] = []

    def put(self, kind: str, content: str) -> str:
        self.kept.append(Element(kind, squeeze(content)))
        return f"\x00{len(self.kept) - 1}\x01"

    def fill(self, s: str) -> str:
        return _HOLD.sub(lambda m: self.kept[int(m[1])].text, s)

    def inside(self, s: str) -> list[Element]:
        return [self.kept[int(m)] for m in _HOLD.findall(s)]


@lru_cache(maxsize=256)
def _closer(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.I | re.M)


def _pairs(text: str, opener: re.Pattern, closer_of, make, least: int = 0) -> str:
    """``text`` with each opener up to its nearest closer (at least ``least`` characters later) replaced by ``make(opener, inside)``.

    One pass: a closer that isn't found behind one opener isn't looked for behind later ones.
    """
    out: list[str] = []
    at, missing = 0, set()
    m = opener.search(text)
    while m:
        pattern = closer_of(m)
        end = None
        if pattern not in missing:
            end = _closer(pattern).search(text, m.end() + least)
            if end is None:
                missing.add(pattern)
        if end is None:
            m = opener.search(text, m.start() + 1)
            continue
        out += (text[at : m.start()], make(m, text[m.end() : end.start()]))
        at = end.end()
        m = opener.search(text, at)
    out.append(text[at:])
    return "".join(out)


#: Openers of formulas with their closers.
_FORMULAS = (
    (re.compile(r"\\begin\{(equation|align|displaymath|gather|eqnarray|multline)(\*?)\}"), lambda m: rf"\\end\{{{m[1]}{re.escape(m[2])}\}}", 0),
    (re.compile(r"<math\b[^<>]*>", re.I), lambda m: r"</math\s*>", 0),
    (re.compile(r"\$\$"), lambda m: r"\$\$", 1),
    (re.compile(r"\\\["), lambda m: r"\\\]", 1),
    (re.compile(r"\\\("), lambda m: r"\\\)", 1),
)
_INLINE = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\w$])")


def _formulas(text: str, hold: _Holder, entities: bool) -> str:
    def keep(inside: str) -> str:
        return hold.put("formula", re.sub(r"\\label\{[^{}]*\}", "", html.unescape(inside) if entities else inside))

    for opener, closer_of, least in _FORMULAS:
        text = _pairs(text, opener, closer_of, lambda m, inside: keep(inside), least)
    return _INLINE.sub(lambda m: keep(m[1]), text)


_WIKI_CODE = re.compile(r"<(pre|syntaxhighlight|source)\b[^<>]*>", re.I)
_TEX_CODE = re.compile(r"\\begin\{(verbatim|lstlisting|Verbatim|minted)\}(?:\[[^\[\]]*\])?(?:\{[^{}]*\})?[ \t]*\n?")
_FENCE = re.compile(r"^(`{3,}+|~{3,}+)[^\n]*\n", re.M)
_INDENTED = re.compile(r"(?:\A|(?<=\n\n))((?:(?: {4}|\t)[^\n]*(?:\n(?:[ \t]*\n)*(?=(?: {4}|\t))|\n|\Z))+)")
_SCRIPT = re.compile(r"<(script|style|title)\b[^<>]*>|<!--|<!doctype[^<>]*>", re.I)
_COMMENT = re.compile("<!--")


def _wiki_code(text: str, make) -> str:
    return _pairs(text, _WIKI_CODE, lambda m: rf"</{m[1].lower()}\s*>", make)


def _tex_code(text: str, make) -> str:
    return _pairs(text, _TEX_CODE, lambda m: rf"\\end\{{{m[1]}\}}", make)


def _fences(text: str, make) -> str:
    return _pairs(text, _FENCE, lambda m: rf"^{m[1]}[`~]*[ \t]*$", make)


def _without_scripts(text: str) -> str:
    return _pairs(text, _SCRIPT, lambda m: rf"</{m[1].lower()}\s*>" if m[1] else "-->" if m[0] == "<!--" else "", lambda m, inside: " ")


def _without_comments(text: str, by: str = "") -> str:
    return _pairs(text, _COMMENT, lambda m: "-->", lambda m, inside: by) if "<!--" in text else text


def _without_tags(text: str) -> str:
    return _ANY_TAG.sub(" ", _without_comments(text, " ")) if "<" in text else text


def _unmarked(s: str, mark: str, apart: bool) -> str:
    """``s`` without pairs of ``mark`` around a part of a line that neither begins nor ends with white space; ``apart``: not within words. One pass for each line."""
    if mark not in s:
        return s
    k = len(mark)
    lines = s.split("\n")
    for j, line in enumerate(lines):
        out, at, o = [], 0, line.find(mark)
        while o >= 0:
            inner = o + k
            if inner >= len(line) or line[inner].isspace() or apart and o and (line[o - 1].isalnum() or line[o - 1] == "_"):
                o = line.find(mark, o + 1)
                continue
            c = line.find(mark, inner + 1)
            while c >= 0 and (line[c - 1].isspace() or apart and c + k < len(line) and (line[c + k].isalnum() or line[c + k] == "_")):
                c = line.find(mark, c + 1)
            if c < 0:
                break
            out += (line[at:o], line[inner:c])
            at = c + k
            o = line.find(mark, at)
        if out:
            lines[j] = "".join((*out, line[at:]))
    return "\n".join(lines)


_TARGET = r"(?:\((?:[^()\n]|\([^()\n]*\))*\)|\[[^\[\]\n]*\])"


def clean_markdown(s: str) -> str:
    s = re.sub(r"!\[[^\[\]\n]*\]" + _TARGET, "", s)
    s = re.sub(r"\[([^\[\]\n]*)\]" + _TARGET, r"\1", s)
    s = re.sub(r"\[\^\w+\]", "", s)
    s = re.sub(r"(?<!`)`+([^`\n]+)`+", r"\1", s)
    for mark, apart in (("**", False), ("__", True), ("~~", False)):
        s = _unmarked(s, mark, apart)
    for p in (r"\*(\S(?:[^*\n]*?\S)?)\*", r"(?<!\w)_(\S(?:[^_\n]*?\S)?)_(?!\w)"):
        s = re.sub(p, r"\1", s)
    return html.unescape(_without_tags(s))


def _without_templates(s: str) -> str:
    """``s`` without what stands in double braces, nested ones included; unpaired braces stay."""
    if "{{" not in s:
        return s
    open_at: list[int] = []
    cut: list[tuple[int, int]] = []
    for m in re.finditer(r"\{\{|\}\}", s):
        if m[0] == "{{":
            open_at.append(m.start())
        elif open_at:
            begin = open_at.pop()
            while cut and cut[-1][0] >= begin:
                cut.pop()
            cut.append((begin, m.end()))
    out, at = [], 0
    for begin, end in cut:
        out.append(s[at:begin])
        at = end
    return "".join((*out, s[at:]))


def clean_wiki(s: str) -> str:
    if "<" in s:
        s = _pairs(re.sub(r"<ref\b[^<>]*/>", "", s, flags=re.I), re.compile(r"<ref\b[^<>]*>", re.I), lambda m: r"</ref\s*>", lambda m, inside: "")
        s = _without_comments(s)
    s = _without_templates(s)
    s = re.sub(r"\[\[(?:file|image|archivo|imagen|fichier|datei|immagine|ficheiro|imagem|category|categoría|categoria):[^\[\]]*\]\]", "", s, flags=re.I)
    s = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", s)
    s = re.sub(r"\[(?:https?:)?//[^\s\[\]]+\s+([^\[\]\n]*)\]", r"\1", s)
    s = re.sub(r"\[(?:https?:)?//[^\s\[\]]+\]", "", s)
    s = re.sub(r"'{2,5}", "", s)
    return html.unescape(_without_tags(s))


#: Commands whose argument is no text, and those that only switch the type (fixed values).
_TEX_DROPPED = frozenset("footnote label ref eqref pageref index includegraphics begin end".split())
_TEX_SWITCHES = frozenset("it bf em tt rm sc sl itshape bfseries".split())
_TEX_TOKEN = re.compile(r"\\([%&_#${}])|(~?)\\([a-zA-Z]+)\*?((?:\[[^\[\]\n]*\])*)(\{)?|(\{)|(\})|(\\\\|~)|(``|'')|[^\\{}~`']+|.", re.S)


def clean_tex(s: str) -> str:
    """One pass over commands and braces; a stack holds what each open brace belongs to."""
    s = re.sub(r"(?<!\\)%[^\n]*", "", s)
    out: list[str] = []
    stack: list[tuple[bool, int]] = []  # whether what is inside is dropped, and where it begins
    quote = -1
    switched = False
    for m in _TEX_TOKEN.finditer(s):
        kind = m.lastindex
        escaped, before, name, options, group, brace, end, blank, mark = m.groups()
        if switched:
            switched = False
            if kind is None:
                out.append(m[0].lstrip())
                continue
        if escaped:
            out.append("" if escaped in "{}" else escaped)
        elif name:
            dropped = name in _TEX_DROPPED or name.startswith("cite")
            if group:
                out.append(" " if before and not dropped else "")
                stack.append((dropped or name == "href", len(out)))
            elif name in _TEX_SWITCHES:
                switched = True
            else:
                out.append((" " if before else "") + " " + (options or ""))
        elif brace:
            stack.append((False, len(out)))
        elif end:
            if stack:
                dropped, at = stack.pop()
                if dropped:
                    del out[at:]
                    quote = -1 if quote >= at else quote
        elif blank:
            out.append(" ")
        elif mark == "``":
            quote = len(out)
            out.append(mark)
        elif mark and quote >= 0:
            out[quote], quote = "", -1
        else:
            out.append(m[0])
    return _without_tags("".join(out))


def clean_html(s: str) -> str:
    return html.unescape(re.sub(r"<[^<>]*>", lambda m: " " if re.match(r"</?(?:br|p|div|li|td|th|tr|h\d)\b", m[0], re.I) else "", s))


CLEANERS = {"markdown": clean_markdown, "wiki": clean_wiki, "latex": clean_tex, "html": clean_html, "": lambda s: s}

_HTML_PART = re.compile(r"<(/?)(h[1-6]|li|p|div|ul|ol|dl|table|tr|td|th|blockquote|body|html|section|article|hr)\b[^<>]*>", re.I)


_OWNERS = ("heading", "item", "paragraph")


def _html_tree(text: str, hold: _Holder) -> Element:
    """Element tree of HTML whose end tags may be missing: a block's start ends an open paragraph or heading, an item's start the item before it."""
    root = Element("page")
    # name, element, and the nearest element that takes text
    stack: list[tuple[str, Element, Element | None]] = [("", root, None)]
    opened: dict[str, int] = {}
    at = 0

    def say(upto: int) -> None:
        raw = text[at:upto]
        if not raw or raw.isspace():
            return
        own = stack[-1][2]
        if own is None:
            own = Element("paragraph")
            stack[-1][1].children.append(own)
            # text that goes on after a closed element begins a paragraph anew only if its block has none open
            stack[-1] = (stack[-1][0], stack[-1][1], own if stack[-1][1].kind in _OWNERS else None)
        own.raw.append(raw)

    def close(name: str, stop: tuple[str, ...] = ()) -> None:
        if not opened.get(name):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                for x in stack[k:]:
                    opened[x[0]] -= 1
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    for m in _HTML_PART.finditer(text):
        say(m.start())
        at = m.end()
        name = m[2].lower()
        if m[1]:
            close(name)
            continue
        for open_name in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            close(open_name, ("li", "div", "td", "th", "blockquote", "ul", "ol"))
        if name == "li":
            close("li", ("ul", "ol"))
        kind = "heading" if name[0] == "h" and name[1:].isdigit() else "item" if name == "li" else "paragraph" if name == "p" else "hr" if name == "hr" else "block"
        if kind == "hr":
            continue
        node = Element(kind)
        stack[-1][1].children.append(node)
        stack.append((name, node, node if kind in _OWNERS else stack[-1][2]))
        opened[name] = opened.get(name, 0) + 1
    say(len(text))
    return root


def _nodes(root: Element) -> Iterator[tuple[Element, int]]:
    """All elements below ``root`` with their depth, each before its children."""
    stack = [(c, 1) for c in reversed(root.children)]
    while stack:
        e, depth = stack.pop()
        yield e, depth
        stack += [(c, depth + 1) for c in reversed(e.children)]


def _finish(root: Element, clean, hold: _Holder) -> None:
    """Cleans every element's text, hangs what was held below it, and marks each subtree with the hash of its kind, content and children's marks."""
    order = [root, *(e for e, _ in _nodes(root))]
    for e in order:
        if e.raw or e.text:
            text = "".join(e.raw) or e.text
            held = hold.inside(text)
            e.raw, e.text = [], squeeze(hold.fill(clean(text)))
            e.children = held + e.children
    for e in reversed([root, *(e for e, _ in _nodes(root))]):
        h = xxhash.xxh64(e.kind)
        h.update(b"\0" + e.text.encode("utf-8", "surrogatepass"))
        for c in e.children:
            h.update(c.mark.to_bytes(8, "little"))
        e.mark = h.intdigest()


_TEX_PART = re.compile(r"\\((?:sub)*section|chapter|paragraph)\*?(?:\[[^\]\n]*\])?\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}|\\(item)\b(?:\[[^\[\]\n]*\])?|\\(begin|end)\{(?:itemize|enumerate|description)\}")


def _tex_tree(text: str) -> Element:
    root = Element("page")
    m = re.search(r"\\begin\{document\}", text)
    if m:
        text = text[m.end() :]
    elif re.search(r"\\documentclass", text):
        text = re.sub(r"\\(?:documentclass|usepackage|title|author|date)(?:\[[^\]\n]*\])?\{[^{}]*\}", "", text)
    text = re.sub(r"\\end\{document\}.*", "", text, flags=re.S)
    text = re.sub(r"(?<!\\)%[^\n]*", "", text)
    item: Element | None = None
    at = 0

    def say(raw: str) -> None:
        nonlocal item
        if item is not None:
            # an item ends at a blank line only if its list has ended
            item.raw.append(raw)
        else:
            root.children.extend(Element("paragraph", p) for p in re.split(r"\n\s*\n", raw) if p.strip())

    for m in _TEX_PART.finditer(text):
        say(text[at : m.start()])
        at = m.end()
        if m[1]:
            item = None
            root.children.append(Element("heading", m[2]))
        elif m[3]:
            item = Element("item")
            root.children.append(item)
        else:
            item = None
    say(text[at:])
    return root


_SETEXT = re.compile(r"^(?:={3,}|-{3,})\s*$")


_TABLE, _TABLE_END = re.compile(r"[\s:]*\{\|"), re.compile(r"\s*\|\}(?!\})")
_CELL_MARK = re.compile(r"\[\[[^\[\]]*\]\]|\{\{[^{}]*\}\}|(\|\|)|(!!)")
_CELL_ATTRIBUTES = re.compile(r"^\s*[\w-]+\s*=[^|\[\]{}]*\|")


def _wiki_tables(rows: list[str]) -> tuple[set[int], set[int]]:
    """Lines that begin and that end a table of wiki text; a beginning without an end is none, and neither is an end without a beginning."""
    begins, ends, unclosed = set(), set(), []
    for k, line in enumerate(rows):
        if _TABLE.match(line):
            unclosed.append(k)
        elif unclosed and _TABLE_END.match(line):
            begins.add(unclosed.pop())
            ends.add(k)
    return begins, ends


def _wiki_cells(s: str, head: bool) -> list[str]:
    """The cells of a line without its first mark, without their attributes."""
    cells, at = [], 0
    for m in _CELL_MARK.finditer(s):
        if m[1] or m[2] and head:
            cells.append(s[at : m.start()])
            at = m.end()
    return [_CELL_ATTRIBUTES.sub("", c) for c in (*cells, s[at:])]


def _line_tree(text: str, syntax: str) -> Element:
    """Blocks of Markdown, wiki or plain text: headings, items, and paragraphs of the lines between; each row of a wiki table is a paragraph."""
    root = Element("page")
    rows = text.split("\n")
    run: list[str] = []
    begins, ends = _wiki_tables(rows) if syntax == "wiki" and "{|" in text else (set(), set())
    depth, caption = 0, False

    def flush() -> None:
        if run:
            root.children.append(Element("paragraph", "\n".join(run)))
            run.clear()

    for k, line in enumerate(rows):
        if not line.strip():
            flush()
            continue
        heading = item = None
        if syntax == "wiki":
            if k in begins:
                depth += 1
                caption = False
                flush()
                continue
            if k in ends:
                depth -= 1
                flush()
                line = _TABLE_END.sub("", line, count=1)
                if not line.strip():
                    continue
            elif depth and line.lstrip()[0] in "|!":
                line = line.lstrip()
                if caption or line.startswith(("|-", "|+")):
                    flush()
                caption = line.startswith("|+")
                if not line.startswith("|-"):
                    run.extend(c for c in _wiki_cells(line[1 + caption :], line[0] == "!") if c.strip())
                continue
            if m := re.match(r"^(={1,6})(.+?)\1\s*$", line):
                heading = m[2]
            elif m := re.match(r"^[*#]+\s*(.*)$", line):
                item = m[1]
            else:
                line = line.lstrip(":;")
        elif syntax == "markdown":
            if m := re.match(r"^ {0,3}#{1,6}(?=[ \t])", line):
                heading = line[m.end() :].rstrip(" \t")
                bare = heading.rstrip("#")
                heading = bare if bare != heading and bare[-1:] in (" ", "\t") else heading
            elif _SETEXT.match(line) and len(run) == 1 and not run[0].startswith(">"):
                heading = run.pop()
            elif _SETEXT.match(line):
                flush()
                continue
            elif m := re.match(r"^\s*(?:[-*+]|\d{1,9}[.)])[ \t]+(.*)$", line):
                item = m[1]
            elif re.match(r"^\s*\[[^\]\n]+\]:\s*\S+", line):
                continue
            else:
                line = re.sub(r"^\s*>\s?", "", line)
        if heading is not None:
            flush()
            root.children.append(Element("heading", heading))
        elif item is not None:
            flush()
            root.children.append(Element("item", item))
        else:
            run.append(line)
    flush()
    return root


def _blank(m: re.Match, inside: str) -> str:
    return " "


def _html_trace(text: str) -> bool:
    return _REFERENCE.search(text) is not None or _without_comments(text) != text


def parse(text: str) -> Parsed:
    """Syntaxes and element tree of a text; plain text gives paragraphs only."""
    if not _SPECIAL.search(text):
        return Parsed([], _line_tree(text, ""))
    text = text.replace("\x00", "").replace("\x01", "").replace("\r\n", "\n")
    hold = _Holder()
    has_wiki_code = bool(re.search(r"<syntaxhighlight\b", text, re.I))
    # code first, in the syntax that writes it so: nothing in it is markup
    work = _tex_code(text, lambda m, inside: hold.put("code", inside))
    work = _wiki_code(work, lambda m, inside: hold.put("code", html.unescape(re.sub(r"</?code\b[^<>]*>", "", inside)) if m[1].lower() == "pre" else inside))
    work = _fences(work, lambda m, inside: hold.put("code", inside))
    is_html = bool(_HTML_BLOCK.search(work))
    work = _without_scripts(work) if "<" in work else work
    bare = _without_scripts(text) if "<" in text else text
    work = _formulas(work, hold, is_html)
    found = []
    if re.search(r"<\w", bare):
        outside = _wiki_code(bare, _blank) if not is_html else bare
        outside = _fences(_tex_code(outside, _blank), _blank)
        if any(m[2].lower() not in WIKI_TAGS for m in _TAG.finditer(outside)):
            found.append("html")
    tex = bool(_TEX.search(work)) or _tex_code(text, _blank) != text
    if is_html:
        main = "html"
    elif tex:
        main = "latex"
    elif _WIKI.search(work) or has_wiki_code or re.search(r"<(?:math|nowiki|ref)\b", text, re.I):
        main = "wiki"
    else:
        indented = _INDENTED.sub(lambda m: hold.put("code", m[1]) + "\n", work) if re.search(r"^(?: {4}|\t)\S", work, re.M) else work
        main = "markdown" if _MD.search(work) or _fences(text, _blank) != text or indented != work else "html" if found else ""
        work = indented if main == "markdown" else work
    if main in ("latex", "wiki", "markdown"):
        found.append(main)
    elif not found and _html_trace(_fences(text, _blank)):
        # character references or comments alone
        found.append("html")
        main = "html"
    if main == "html":
        root = _html_tree(work, hold)
    elif main == "latex":
        root = _tex_tree(work)
    else:
        root = _line_tree(work, main)
    _finish(root, CLEANERS[main], hold)
    return Parsed(found, root)


def elements(root: Element) -> Iterator[Element]:
    return (e for e, _ in _nodes(root))


#: Elements that pages also repeat in their own text when they stand alone, such as a usual heading.
ALONE = frozenset(("heading", "item", "code", "formula"))


def prune(root: Element, repeated: set[int]) -> None:
    """Deletes the topmost subtrees whose mark is in ``repeated``; a heading, item, code block or formula of which no neighbour is repeated stays, as text of one's own may have it, too."""
    stack = [root]
    while stack:
        node = stack.pop()
        again = [c.mark in repeated for c in node.children]
        if any(again):
            last = len(again) - 1
            node.children = [c for i, c in enumerate(node.children) if not again[i] or c.kind in ALONE and not (i and again[i - 1]) and not (i < last and again[i + 1])]
        stack += node.children


def render(root: Element) -> str:
    """Clean text that keeps headings (#), items (-), code (fenced) and block formulas ($$) apart."""
    out: list[str] = []
    stack = list(reversed(root.children))
    while stack:
        c = stack.pop()
        same = any(c.text == k.text for k in c.children)
        if c.kind == "heading":
            out.append("# " + c.text)
        elif c.kind == "item":
            out.append("- " + c.text)
        elif c.kind == "code":
            out.append("```\n" + c.text + "\n```")
        elif c.kind == "formula":
            out.append("$$" + c.text + "$$")
        elif c.text and not same:
            out.append(c.text)
        if c.kind != "paragraph" or same:
            stack += reversed(c.children)
    return "\n\n".join(out)


KINDS = ("page", "block", "heading", "item", "paragraph", "code", "formula")
_CODE = {k: i for i, k in enumerate(KINDS)}
_SIGNED = 1 << 63


def _trees(with_text: bool):
    """A row's tree as lists over its elements, each before its children; without the text of paragraphs unless ``with_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in b.column(2).to_pylist():
                p = parse(text)
                rows = list(_nodes(p.root))
                texts = [e.text if with_text or e.kind in ALONE else "" for e, _ in rows]
                marks = [e.mark - 2 * _SIGNED if e.mark >= _SIGNED else e.mark for e, _ in rows]
                for x, v in zip(out, (p.syntaxes, [_CODE[e.kind] for e, _ in rows], texts, [d for _, d in rows], marks)):
                    x.append(v)
            kinds = (pa.string(), pa.int8(), pa.string(), pa.int32(), pa.int64())
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(x, pa.list_(k)) for x, k in zip(out, kinds))], names=["id", "host", "syntaxes", "kinds", "texts", "depths", "marks"])

    return run


def _rebuilt(kinds: list[int], texts: list[str], depths: list[int], marks: list[int]) -> Element:
    root = Element("page")
    path = [root]
    for kind, text, depth, mark in zip(kinds, texts, depths, marks):
        e = Element(KINDS[kind], text, mark=mark)
        del path[depth:]
        path[-1].children.append(e)
        path.append(e)
    return root


def _result(rows: Iterator[tuple], with_text: bool) -> pa.RecordBatch:
    """(id, syntaxes, root) as a batch of results."""
    out: list[list] = [[] for _ in range(5)]
    for doc, syntaxes, root in rows:
        own = [e for e in elements(root) if e.kind in ALONE and e.text]
        for x, v in zip(out, (doc, syntaxes, [e.kind for e in own], [e.text for e in own], render(root) if with_text else None)):
            x.append(v)
    strings = pa.list_(pa.string())
    return pa.record_batch([pa.array(out[0], pa.int64()), *(pa.array(x, strings) for x in out[1:4]), pa.array(out[4], pa.string())], names=["id", "syntaxes", "kinds", "contents", "clean_text"])


def _pruned(with_text: bool):
    def one(doc, syntaxes, kinds, texts, depths, marks, repeated):
        root = _rebuilt(kinds, texts, depths, marks)
        if repeated:
            prune(root, set(repeated))
        return doc, syntaxes, root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _result((one(*r) for r in zip(*(c.to_pylist() for c in b.columns))), with_text)

    return run


def _parsed(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = ((doc, parse(text)) for doc, text in zip(*(c.to_pylist() for c in b.columns)))
            yield _result(((doc, p.syntaxes, p.root) for doc, p in parsed), with_text)

    return run


def clean_markup(docs: DataFrame, *, min_pages: int = 10, min_share: float = 0.3, with_text: bool = True) -> DataFrame:
    """(id, syntaxes, kinds, contents, clean_text) for each row of ``docs`` (id BIGINT, host STRING, text STRING).

    ``syntaxes`` names the markups present (html, markdown, wiki, latex); ``kinds`` and ``contents`` are the headings, items, code blocks and
    formulas in order, clean; ``clean_text`` is the text without markup in which they are still told apart (NULL without ``with_text``).

    Site template removal: every element subtree of a text with a host is hashed, the hashes are counted per host over all pages, and subtrees on at
    least ``min_pages`` pages and ``min_share`` of the host's pages are deleted; a single heading, item, code block or formula between others that aren't repeated stays. A text is parsed once: its tree
    with the hashes is kept in ``spark.checkpoint.dir``. Counts are combined in the map tasks; a page gets back only its
    own repeated hashes. Texts without a host pass straight through and aren't shuffled. Time grows in proportion to a text, however its marks are nested or left open.

    NULL ids or texts give no rows, empty texts an empty result row, repeated rows repeated results.
    """
    docs = docs.select(F.col("id").cast("long").alias("id"), F.col("host").cast("string").alias("host"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    on_host = docs.where("host IS NOT NULL")
    tree = stored(on_host.mapInArrow(_trees(with_text), "id long, host string, syntaxes array<string>, kinds array<tinyint>, texts array<string>, depths array<int>, marks array<long>"))
    marks = tree.select(F.xxhash64("host").alias("host"), "id", F.explode(F.array_distinct("marks")).alias("h")).distinct()
    counts = marks.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    sizes = tree.select(F.xxhash64("host").alias("host"), "id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    repeated = counts.join(sizes, "host").where(F.col("n") >= F.col("pages") * min_share).select("host", "h")
    own = marks.join(repeated, ["host", "h"]).groupBy("id").agg(F.collect_set("h").alias("repeated"))
    schema = "id long, syntaxes array<string>, kinds array<string>, contents array<string>, clean_text string"
    with_host = tree.join(own, "id", "left").select("id", "syntaxes", "kinds", "texts", "depths", "marks", "repeated").mapInArrow(_pruned(with_text), schema)
    without = docs.where("host IS NULL").select("id", "text").mapInArrow(_parsed(with_text), schema)
    return with_host.unionAll(without)
