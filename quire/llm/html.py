"""A small reader of page HTML: elements, the hashes of their subtrees, and the main text.

Rules (what a page template is made of is decided elsewhere, from counts per host):

* Script, style and other non-text elements, navigation, footers, asides, forms and elements whose
  class, id or role names a menu, header, footer, sidebar, notice, advert, form or reader comment
  are left out. A name counts as a whole: ``sidebar-inner`` names a sidebar, ``has-sidebar`` and
  ``search-algorithms`` don't. A header or a heading group inside an article is part of the article,
  and names there count on containers only (not on headings, paragraphs, cells, list items and
  inline elements), of ids only those of reader comments.
  An element around the first article or main is not judged by its names.
* If any article element is left, the text is that of the articles; else that of main; else that
  of the body. Articles that hold the smaller part of main (of the body, where there is no main) are
  teasers or inserts, and main (the body) is read.
* Line breaks and block elements part words; other elements don't.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Element names of the HTML standard, and usual names of page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FOREIGN = {"svg", "math"}
RAW = set("script style noscript template iframe svg math textarea title select object canvas"
          " audio video noframes noembed xmp".split())
DROPPED = set("head nav footer aside form button dialog menu fieldset label datalist".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt"
             " ruby s samp small span strike strong sub sup time tt u var".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl dd dt fieldset"
             " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p"
             " pre section table ul li".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"},
         "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "option": {"select"}}
FURNITURE = set("nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar rail ad ads adv"
                " advert adverts advertisement advertising sponsor sponsored promo promotion banner"
                " cookie cookies consent gdpr notice notices notification popup modal overlay"
                " newsletter subscribe subscription signup login comment comments disqus respond"
                " reply replies footer share sharing social related recommended recommendations"
                " pagination pager toolbar widget complementary contentinfo skip search alert"
                " masthead topbar colophon copyright".split())
# words that may stand beside one of FURNITURE in a name; and ids of reader comments
FRAME = set("area articles bar block body bottom box buttons col column container content entry fixed"
            " form global group holder inner inline item items label left links list main outer page"
            " panel post posts primary region right row secondary section site slot small stack sticky"
            " stories top unit wide wrap wrapper zone".split())
BODY_FIRST = {"content", "main", "page", "body"}    # content-sidebar is a layout, not a sidebar
COMMENT_IDS = {"comments", "respond", "disqus_thread"}
HEADER = {"header", "head"}
CONTENT = {"article", "main"}
TEXT_KINDS = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody thead figcaption"
                 " html body article main".split())

# attributes: a value may be quoted; a quote anywhere else is a character like any other
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)"
                  r"((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?|[\"'])*+)>"
                  r"|[!?][^>]*(?:>|\Z)|/?[a-zA-Z][^>]*(>|\Z))", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?",
                   re.I)
_NAMED = re.compile(r"(?:^| )(class|id|role)=(.*?)(?= (?:class|id|role|hidden|aria-hidden)=|\Z)", re.S)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    names: str = ""
    children: list = field(default_factory=list)
    hash: int = 0
    holds: bool = False     # the first article or main of the page is in it


def parse(page: str) -> Node:
    """The element tree; text is kept as decoded strings. Any input gives a tree: an unclosed
    element ends with its parent, a tag cut off by the end of the page is left out."""
    root = Node("#root")
    stack = [root]
    open_tags: Counter[str] = Counter()

    def cut(depth: int) -> None:
        open_tags.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    at, size, seen = 0, len(page), False
    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            stack[-1].children.append(html.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("p", "br"):
                if tag == "br":
                    stack[-1].children.append(Node("br"))
                elif open_tags["p"] > 0:
                    cut(_open_p(stack))
            elif open_tags[tag] > 0:
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in ENDS_P and open_tags["p"] > 0:
            cut(_open_p(stack))
        if tag in CLOSES and any(open_tags[t] > 0 for t in CLOSES[tag]):
            cut(_ended(stack, CLOSES[tag], STOPS[tag]))
        node = Node(tag, _names(m[3]))
        stack[-1].children.append(node)
        if tag in CONTENT and not seen and not any(n.tag in DROPPED for n in stack):
            seen = True
            for n in stack:
                n.holds = True
        if tag in FOREIGN and m[3].endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
        elif tag not in VOID:       # in HTML only these close themselves, whatever a slash says
            stack.append(node)
            open_tags[tag] += 1
    return root


def _open_p(stack: list[Node]) -> int:
    """Where the stack is to be cut so that an open paragraph ends."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == "p":
            return i
        if stack[i].tag not in INLINE:
            break
    return len(stack)


def _ended(stack: list[Node], tags: set[str], stops: set[str]) -> int:
    """Where the stack is to be cut so that the innermost of ``tags`` ends, if no stop is nearer."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in stops:
            break
        if stack[i].tag in tags:
            return i
    return len(stack)


def _names(attributes: str) -> str:
    if not attributes or attributes.isspace():
        return ""
    return " ".join(sorted(f"{k.lower()}={v.strip(chr(34) + chr(39))}"
                           for k, v in _ATTR.findall(attributes)))


def _furniture(node: Node, inside: bool) -> bool:
    if node.tag in DROPPED or node.tag in RAW:
        return True
    if node.tag == "header" and not inside:
        return True
    if not node.names or node.holds or node.tag in ("html", "body"):
        return False
    if re.search(r"(^| )(aria-hidden=true|hidden=)", node.names):
        return True
    if inside and (node.tag in INLINE or (node.tag in TEXT_KINDS and node.tag != "article")):
        return False
    return any(token.lower() in COMMENT_IDS if inside and key == "id" else _names_furniture(
        token, FURNITURE if inside else FURNITURE | HEADER)
               for key, value in _NAMED.findall(node.names) for token in value.split())


def _names_furniture(token: str, furniture: set[str]) -> bool:
    words = [w.lower() for w in _PARTS.findall(token) if len(w) > 1]
    return (bool(furniture.intersection(words)) and words[0] not in BODY_FIRST
            and all(w in furniture or w in FRAME for w in words))


def _hash(root: Node) -> None:
    """Sets the hash of every subtree: tag, names, text and children."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):       # children before their parents
        h = hashlib.blake2b(f"{n.tag}|{n.names}".encode(), digest_size=8)
        for c in n.children:
            if isinstance(c, Node):
                h.update(b"e" + c.hash.to_bytes(8, "little", signed=True))
            elif not c.isspace():
                h.update(b"t" + " ".join(c.split()).encode("utf-8", "surrogatepass"))
        n.hash = int.from_bytes(h.digest(), "little", signed=True)


def _has_text(node: Node) -> bool:
    todo = [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node):
                todo.append(c)
            elif not c.isspace():
                return True
    return False


def _outermost(root: Node, kind: str) -> list[Node]:
    found: list[Node] = []
    todo = [root]
    while todo:
        n = todo.pop()
        if n is not root and (n.tag == kind or (kind == "main" and "role=main" in n.names)):
            if not _furniture(n, True) and _has_text(n):
                found.append(n)
                continue
        if n is root or not _furniture(n, False):
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return found


def _roots(root: Node) -> tuple[list[Node], bool]:
    """The elements whose text counts, and whether they are articles or main."""
    articles, mains = _outermost(root, "article"), _outermost(root, "main")
    if not articles:
        return (mains, True) if mains else ([root], False)
    size = len(_text(articles, True, set()))
    if mains:
        inner = [a for m in mains for a in _outermost(m, "article")]
        if inner and 2 * len(_text(inner, True, set())) < len(_text(mains, True, set())):
            return mains, True
    elif 2 * size < len(_text([root], False, set())):
        return [root], False
    return articles, True


def candidates(page: str) -> tuple[set[int], int]:
    """Hashes of the subtrees that may turn out to be template: what the rules leave, but for the
    articles and main themselves, the elements around them, and in them running text. And the hash
    of the page's text before templates go."""
    root = parse(page)
    _hash(root)
    roots, inside = _roots(root)
    out: set[int] = set()
    todo = list(roots)
    while todo:
        n = todo.pop()
        for c in n.children:
            if isinstance(c, Node) and not _furniture(c, inside):
                if c.tag not in INLINE and c.tag not in VOID and _template_kind(c, inside):
                    out.add(c.hash)
                todo.append(c)
    text = _text(roots, inside, set()).encode("utf-8", "surrogatepass")
    return out, int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _template_kind(node: Node, inside: bool) -> bool:
    if inside:
        return node.tag not in TEXT_KINDS
    return node.tag not in ("html", "body", "article", "main")


def main_text(page: str, template: set[int]) -> str:
    """The text of the page without furniture and without the subtrees in ``template``."""
    root = parse(page)
    if template:
        _hash(root)
    return _text(*_roots(root), template)


def _text(roots: list[Node], inside: bool, template: set[int]) -> str:
    out: list[str] = []
    todo: list[Node | str] = []
    for n in reversed(roots):
        todo += [" ", *reversed(n.children)]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag in VOID:
            if c.tag in ("br", "hr"):
                out.append(" ")
        elif not _furniture(c, inside) and not (
                c.hash in template and c.tag not in INLINE and _template_kind(c, inside)):
            if c.tag in INLINE:
                todo += reversed(c.children)
            else:
                out.append(" ")
                todo += [" ", *reversed(c.children)]
    return " ".join("".join(out).split())
