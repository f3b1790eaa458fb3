"""A syntax tree of Java, C# and TypeScript sources, and the declarations in it.

``tokens`` reads words, literals and marks; strings, template literals with their
expressions, regular expressions and comments are told from code. ``tree`` nests
what stands in brackets. ``Declarations`` is a recursive descent over that tree:

    scope   = { annotation | modifier | class | namespace | member }
    class   = annotation* modifier* "class" name generics? heritage "{" scope "}"
    member  = annotation* modifier* type? name generics? "(" ... ")" rest body
            | annotation* modifier* type? name ( "=" expression )? end
    body    = "{" ... "}" | "=>" expression end | end

A source with faults gives what can be read of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

# Words of the three languages.
MODIFIERS = set("public private protected internal static final abstract synchronized native strictfp transient volatile default sealed virtual override async readonly partial extern unsafe new required declare export accessor const".split())
CLASSES = {"class", "interface", "enum", "record", "struct"}
BEFORE_REGEX = set("return typeof case in of delete void throw new else do instanceof yield await".split())
HEADED = {"if", "while", "for", "with"}
NO_NAMES = set("if for while switch catch return new function using lock foreach else do try await super this synchronized typeof throw case".split())
PAIRS = {"{": "}", "(": ")", "[": "]"}

#: Behind space and comments: a word, a mark of two characters, or any other character.
_NEXT = re.compile(r"(?:\s++|//[^\n]*+|/\*.*?(?:\*/|\Z))*+(?:([^\W\d][\w$]*|[$#][\w$]+|\d[\w.]*)|(=>|==|!=|<=|&&|\|\||\?\?|\?\.)|(.))", re.S)
_PREFIX = re.compile(r"[$@]{1,2}(?=\")")
_PLAIN = re.compile(r"[^\\\"`{$]+")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_QUOTED = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\.)*{q}?", re.S) for q in "\"'"}
_VERBATIM = re.compile(r'"(?:[^"]|"")*"?')
_RAW = re.compile(r'("{3,}).*?(?:\1"*|\Z)', re.S)


@dataclass(slots=True)
class Token:
    kind: str  # word, text (of a string), mark; a group has its opening mark
    text: str
    start: int
    end: int
    inner: Sequence = ()  # a list in an opening mark


def tokens(s: str, lang: str, i: int = 0, until: str | None = None) -> tuple[list[Token], int]:
    """The tokens from i on, and where they end: at the mark ``until`` on this level, or with the source."""
    out: list[Token] = []
    stack: list[tuple[str, bool]] = []  # open brackets, and whether a regular expression may follow them
    literal = True  # whether a slash would begin a regular expression
    while m := _NEXT.match(s, i):
        i, end = m.span(m.lastindex)
        c, kind = s[i], "word" if m.lastindex == 1 else "mark"
        if until == c and not stack:
            return out, i
        if c in "\"'":
            kind, end = "text", string_end(s, i, lang, "")
        elif c in "$@" and lang == "c_sharp" and (prefix := _PREFIX.match(s, i)):
            kind, end = "text", string_end(s, prefix.end(), lang, prefix[0])
        elif c == "`" and lang == "typescript":
            kind, end = "text", holes_end(s, i + 1, lang, "`", "${")
        elif c == "/" and literal and lang == "typescript" and (regex := _REGEX.match(s, i)):
            kind, end = "regex", regex.end()
        text = s[i:end]
        out.append(Token(kind, text, i, end))
        if kind == "word":
            literal = text in BEFORE_REGEX
        elif kind != "mark":
            literal = False
        else:
            literal = c not in ")]"
            if c in PAIRS:
                stack.append((PAIRS[c], c == "(" and len(out) > 1 and out[-2].text in HEADED))
            elif stack and c == stack[-1][0]:
                literal = stack.pop()[1] or c == "}"
        i = end
    return out, len(s)


def string_end(s: str, i: int, lang: str, prefix: str) -> int:
    if lang != "typescript" and s.startswith('"""', i):
        return _RAW.match(s, i).end()
    if "$" in prefix:
        return holes_end(s, i + 1, lang, '"', "{", "@" in prefix)
    return (_VERBATIM if "@" in prefix else _QUOTED[s[i]]).match(s, i).end()


def holes_end(s: str, i: int, lang: str, quote: str, hole: str, verbatim: bool = False) -> int:
    """Behind the closing quote of a string from i on, whose holes hold code."""
    while i < len(s):
        if m := _PLAIN.match(s, i):
            i = m.end()
        elif s[i] == "\\" and not verbatim:
            i += 2
        elif s.startswith(quote, i):
            if verbatim and s.startswith(quote * 2, i):
                i += 2
                continue
            return i + 1
        elif hole == "{" and s.startswith("{{", i):
            i += 2
        elif s.startswith(hole, i):
            i = tokens(s, lang, i + len(hole), "}")[1] + 1
        else:
            i += 1
    return len(s)


def tree(flat: list[Token]) -> list[Token]:
    """Tokens with what stands in brackets inside the token of the opening one; stray marks are left where they are."""
    root: list[Token] = []
    stack: list[Token] = []
    for t in flat:
        here = stack[-1].inner if stack else root
        if t.kind == "mark" and t.text in PAIRS:
            t.inner = []
            here.append(t)
            stack.append(t)
        elif t.kind == "mark" and t.text in ")]}":
            k = next((k for k in reversed(range(len(stack))) if PAIRS[stack[k].text] == t.text), None)
            if k is not None:
                for g in stack[k:]:
                    g.end = t.end
                del stack[k:]
        else:
            here.append(t)
    for g in stack:
        g.end = flat[-1].end
    return root


@dataclass(slots=True)
class Note:
    """An annotation: its name and the token group of its arguments, if any."""

    name: str
    args: Token | None
    start: int

    def string(self, names: tuple[str, ...]) -> str | None:
        """The first string that is a positional argument or has one of the names."""
        return _string(self.args.inner, names) if self.args else None


def _string(inner: list[Token], names: tuple[str, ...]) -> str | None:
    at = 0
    while at < len(inner):
        stop = next((k for k in range(at, len(inner)) if inner[k].text == ","), len(inner))
        arg = inner[at:stop]
        at = stop + 1
        if len(arg) > 1 and arg[0].kind in ("word", "text") and arg[1].text in ("=", ":"):
            if arg[0].text.strip("\"'") not in names:
                continue
            arg = arg[2:]
        for t in arg:
            if t.kind == "text":
                return t.text.lstrip("$@").strip("\"'`")
            if t.text in ("{", "[") and (got := _string(t.inner, names)) is not None:
                return got
    return None


@dataclass(slots=True)
class Member:
    notes: list[Note]
    modifiers: list[str]
    name: str
    kind: str  # method, arrow, field
    type: list[Token]
    params: Token | None
    body: bool
    first: int  # with annotations
    start: int  # behind them
    end: int
    rest: list[Token]


@dataclass(slots=True)
class Klass:
    notes: list[Note]
    modifiers: list[str]
    name: str
    heritage: list[Token]
    members: list[Member]
    nested: list["Klass"]


class Declarations:
    def __init__(self, source: str, lang: str):
        self.source, self.lang = source, lang
        self.items = tree(tokens(source, lang)[0])

    def classes(self) -> list[Klass]:
        """Classes at the top and in namespaces."""
        return self.scope(self.items, None)[1]

    def notes(self, items: list[Token], i: int) -> tuple[list[Note], int]:
        out: list[Note] = []
        while i < len(items):
            t = items[i]
            if self.lang == "c_sharp" and t.text == "[" and t.kind == "mark":
                inner = t.inner[2:] if len(t.inner) > 1 and t.inner[1].text == ":" else t.inner
                for k, x in enumerate(inner):
                    if x.kind == "word" and (k == 0 or inner[k - 1].text == ","):
                        j = k
                        while j + 2 < len(inner) and inner[j + 1].text == ".":
                            j += 2
                        args = inner[j + 1] if j + 1 < len(inner) and inner[j + 1].text == "(" else None
                        out.append(Note(inner[j].text, args, t.start))
                i += 1
            elif self.lang != "c_sharp" and t.text == "@" and i + 1 < len(items) and items[i + 1].text != "interface":
                j = i + 1
                while j + 2 < len(items) and items[j + 1].text == ".":
                    j += 2
                name = items[j].text
                args = items[j + 1] if j + 1 < len(items) and items[j + 1].text == "(" else None
                out.append(Note(name, args, t.start))
                i = j + (2 if args else 1)
            else:
                break
        return out, i

    def scope(self, items: list[Token], owner: str | None) -> tuple[list[Member], list[Klass]]:
        members: list[Member] = []
        classes: list[Klass] = []
        i = 0
        while i < len(items):
            at, begin, modifiers = i, i, []
            found: list[Note] = []
            while True:  # annotations may stand among modifiers: export @A() class
                more, i = self.notes(items, i)
                found, begin = found + more, i if more else begin
                if i + 1 < len(items) and items[i].kind == "word" and items[i].text in MODIFIERS and self.goes_on(items, i + 1):
                    modifiers.append(items[i].text)
                    i += 1
                elif not more:
                    break
            if i >= len(items):
                break
            t = items[i]
            if t.text in ("namespace", "module") and owner is None:
                k = next((k for k in range(i, len(items)) if items[k].text in ("{", ";")), len(items))
                if k < len(items) and items[k].text == "{":
                    classes += self.scope(items[k].inner, None)[1]
                i = k + 1
            elif t.text in CLASSES and i + 1 < len(items) and items[i + 1].kind == "word" and not (t.text == "record" and items[i + 1].text == "struct" and i + 2 >= len(items)):
                k = next((k for k in range(i, len(items)) if items[k].text in ("{", ";")), len(items))
                if k < len(items) and items[k].text == "{" and t.text == "class":
                    m, nested = self.scope(items[k].inner, items[i + 1].text)
                    classes.append(Klass(found, modifiers, items[i + 1].text, items[i + 2 : k], m, nested))
                i = k + 1
            else:
                member, i = self.member(items, at, begin, i, found, modifiers)
                if member and owner is not None:
                    members.append(member)
        return members, classes

    def goes_on(self, items: list[Token], i: int) -> bool:
        """Whether a word before i is a modifier: it isn't if it is itself the name of a member."""
        return not (self.lang == "typescript" and items[i].text in ("(", "=", ":", ";", "?", "!"))

    def member(self, items: list[Token], first: int, begin: int, i: int, found: list[Note], modifiers: list[str]) -> tuple[Member | None, int]:
        head, k = i, i
        while k < len(items):
            t = items[k]
            before = items[k - 1] if k > head else None
            if t.text == "(" and t.kind == "mark" and before is not None and (name := self.named(items, head, k)) is not None:
                end, body = self.rest(items, k + 1)
                made = Member(found, modifiers, items[name].text, "method", items[head:name], t, body, items[first].start, items[begin].start, items[end - 1].end, items[k + 1 : end])
                return made, end
            if t.text in ("=", "=>") and t.kind == "mark":
                end = self.expression(items, k + 1)
                name = next((j for j in range(head, k) if items[j].kind == "word"), None) if self.lang == "typescript" else next((j for j in reversed(range(head, k)) if items[j].kind == "word"), None)
                if name is None:
                    return None, end
                arrow = self.lang == "typescript" and t.text == "=" and self.is_arrow(items, k + 1, end)
                type_ = items[name + 1 : k] if self.lang == "typescript" else items[head:name]
                stop = end - 1 if items[end - 1].text == ";" and end - 1 > k else end
                return Member(found, modifiers, items[name].text, "arrow" if arrow else "field", type_, None, True, items[first].start, items[begin].start, items[stop - 1].end, items[k + 1 : end]), end
            if t.text in (";", "{") and t.kind == "mark" or self.breaks(items, k, head):
                end = k + 1 if t.text in (";", "{") else k
                if t.text == "{" and end < len(items) and items[end].text == "=":
                    end = self.expression(items, end + 1)  # a property with a value
                words = [j for j in range(head, k) if items[j].kind == "word"]
                if not words or (t.text == "{" and self.lang == "typescript"):
                    return None, max(end, i + 1)
                name = words[0] if self.lang == "typescript" else words[-1]
                type_ = items[name + 1 : k] if self.lang == "typescript" else items[head:name]
                return Member(found, modifiers, items[name].text, "field", type_, None, False, items[first].start, items[begin].start, items[end - 1].end, []), max(end, i + 1)
            k += 1
        return None, len(items)

    def named(self, items: list[Token], head: int, k: int) -> int | None:
        """The name before the parameters at k, generics between them aside."""
        j, depth = k - 1, 0
        while j >= head and (depth or items[j].text == ">"):
            depth += (items[j].text == ">") - (items[j].text == "<")
            j -= 1
        t = items[j] if j >= head else None
        ok = t is not None and t.kind == "word" and not t.text[0].isdigit() and t.text not in NO_NAMES and (t.text not in MODIFIERS or (self.lang == "typescript" and j == head))
        return j if ok and (j == head or items[j - 1].text not in (".", "=")) else None

    def rest(self, items: list[Token], k: int) -> tuple[int, bool]:
        """Behind the body, or the mark that ends a declaration without one; and whether it has one."""
        at, depth = k, 0
        while k < len(items):
            t = items[k]
            depth += (t.text == "<") - (t.text == ">")
            if t.text == "{" and t.kind == "mark":
                # a type between a colon and the body may be in braces too
                if self.lang == "typescript" and k > at and (depth > 0 or items[k - 1].text in (":", "|", "&", "is", "extends")):
                    k += 1
                    continue
                return (k + 2 if k + 1 < len(items) and items[k + 1].text == ";" and self.lang != "typescript" else k + 1), True
            if t.text == "=>" and self.lang == "c_sharp":
                return self.expression(items, k + 1), True
            if t.text == ";":
                return k + 1, False
            if self.lang == "typescript" and k > at and self.breaks(items, k, at):
                return k, False
            k += 1
        return k, False

    def expression(self, items: list[Token], k: int) -> int:
        """Behind an expression and the mark that ends it, if any."""
        at = k
        while k < len(items):
            if items[k].text == ";" and items[k].kind == "mark":
                return k + 1
            if k > at and self.breaks(items, k, at):
                return k
            k += 1
        return k

    def breaks(self, items: list[Token], k: int, at: int) -> bool:
        """TypeScript ends a field at a line's end if what follows can only begin another member."""
        if self.lang != "typescript" or k <= at:
            return False
        a, b = items[k - 1], items[k]
        if "\n" not in self.source[a.end : b.start] or (a.kind == "mark" and a.text not in PAIRS):
            return False
        return (b.kind == "word" and b.text not in ("instanceof", "in", "as", "satisfies")) or b.text in ("@", "}", "[", "#")

    def is_arrow(self, items: list[Token], k: int, end: int) -> bool:
        if k < end and items[k].text == "async" and k + 1 < end:
            k += 1
        depth = 0
        while k < end and (items[k].text == "<" or depth):
            depth += (items[k].text == "<") - (items[k].text == ">")
            k += 1
        if k >= end or not (items[k].text == "(" or items[k].kind == "word"):
            return False
        if items[k].kind == "word":
            return k + 1 < end and items[k + 1].text == "=>"
        return any(t.text == "=>" for t in items[k + 1 : end][:1]) or (k + 1 < end and items[k + 1].text == ":" and any(t.text == "=>" for t in items[k + 1 : end]))


def walk(items: list[Token]) -> Iterator[list[Token]]:
    """Every list of tokens of a tree, the outer ones first."""
    yield items
    for t in items:
        if t.inner:
            yield from walk(t.inner)
