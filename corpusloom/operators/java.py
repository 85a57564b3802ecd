"""Where the methods of a Java source lie, at any depth, and which doc comment stands next to each."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Words that may stand before a method's type, and those that begin a type.
MODIFIERS = frozenset(
    "public protected private static final abstract native synchronized default strictfp transient volatile sealed".split()
)
TYPES = {"class": "type", "interface": "type", "enum": "enum"}

#: Text blocks before strings, comments whole, words, then single signs. What matches nothing is blank.
TOKEN = re.compile(
    r'''"""(?:\\.|[^\\])*?"""|"(?:\\.|[^\\"\n])*"|'(?:\\.|[^\\'\n])*'|//[^\n]*|/\*.*?\*/|[^\W]+(?:[\w$])*|\$[\w$]*|\S''', re.S
)


def is_doc(comment: str) -> bool:
    return comment.startswith("/**") and len(comment) > 4


@dataclass
class Method:
    start: int
    end: int = -1
    before: str | None = None
    after: str | None = None


@dataclass
class Level:
    """One open bracket. ``kind``: a ``type``, ``enum`` or ``annotation`` body has members, ``code`` and ``paren`` have not.

    ``ends`` tells what the closing bracket ends: a ``member`` of the level above, a ``method`` of it, or nothing.
    """

    kind: str
    ends: str = ""
    method: Method | None = None
    created: bool = False
    # The member or statement so far: where it begins, its words before any bracket, whether brackets or ``=`` came.
    start: int = -1
    words: list[str] = field(default_factory=list)
    called: bool = False
    assigned: bool = False
    declares: str = ""
    comment: str | None = None
    closed: Method | None = None
    # An annotation being read: 1 after its sign or a dot, 2 after a name. ``new`` and the type after it; its brackets closed.
    annotation: int = 0
    new: bool = False
    made: bool = False
    constants: bool = False
    last: str = ""

    def next_member(self) -> None:
        self.start, self.words, self.called, self.assigned, self.declares = -1, [], False, False, ""
        self.comment, self.closed, self.annotation, self.new, self.made = None, None, 0, False, False

    @property
    def has_members(self) -> bool:
        return self.kind in ("type", "enum", "annotation") and not self.constants

    def is_method(self) -> bool:
        """A type and a name before the first bracket. A constructor has its name alone, an initialiser nothing."""
        if self.kind == "annotation" or self.assigned or not self.called:
            return False
        words, depth = [], 0
        for at, word in enumerate(self.words):
            if word == "<" and not words and not depth:
                depth = 1
            elif depth and not words:
                depth += {"<": 1, ">": -1}.get(word, 0)
            elif word not in MODIFIERS and not (word == "non" and self.words[at + 1 : at + 2] == ["-"]) and word != "-":
                words.append(word)
        return len(words) > 1


def methods(source: str) -> list[Method]:
    """All methods in the order of their beginnings: those of classes, interfaces, enums and records, of enum constants, of
    anonymous and of local classes. Constructors, initialisers, lambdas and the elements of annotation types are none.

    Of the comments beside a method the one just before it counts, and the one just after it. Sources that are not
    well-formed give what can be told; brackets too many are passed over.
    """
    found: list[Method] = []
    levels = [Level("type")]
    tokens = list(TOKEN.finditer(source))
    for n, match in enumerate(tokens):
        level, token, begin, end = levels[-1], match[0], match.start(), match.end()
        if token[:2] in ("//", "/*"):
            if level.has_members and level.start < 0:
                if level.closed is not None and is_doc(token):
                    level.closed.after = token
                level.closed, level.comment = None, token
            continue
        made, level.made = level.made, False
        if token == "{":
            levels.append(opened(level, begin, made, found))
        elif token in "([":
            if level.start < 0:
                level.start = begin
            level.closed = None
            annotated, level.annotation = level.annotation == 2 and token == "(", 0
            if not annotated and token == "(" and not level.assigned:
                level.called = True
            levels.append(Level("paren", created=level.new and token == "(" and not annotated))
            level.new = level.new and annotated
        elif token in ")]":
            if level.kind == "paren":
                levels.pop()
                levels[-1].made = level.created
        elif token == "}":
            closed(levels, end)
        elif token == ";":
            if level.has_members:
                if level.start >= 0 and level.is_method():
                    found.append(Method(level.start, end, level.comment))
                    last = found[-1]
                    level.next_member()
                    level.closed = last
                else:
                    level.next_member()
            else:
                level.constants = False
                level.next_member()
        else:
            word(level, token, begin, tokens, n)
        level.last = token
    return sorted((m for m in found if m.end >= 0), key=lambda m: m.start)


def word(level: Level, token: str, begin: int, tokens: list[re.Match], n: int) -> None:
    """Any token that neither opens, closes nor ends something."""
    first = level.start < 0
    if first:
        level.start, level.closed = begin, None
    name = token[0].isalpha() or token[0] in "_$"
    if token == "@":
        level.annotation = 1
        return
    if level.annotation == 1 and name and token != "interface":
        level.annotation = 2
        return
    if level.annotation == 2 and token == ".":
        level.annotation = 1
        return
    kind = "annotation" if level.annotation == 1 and token == "interface" else TYPES.get(token, "")
    level.annotation = 0
    if token == "record" and (first or set(level.words) <= MODIFIERS or level.kind == "code") and declares_record(level, tokens, n):
        kind = "type"
    if kind and level.last != "." and not level.called and not level.assigned:
        level.declares = level.declares or kind
    if token == "=":
        level.assigned = True
    if token == "new":
        level.new = True
    elif level.new and not (name or token in ".<>,?&"):
        level.new = False
    if not level.called:
        level.words.append(token)


def declares_record(level: Level, tokens: list[re.Match], n: int) -> bool:
    after = [m[0] for m in tokens[n + 1 : n + 3]]
    return level.last != "." and len(after) == 2 and (after[0][0].isalpha() or after[0][0] in "_$") and after[1] in ("(", "<")


def opened(level: Level, begin: int, made: bool, found: list[Method]) -> Level:
    """The level that a curly bracket opens."""
    level.closed = None
    if made or level.constants:
        return Level("type")
    if level.declares:
        inner = Level(level.declares, "member")
        inner.constants = level.declares == "enum"
        return inner
    if level.has_members and not level.assigned:
        if level.start >= 0 and level.is_method():
            found.append(Method(level.start, before=level.comment))
            return Level("code", "method", found[-1])
        return Level("code", "member")
    # A block, a lambda's body or the values of an array; in code it ends the statement before it.
    return Level("code", "member" if level.kind == "code" and not level.assigned and not level.new else "")


def closed(levels: list[Level], end: int) -> None:
    """A closing curly bracket: brackets left open inside are closed with it."""
    if not any(level.kind != "paren" for level in levels[1:]):
        return
    while levels[-1].kind == "paren":
        levels.pop()
    inner, outer = levels.pop(), levels[-1]
    if inner.method is not None:
        inner.method.end = end
        outer.next_member()
        outer.closed = inner.method
    elif inner.ends == "member":
        outer.next_member()
