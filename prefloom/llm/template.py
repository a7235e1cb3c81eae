"""A small sandboxed template language, compiled to Python closures.

``{{ expression }}`` writes a value, ``{% for x in list %}``, ``{% if %} / {% elif %} / {% else %}``
and ``{% set x = expression %}`` steer, ``{% generation %} ... {% endgeneration %}`` marks what a model
is to produce, ``{# #}`` is a comment, and a dash inside a tag's border trims the white space beside it.

A template is parsed into a syntax tree, constants given at compile time are put in for their
names, constant parts are evaluated once, dead branches go and neighbouring texts become one.
Each node that is left is turned into a closure. Templates reach strings, numbers, truth
values, lists and mappings only: names and keys are looked up in mappings, nothing is called but the
filters below, there are no attributes and no loops other than over given lists.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

DEPTH = 60


class TemplateError(ValueError):
    pass


# ------------------------------------------------------------------- syntax

@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    base: object
    key: object


@dataclass(frozen=True)
class Call:
    """An operator or filter of :data:`FUNCTIONS` applied to operands."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    """``then`` if ``test`` holds, else ``other``; also ``and`` and ``or``, where None stands for the test's value."""

    test: object
    then: object
    other: object


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Write:
    value: object


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Loop:
    name: str
    values: object
    body: tuple


@dataclass(frozen=True)
class Branch:
    test: object
    body: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def shown(value) -> str:
    if value is None:
        return ""
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"cannot write a {type(value).__name__}")


def guard(text: str) -> str:
    r"""``text`` without ``<|``: a backslash is put before the bar, one more than there are."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unguard(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def line(text: str) -> str:
    r"""``text`` on one line: newlines as ``\n``, backslashes doubled."""
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


def _plus(a, b):
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int):
        return a + b
    raise TemplateError("+ takes two strings or two numbers")


def _minus(a, b):
    if isinstance(a, int) and isinstance(b, int):
        return a - b
    raise TemplateError("- takes two numbers")


def _less(a, b):
    if type(a) is type(b) and isinstance(a, (str, int)):
        return a < b
    raise TemplateError("only two strings or two numbers have an order")


def _within(a, b):
    if isinstance(b, str):
        return isinstance(a, str) and a in b
    return isinstance(b, (list, tuple, dict)) and a in b


FUNCTIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": _within, "not in": lambda a, b: not _within(a, b),
    "<": _less, ">": lambda a, b: _less(b, a), "<=": lambda a, b: not _less(b, a), ">=": lambda a, b: not _less(a, b),
    "+": _plus, "-": _minus, "~": lambda a, b: shown(a) + shown(b), "not": lambda a: not a,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda v: shown(v).strip(), "upper": lambda v: shown(v).upper(), "lower": lambda v: shown(v).lower(),
    "string": shown, "length": lambda v: len(v) if isinstance(v, (str, list, tuple, dict)) else 0,
    "default": lambda v, other: other if v is None else v,
    "guard": lambda v: guard(shown(v)), "line": lambda v: line(shown(v)),
}


# ------------------------------------------------------------------ parsing

_INSIDE = r"""(?:'[^']*'|"[^"]*"|[^'"])*?"""
_TAG = re.compile(r"\{\{-?(" + _INSIDE + r")-?\}\}|\{%-?(" + _INSIDE + r")-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:('[^']*'|"[^"]*")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+\-~|.,()\[\]=]))""")
_VALUES = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_WORDS = {"and", "or", "not", "in", "if", "else"}


class _Expression:
    """Recursive descent over one tag's tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:].strip()!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = self.depth = 0

    def peek(self):
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, *values) -> str | None:
        """The next token if it is one of ``values`` and no quoted string."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] != 1 and self.peek() in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}, found {self.peek()!r}")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == 3 and self.peek() not in _WORDS | _VALUES.keys():
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError(f"expected a name, found {self.peek()!r}")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")

    def whole(self):
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("expression too deep")
        value = self.either()
        if self.take("if"):
            test = self.either()
            value = Choice(test, value, self.whole() if self.take("else") else Const(None))
        self.depth -= 1
        return value

    def either(self):
        value = self.both()
        while self.take("or"):
            value = Choice(value, None, self.both())
        return value

    def both(self):
        value = self.negated()
        while self.take("and"):
            value = Choice(value, self.negated(), None)
        return value

    def negated(self):
        n = 0
        while self.take("not"):
            n += 1
        value = self.compared()
        for _ in range(min(n, 2 + n % 2)):
            value = Call("not", (value,))
        return value

    def compared(self):
        value = self.joined()
        op = self.take("==", "!=", "<=", ">=", "<", ">", "in")
        if not op and self.peek() == "not" and self.take("not"):
            self.need("in")
            op = "not in"
        return Call(op, (value, self.joined())) if op else value

    def joined(self):
        value = self.postfix()
        while op := self.take("+", "-", "~"):
            value = Call(op, (value, self.postfix()))
        return value

    def postfix(self):
        value = self.atom()
        while op := self.take(".", "[", "|"):
            if op == ".":
                value = Item(value, Const(self.name()))
            elif op == "[":
                value = Item(value, self.whole())
                self.need("]")
            else:
                name, args = self.name(), [value]
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                if self.take("("):
                    while not self.take(")"):
                        args.append(self.whole())
                        self.take(",")
                value = Call("|" + name, tuple(args))
        return value

    def atom(self):
        if self.take("("):
            value = self.whole()
            self.need(")")
            return value
        kind, token = self.tokens[self.at] if self.at < len(self.tokens) else (0, None)
        if kind in (1, 2):
            self.at += 1
            return Const(int(token) if kind == 2 else token[1:-1])
        if kind == 3 and token in _VALUES:
            self.at += 1
            return Const(_VALUES[token])
        return Name(self.name())


def _pieces(template: str) -> list[tuple[str, str]]:
    """``(kind, content)`` of texts, ``write`` tags and ``do`` tags, white space trimmed where asked."""
    out, at, trim = [], 0, False
    for m in _TAG.finditer(template):
        text = template[at:m.start()]
        text = text.lstrip() if trim else text
        out.append(("text", text.rstrip() if m[0][2] == "-" else text))
        at, trim = m.end(), m[0][-3] == "-"
        if m[0][1] != "#":
            out.append(("write", m[1]) if m[0][1] == "{" else ("do", m[2]))
    rest = template[at:]
    out.append(("text", rest.lstrip() if trim else rest))
    for kind, content in out:
        if kind == "text" and ("{{" in content or "{%" in content):
            raise TemplateError(f"tag without an end in {content[:40]!r}")
    return out


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    pieces, at = _pieces(template), 0

    def block(ends: set[str], depth: int) -> tuple[tuple, str | None, _Expression | None]:
        nonlocal at
        if depth > DEPTH:
            raise TemplateError("blocks nested too deep")
        body = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            if kind == "text":
                body.append(Text(content))
                continue
            e = _Expression(content)
            if kind == "write":
                body.append(Write(e.whole()))
                e.end()
                continue
            word = e.take("for", "if", "elif", "else", "endif", "endfor", "set", "generation", "endgeneration")
            if word in ends:
                return tuple(body), word, e
            if word == "for":
                name = e.name()
                e.need("in")
                values = e.whole()
                e.end()
                body.append(Loop(name, values, block({"endfor"}, depth + 1)[0]))
            elif word == "if":
                body.append(branch(e, depth))
            elif word == "set":
                name = e.name()
                e.need("=")
                body.append(Assign(name, e.whole()))
                e.end()
            elif word == "generation":
                body.append(Generation(block({"endgeneration"}, depth + 1)[0]))
            else:
                raise TemplateError(f"unexpected tag {content.strip()!r}")
        if ends:
            raise TemplateError(f"missing {' or '.join(sorted(ends))}")
        return tuple(body), None, None

    def branch(e: _Expression, depth: int) -> Branch:
        test = e.whole()
        e.end()
        body, word, rest = block({"elif", "else", "endif"}, depth + 1)
        if word == "elif":
            return Branch(test, body, (branch(rest, depth + 1),))
        return Branch(test, body, block({"endif"}, depth + 1)[0] if word == "else" else ())

    return block(set(), 0)[0]


# ------------------------------------------------------------------ folding

def _set_names(body: tuple) -> set[str]:
    """Names that a template gives values itself."""
    found = set()
    for node in body:
        if isinstance(node, (Assign, Loop)):
            found.add(node.name)
        found |= _set_names(getattr(node, "body", ())) | _set_names(getattr(node, "other", ()) if isinstance(node, Branch) else ())
    return found


def _item(base, key):
    if isinstance(base, dict):
        return base.get(key)
    if isinstance(base, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return base[key] if -len(base) <= key < len(base) else None
    return None


def _function(name: str) -> Callable:
    return FILTERS[name[1:]] if name[0] == "|" else FUNCTIONS[name]


def fold(node, constants: dict):
    """``node`` with constants put in and whatever depends on constants alone evaluated."""
    again = lambda n: fold(n, constants)
    if isinstance(node, Name):
        return Const(constants[node.name]) if node.name in constants else node
    if isinstance(node, Item):
        base, key = again(node.base), again(node.key)
        return Const(_item(base.value, key.value)) if isinstance(base, Const) and isinstance(key, Const) else Item(base, key)
    if isinstance(node, Call):
        args = tuple(map(again, node.args))
        if all(isinstance(a, Const) for a in args):
            try:
                return Const(_function(node.name)(*[a.value for a in args]))
            except TypeError as error:
                raise TemplateError(f"{node.name}: {error}") from None
        return Call(node.name, args)
    if isinstance(node, Choice):
        test = again(node.test)
        then, other = (None if n is None else again(n) for n in (node.then, node.other))
        if isinstance(test, Const):
            return (then if test.value else other) or test
        return Choice(test, then, other)
    if isinstance(node, Write):
        value = again(node.value)
        return Text(shown(value.value)) if isinstance(value, Const) else Write(value)
    if isinstance(node, Assign):
        return replace(node, value=again(node.value))
    if isinstance(node, Loop):
        return Loop(node.name, again(node.values), fold_body(node.body, constants))
    if isinstance(node, Branch):
        return Branch(again(node.test), fold_body(node.body, constants), fold_body(node.other, constants))
    return Generation(fold_body(node.body, constants)) if isinstance(node, Generation) else node


def fold_body(body: tuple, constants: dict) -> tuple:
    out: list = []

    def add(nodes) -> None:
        for node in nodes:
            if isinstance(node, Branch) and isinstance(node.test, Const):
                add(node.body if node.test.value else node.other)
            elif isinstance(node, Loop) and isinstance(node.values, Const) and not node.values.value:
                continue
            elif isinstance(node, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + node.text)
            elif not isinstance(node, Text) or node.text:
                out.append(node)

    add(fold(n, constants) for n in body)
    return tuple(out)


# ----------------------------------------------------------------- closures

@dataclass
class Page:
    """What has been written, and the spans (in code points) under a generation marker."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def expression(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, value=node.value: value
    if isinstance(node, Name):
        return lambda env, name=node.name: env.get(name)
    if isinstance(node, Item):
        base = expression(node.base)
        if isinstance(node.key, Const):
            return lambda env, key=node.key.value: _item(base(env), key)
        key_of = expression(node.key)
        return lambda env: _item(base(env), key_of(env))
    if isinstance(node, Choice):
        test, then, other = (None if n is None else expression(n) for n in (node.test, node.then, node.other))

        def choose(env):
            value = test(env)
            branch = then if value else other
            return branch(env) if branch else value

        return choose
    fn, args = _function(node.name), [expression(a) for a in node.args]
    if len(args) == 1:
        only = args[0]
        return lambda env: fn(only(env))
    return lambda env: fn(*[a(env) for a in args])


def statement(node, marked: bool = False) -> Callable[[dict, Page], None]:
    if isinstance(node, Text):
        return lambda env, page, text=node.text: page.write(text)
    if isinstance(node, Write):
        value = expression(node.value)
        return lambda env, page: page.write(shown(value(env)))
    if isinstance(node, Assign):
        value = expression(node.value)

        def assign(env, page, name=node.name):
            env[name] = value(env)

        return assign
    if isinstance(node, Branch):
        test, body, other = expression(node.test), sequence(node.body, marked), sequence(node.other, marked)
        return lambda env, page: (body if test(env) else other)(env, page)
    if isinstance(node, Loop):
        values, body = expression(node.values), sequence(node.body, marked)

        def loop(env, page, name=node.name):
            items = values(env)
            if items is None:
                return
            if not isinstance(items, (list, tuple)):
                raise TemplateError("for takes a list")
            n, inner = len(items), dict(env)
            for i, item in enumerate(items):
                inner[name] = item
                inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == n - 1, "length": n}
                body(inner, page)

        return loop
    if marked:
        raise TemplateError("generation markers do not nest")
    body = sequence(node.body, True)

    def generation(env, page):
        start = page.size
        body(env, page)
        page.spans.append((start, page.size))

    return generation


def sequence(body: tuple, marked: bool = False) -> Callable[[dict, Page], None]:
    steps = [statement(n, marked) for n in body]
    if len(steps) == 1:
        return steps[0]

    def run(env, page):
        for step in steps:
            step(env, page)

    return run


def compiled(template: str, constants: dict | None = None) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from values of names to the text and its marked spans."""
    tree = parse(template)
    given = {k: v for k, v in (constants or {}).items() if k not in _set_names(tree)}
    run, kept = sequence(fold_body(tree, given)), {k: v for k, v in (constants or {}).items() if k not in given}

    def render(values: dict) -> tuple[str, list[tuple[int, int]]]:
        page = Page()
        try:
            run({**kept, **values}, page)
        except TypeError as error:
            raise TemplateError(str(error)) from None
        return "".join(page.parts), page.spans

    return render
