"""Nix files: a small lenient reader of the language, and what a module declares, sets and uses.

The reader turns text into nested tuples of a few expression kinds; strings are read
with their ``${ }`` parts as expressions. What can't be decided from the text alone
(dynamic keys, computed imports) becomes :data:`UNKNOWN` and yields no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from typing import Any

from knotweave.extract.registry import Edge, Node, register

UNKNOWN = ("unknown",)

_SPACE = re.compile(r"(?:\s+|#[^\n]*|/\*.*?\*/)+", re.DOTALL)
_TOKEN = re.compile(
    r"""(?P<uri>[A-Za-z][A-Za-z0-9+.\-]*://[^\s"'\[\](){};,]+)
      | (?P<path>(?:\.\.?|~)?/[A-Za-z0-9._+\-][A-Za-z0-9._+/~\-]*|\.\.?/|\.\.?(?=[\s;)\]]))
      | (?P<lookup><[A-Za-z0-9._+/\-]+>)
      | (?P<number>0x[0-9A-Fa-f]+|\d+\.\d*(?:[eE][+-]?\d+)?|\d+)
      | (?P<name>[A-Za-z_][A-Za-z0-9_'\-]*)
      | (?P<op>\.\.\.|\$\{|->|==|!=|<=|>=|&&|\|\||//|\+\+|[{}()\[\];:,.=?@!<>+\-*/])""",
    re.VERBOSE,
)
_KEYWORDS = {"let", "in", "with", "rec", "if", "then", "else", "inherit", "assert"}
# Binary operators of the language from loosest to tightest.
_TIERS = [["//"], ["->"], ["||"], ["&&"], ["==", "!=", "<", ">", "<=", ">="], ["?"], ["++"], ["+", "-"], ["*", "/"]]


@dataclass
class Token:
    kind: str
    value: Any
    line: int


@dataclass
class Binding:
    keys: list[str | None]  # None: a dynamic part
    value: Any  # None: inherited
    line: int


class NixSyntaxError(ValueError):
    pass


class Reader:
    """Text to tokens; a string is one token whose parts are text or token lists."""

    def __init__(self, text: str):
        self.text = text
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        return bisect_left(self.ends, at) + 1

    def read(self, at: int = 0, nested: bool = False) -> tuple[list[Token], int]:
        out: list[Token] = []
        depth, text, n = 0, self.text, len(self.text)
        line, counted = self.line(at), at
        while at < n:
            if m := _SPACE.match(text, at):
                at = m.end()
                continue
            line += text.count("\n", counted, at)
            counted = at
            if text.startswith("''", at):
                parts, at = self.string(at + 2, "''")
                out.append(Token("string", parts, line))
            elif text[at] == '"':
                parts, at = self.string(at + 1, '"')
                out.append(Token("string", parts, line))
            elif m := _TOKEN.match(text, at):
                kind, value = m.lastgroup, m[0]
                if value in ("{", "${"):
                    depth += 1
                elif value == "}":
                    if nested and depth <= 0:
                        return out, m.end()
                    depth -= 1
                if kind == "name" and (value in _KEYWORDS or value == "or"):
                    kind, value = "op", value
                out.append(Token(kind, value, line))
                at = m.end()
            else:  # lenient: what isn't known is left out
                at += 1
        return out, at

    def string(self, at: int, close: str) -> tuple[list[Any], int]:
        parts: list[Any] = []
        held: list[str] = []
        text = self.text
        while at < len(text):
            if close == "''" and text.startswith(("''$", "'''", "''\\"), at):
                held.append(text[at + 2 : at + 3] if text[at + 2] != "\\" else text[at + 3 : at + 4])
                at += 3 if text[at + 2] != "\\" else 4
            elif text.startswith(close, at):
                at += len(close)
                break
            elif close == '"' and text[at] == "\\":
                held.append({"n": "\n", "t": "\t", "r": "\r"}.get(text[at + 1 : at + 2], text[at + 1 : at + 2]))
                at += 2
            elif text.startswith("${", at):
                if held:
                    parts.append("".join(held))
                    held = []
                inner, at = self.read(at + 2, nested=True)
                parts.append(inner)
            else:
                held.append(text[at])
                at += 1
        if held or not parts:
            parts.append("".join(held))
        return parts, at


class Parser:
    """Tokens to expressions: tuples that start with their kind."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else Token("end", "", 0)

    def is_op(self, *values: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.kind == "op" and t.value in values

    def take(self, value: str) -> Token:
        t = self.peek()
        if t.kind != "op" or t.value != value:
            raise NixSyntaxError(f"line {t.line}: {value!r} expected, not {t.value!r}")
        self.at += 1
        return t

    def whole(self) -> Any:
        e = self.expression()
        if self.peek().kind != "end":
            raise NixSyntaxError(f"line {self.peek().line}: unexpected {self.peek().value!r}")
        return e

    def expression(self) -> Any:
        t = self.peek()
        if t.kind == "name" and self.is_op(":", ahead=1):
            self.at += 2
            return ("lambda", [t.value], self.expression())
        if t.kind == "name" and self.is_op("@", ahead=1) and self.is_op("{", ahead=2):
            self.at += 2
            names = self.formals()
            self.take(":")
            return ("lambda", names, self.expression())
        if self.is_op("{") and self.looks_like_formals():
            names = self.formals()
            if self.is_op("@"):
                self.at += 2
            self.take(":")
            return ("lambda", names, self.expression())
        if self.is_op("let"):
            self.at += 1
            bindings = self.bindings("in")
            self.take("in")
            return ("let", bindings, self.expression())
        if self.is_op("with", "assert"):
            kind = self.peek().value
            self.at += 1
            first = self.expression()
            self.take(";")
            return (kind, first, self.expression())
        if self.is_op("if"):
            self.at += 1
            test = self.expression()
            self.take("then")
            yes = self.expression()
            self.take("else")
            return ("if", test, yes, self.expression())
        return self.binary(0)

    def looks_like_formals(self) -> bool:
        depth, i = 0, self.at
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == "op" and t.value in ("{", "${"):
                depth += 1
            elif t.kind == "op" and t.value == "}":
                depth -= 1
                if not depth:
                    after = [x.value if x.kind in ("op", "name") else "" for x in self.tokens[i + 1 : i + 4]]
                    return after[:1] == [":"] or (after[:1] == ["@"] and after[2:3] == [":"])
            i += 1
        return False

    def formals(self) -> list[str]:
        self.take("{")
        names: list[str] = []
        while not self.is_op("}"):
            t = self.peek()
            self.at += 1
            if t.kind == "name":
                names.append(t.value)
                if self.is_op("?"):
                    self.at += 1
                    self.expression()
            if self.is_op(","):
                self.at += 1
            elif not self.is_op("}") and t.kind == "end":
                raise NixSyntaxError("formals don't end")
        self.take("}")
        return names

    def binary(self, tier: int) -> Any:
        if tier == len(_TIERS):
            return self.unary()
        left = self.binary(tier + 1)
        while self.is_op(*_TIERS[tier]):
            op = self.peek().value
            self.at += 1
            left = ("has", left, self.attr_path()) if op == "?" else ("binary", op, left, self.binary(tier + 1))
        return left

    def unary(self) -> Any:
        if self.is_op("!", "-"):
            op = self.peek().value
            self.at += 1
            return ("unary", op, self.unary())
        return self.application()

    def starts_value(self) -> bool:
        return self.peek().kind in ("name", "string", "number", "path", "uri", "lookup") or self.is_op("{", "[", "(", "rec")

    def application(self) -> Any:
        fn = self.selection()
        while self.starts_value():
            fn = ("apply", fn, self.selection())
        return fn

    def selection(self) -> Any:
        e = self.primary()
        if self.is_op("."):
            self.at += 1
            e = ("select", e, self.attr_path())
            if self.is_op("or"):  # a default value
                mark = self.at
                self.at += 1
                if self.starts_value():
                    self.selection()
                else:
                    self.at = mark
        return e

    def attr_path(self) -> list[str | None]:
        keys: list[str | None] = []
        while True:
            t = self.peek()
            if t.kind in ("name", "number"):
                self.at += 1
                keys.append(str(t.value))
            elif t.kind == "string":
                self.at += 1
                keys.append(t.value[0] if len(t.value) == 1 and isinstance(t.value[0], str) else None)
            elif self.is_op("${"):
                self.at += 1
                self.expression()
                self.take("}")
                keys.append(None)
            elif t.kind == "op" and t.value in _KEYWORDS:
                self.at += 1
                keys.append(t.value)
            else:
                raise NixSyntaxError(f"line {t.line}: attribute expected, not {t.value!r}")
            if not self.is_op("."):
                return keys
            self.at += 1

    def bindings(self, *ends: str) -> list[Binding]:
        out: list[Binding] = []
        while not self.is_op(*ends):
            t = self.peek()
            if t.kind == "end":
                raise NixSyntaxError("bindings don't end")
            if self.is_op("inherit"):
                self.at += 1
                source = None
                if self.is_op("("):
                    self.at += 1
                    source = self.expression()
                    self.take(")")
                    out.append(Binding([None], ("inherit", source), t.line))
                while not self.is_op(";"):
                    if self.peek().kind == "end":
                        raise NixSyntaxError("inherit doesn't end")
                    out.append(Binding([str(self.peek().value)], None, t.line))
                    self.at += 1
                self.take(";")
                continue
            keys = self.attr_path()
            self.take("=")
            out.append(Binding(keys, self.expression(), t.line))
            self.take(";")
        return out

    def primary(self) -> Any:
        t = self.peek()
        self.at += 1
        if t.kind == "name":
            return ("literal", {"true": True, "false": False, "null": None}[t.value]) if t.value in ("true", "false", "null") else ("name", t.value)
        if t.kind in ("number", "uri", "lookup"):
            return ("literal", t.value)
        if t.kind == "path":
            return ("path", t.value)
        if t.kind == "string":
            return ("string", [p if isinstance(p, str) else Parser(p).whole() if p else UNKNOWN for p in t.value])
        if t.kind == "op" and t.value == "rec":
            return self.primary()
        if t.kind == "op" and t.value == "{":
            found = self.bindings("}")
            self.take("}")
            return ("attrs", found)
        if t.kind == "op" and t.value == "[":
            items = []
            while not self.is_op("]"):
                if self.peek().kind == "end":
                    raise NixSyntaxError("a list doesn't end")
                items.append(self.selection())
            self.take("]")
            return ("list", items)
        if t.kind == "op" and t.value == "(":
            if self.is_op(")"):
                self.at += 1
                return UNKNOWN
            e = self.expression()
            self.take(")")
            return e
        raise NixSyntaxError(f"line {t.line}: a value expected, not {t.value!r}")


def dotted(e: Any) -> str | None:
    if e[0] == "name":
        return e[1]
    if e[0] == "select" and None not in e[2] and (base := dotted(e[1])):
        return ".".join([base, *e[2]])
    return None


def shown(e: Any) -> str:
    """A literal as metadata: ``str()`` of its value, the dotted name, else ''."""
    if e is None:
        return ""
    if e[0] == "literal":
        return "" if e[1] is None else str(e[1])
    if e[0] == "path":
        return e[1]
    if e[0] == "string":
        return "".join(p for p in e[1] if isinstance(p, str)) if all(isinstance(p, str) for p in e[1]) else ""
    return dotted(e) or ""


def called(e: Any) -> tuple[str | None, list[Any]]:
    """The last part of the applied function's name, and its arguments."""
    args: list[Any] = []
    while e[0] == "apply":
        args.insert(0, e[2])
        e = e[1]
    name = dotted(e)
    return (name.rsplit(".", 1)[-1] if name else None), args


def resolve(path: str, target: str) -> str:
    """``target`` seen from the folder of ``path``; a folder means its default.nix; leading ``..`` stay."""
    if target.startswith(("/", "~", "<")):
        joined = target
    else:
        parts: list[str] = []
        for p in [*path.split("/")[:-1], *target.split("/")]:
            if p == ".." and parts and parts[-1] != "..":
                parts.pop()
            elif p not in ("", "."):
                parts.append(p)
        joined = "/".join(parts)
    last = joined.rsplit("/", 1)[-1]
    return joined if "." in last.lstrip(".") else f"{joined.rstrip('/')}/default.nix"


@dataclass
class Module:
    path: str
    nodes: list[Node] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)
    env: dict[str, Any] = field(default_factory=dict)

    @property
    def id(self) -> str:
        return f"nix:{self.path}"

    def edge(self, target: str, kind: str, meta: dict) -> None:
        self.edges.append((self.id, target, kind, meta))

    # imports -----------------------------------------------------------------

    def text_of(self, e: Any, hops: int = 1) -> str | None:
        """A path's or a string's text, through at most one let name."""
        if e[0] == "path":
            return e[1]
        if e[0] == "string":
            parts = [p if isinstance(p, str) else self.text_of(p, hops) for p in e[1]]
            return None if None in parts else "".join(parts)
        if e[0] == "literal" and isinstance(e[1], str):
            return e[1]
        if e[0] == "apply" and called(e)[0] == "toString":
            return self.text_of(e[2], hops)
        if e[0] == "name" and hops and e[1] in self.env:
            return self.text_of(self.env[e[1]], hops - 1)
        return None

    def imports(self, e: Any, conditional: bool) -> None:
        if e[0] == "let":
            for b in e[1]:
                if len(b.keys) == 1 and b.keys[0] and b.value:
                    self.env[b.keys[0]] = b.value
            self.imports(e[2], conditional)
        elif e[0] == "binary" and e[1] == "++":
            self.imports(e[2], conditional)
            self.imports(e[3], conditional)
        elif e[0] == "list":
            for item in e[1]:
                text = self.text_of(item) if item[0] in ("path", "string") else None
                if text and (item[0] == "path" or text.startswith(("./", "../", "/"))):
                    self.edge(f"nix:{resolve(self.path, text)}", "imports", {"conditional": conditional, "line": 0})

    def bare_imports(self, e: Any) -> None:
        """``import ./x`` anywhere but below ``imports``, and the paths of ``modules = [ ]``."""
        if isinstance(e, Binding):
            if e.keys[-1:] == ["imports"]:
                return
            if e.keys[-1:] == ["modules"] and e.value and e.value[0] == "list":
                for item in e.value[1]:
                    if item[0] == "path":
                        self.edge(f"nix:{resolve(self.path, item[1])}", "imports", {"conditional": False, "line": 0})
                    elif item[0] == "select" and item[1][0] == "name" and None not in item[2]:
                        self.edge(f"flake_input:{item[1][1]}", "references", {"line": e.line, "select": ".".join(item[2])})
            self.bare_imports(e.value)
        elif isinstance(e, tuple):
            if e[0] == "apply" and e[1] == ("name", "import") and e[2][0] == "path":
                self.edge(f"nix:{resolve(self.path, e[2][1])}", "imports", {"conditional": False, "line": 0})
            for x in e[1:]:
                self.bare_imports(x)
        elif isinstance(e, list):
            for x in e:
                self.bare_imports(x)

    # options and settings ------------------------------------------------------

    def options(self, e: Any, prefix: list[str], line: int) -> None:
        if e is None or None in prefix:
            return
        name, args = called(e) if e[0] == "apply" else (None, [])
        if name == "mkOption" and args and args[0][0] == "attrs":
            meta = {b.keys[0]: b.value for b in args[0][1] if len(b.keys) == 1}
            found = {"opt_type": shown(meta.get("type")), "default": shown(meta.get("default")), "example": shown(meta.get("example")), "description": shown(meta.get("description"))}
        elif name == "mkEnableOption":
            found = {"opt_type": "types.bool", "default": "false", "example": "", "description": shown(args[0]) if args else ""}
        elif e[0] == "attrs":
            for b in e[1]:
                if b.value and None not in b.keys:
                    self.options(b.value, prefix + b.keys, b.line)
            return
        else:
            return
        target = "nix_option:" + ".".join(prefix)
        self.nodes.append((target, "nix_option", ".".join(prefix), "nix", {**found, "line": line}))
        self.edge(target, "declares", {"line": line})

    def set_(self, keys: list[str], conditional: bool, line: int, priority: str | None = None) -> None:
        self.edge("nix_option:" + ".".join(keys), "sets", {"conditional": conditional, "line": line} | ({"priority": priority} if priority else {}))

    def package(self, e: Any) -> None:
        name = shown(e)
        if name:
            id_ = f"package:{name}"
            self.nodes.append((id_, "package_ref", name, "nix", {}))
            self.edge(id_, "uses_package", {})
        self.input_reference(e)

    def input_reference(self, e: Any, hops: int = 3, seen: frozenset[str] = frozenset()) -> None:
        if e[0] == "select" and e[1] == ("name", "inputs") and e[2][0]:
            rest = [k for k in e[2][1:] if k is not None]
            meta = {"select": ".".join(rest)} | ({"partial": True} if None in e[2] else {})
            if (self.id, f"flake_input:{e[2][0]}", "references", meta) not in self.edges:
                self.edge(f"flake_input:{e[2][0]}", "references", meta)
        elif e[0] == "select":
            self.input_reference(e[1], hops, seen)
        elif e[0] == "name" and hops and e[1] in self.env and e[1] not in seen:
            self.input_reference(self.env[e[1]], hops - 1, seen | {e[1]})

    def file(self, target: str) -> None:
        self.nodes.append((f"file:{target}", "file", target, "nix", {}))
        self.edge(f"file:{target}", "configures", {})

    def special(self, keys: list[str], value: Any, conditional: bool, line: int) -> bool:
        """home.*, xdg.*, programs.*, specialisation.*, _module.args.*: whether it was one of these."""
        if value is None:
            return False
        attrs = value[1] if value[0] == "attrs" else None
        head = keys[:2]
        if head in (["home", "file"], ["xdg", "configFile"], ["xdg", "dataFile"]):
            if len(keys) == 2 and attrs is not None:
                for b in attrs:
                    if None not in b.keys:
                        self.special(keys + b.keys, b.value, conditional, b.line)
            elif (len(keys) == 3 and attrs is not None and any(b.keys == ["source"] for b in attrs)) or (len(keys) == 4 and keys[3] == "source"):
                self.file(keys[2])
            return True
        if keys == ["home", "packages"] and value[0] == "list":
            for item in value[1]:
                if item[0] in ("select", "literal", "name"):
                    self.package(item)
            return True
        if keys[0] == "specialisation" and len(keys) >= 2:
            child = f"nix_module:{self.path}::specialisation.{keys[1]}"
            self.nodes.append((child, "nix_module", keys[1], "nix", {"line": line}))
            self.edge(child, "specialises", {"line": line})
            return True
        if head == ["_module", "args"] and len(keys) == 3:
            fn = f"nix_function:{self.path}:{keys[2]}"
            self.nodes.append((fn, "nix_function", keys[2], "nix", {"line": line}))
            self.edge(fn, "passes_args", {"line": line})
            return True
        if keys[0] == "programs" and len(keys) == 3 and keys[2] == "package":
            self.package(value)
            return True
        if keys[0] == "programs" and len(keys) == 3 and keys[2] == "extraConfig":
            self.file(f"programs.{keys[1]}")
            return True
        if keys[0] == "programs" and len(keys) == 2 and value == ("literal", True):
            self.set_([*keys, "enable"], conditional, line)
            return True
        if attrs is not None and (len(keys) == 1 and keys[0] in ("home", "xdg", "programs", "specialisation", "_module") or keys == ["_module", "args"] or (keys[0] == "programs" and len(keys) == 2)):
            for b in attrs:
                if None not in b.keys and b.value is not None:
                    self.assign(keys + b.keys, b.value, conditional, b.line)
            return True
        return False

    def assign(self, keys: list[str], value: Any, conditional: bool, line: int) -> None:
        if value is None or not keys or self.special(keys, value, conditional, line):
            return
        name, args = called(value) if value[0] == "apply" else (None, [])
        if name in ("mkForce", "mkDefault"):
            self.set_(keys, conditional, line, name[2:].lower())
        elif name == "mkIf" and len(args) == 2:
            self.set_(keys, True, line)
            if args[1][0] == "attrs":
                self.config(args[1], True, keys)
        elif value[0] == "attrs":
            self.config(value, conditional, keys)
        elif value[0] == "lambda":
            fn = f"nix_function:{self.path}:{keys[-1]}"
            self.nodes.append((fn, "nix_function", keys[-1], "nix", {"line": line, "args": value[1]}))
            self.edge(fn, "declares", {"line": line})
        else:
            self.set_(keys, conditional, line)

    def config(self, e: Any, conditional: bool, prefix: list[str]) -> None:
        name, args = called(e) if e[0] == "apply" else (None, [])
        if name == "mkIf" and len(args) == 2:
            self.config(args[1], True, prefix)
        elif name == "mkMerge" and args and args[0][0] == "list":
            for item in args[0][1]:
                self.config(item, True, prefix)
        elif e[0] in ("let", "with"):
            self.config(e[2], conditional, prefix)
        elif e[0] == "attrs":
            for b in e[1]:
                if b.value is not None and b.value[0] != "inherit" and None not in b.keys:
                    if not prefix and b.keys == ["imports"]:
                        self.imports(b.value, conditional)
                    elif not prefix and b.keys[0] == "options":
                        self.options(b.value, b.keys[1:], b.line)
                    elif not prefix and b.keys == ["config"]:
                        self.config(b.value, conditional, prefix)
                    elif not prefix and b.keys[0] == "config":
                        self.assign(b.keys[1:], b.value, conditional, b.line)
                    else:
                        self.assign(prefix + b.keys, b.value, conditional, b.line)


@register("nix")
def parse(path: str, text: str) -> tuple[list[Node], list[Edge]]:
    tokens, _ = Reader(text).read()
    if not tokens:  # comments only
        return [], []
    module = Module(path)
    module.nodes.append((module.id, "nix_module", path, "nix", {}))
    try:
        root = Parser(tokens).whole()
    except (NixSyntaxError, RecursionError):
        return module.nodes, module.edges
    body = root
    while body[0] in ("lambda", "with", "assert", "let"):
        if body[0] == "let":
            module.env |= {b.keys[0]: b.value for b in body[1] if len(b.keys) == 1 and b.keys[0] and b.value}
        body = body[2]
    if body[0] == "attrs":
        module.config(body, False, [])
        module.bare_imports(root)
    for source, target, kind, _ in list(module.edges):
        if kind == "references":
            name = target.removeprefix("flake_input:")
            module.nodes.append((target, "flake_input", name, "nix", {"synthetic": True}))
    return module.nodes, module.edges


def input_urls(text: str) -> list[str]:
    """``name:url`` of the inputs that a flake's own text gives a literal url, sorted; none if it can't be read."""
    try:
        tokens, _ = Reader(text).read()
        root = Parser(tokens).whole() if tokens else UNKNOWN
    except (NixSyntaxError, RecursionError):
        return []
    found: set[str] = set()

    def visit(keys: list[str | None], value: Any) -> None:
        if value is not None and value[0] == "attrs" and len(keys) < 3:
            for b in value[1]:
                visit(keys + b.keys, b.value)
        elif value is not None and len(keys) in (2, 3) and keys[0] == "inputs" and keys[1] and keys[2:] in ([], ["url"]) and value[0] == "string" and all(isinstance(p, str) for p in value[1]):
            found.add(f"{keys[1]}:{''.join(value[1])}")

    while root[0] in ("lambda", "with", "assert", "let"):
        root = root[2]
    visit([], root)
    return sorted(found)
