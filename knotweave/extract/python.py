"""Python files by the standard library's ast: functions, classes, imports, calls within the file."""

from __future__ import annotations

import ast

from knotweave.extract.registry import Edge, Node, register


def _arguments(a: ast.arguments) -> list[str]:
    """Positional, positional-only, keyword-only, then * and **."""
    names = [x.arg for x in (*a.args, *a.posonlyargs, *a.kwonlyargs)]
    return names + [f"{stars}{x.arg}" for stars, x in (("*", a.vararg), ("**", a.kwarg)) if x]


def _dotted(node: ast.expr) -> str | None:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _decorator(node: ast.expr) -> str | None:
    """The last name of a decorator, called or not: ``tool`` for ``@server.tool()``."""
    if isinstance(node, ast.Call):
        node = node.func
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else None


def registered_tools(text: str) -> list[str]:
    """Names of the functions that a ``@x.tool()`` decorator registers, in the order of the source."""
    found = [n for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    is_tool = lambda d: isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr == "tool"
    return [n.name for n in sorted(found, key=lambda n: n.lineno) if any(map(is_tool, n.decorator_list))]


@register("python")
def parse(path: str, text: str) -> tuple[list[Node], list[Edge]]:
    module = f"python:{path}"
    nodes: list[Node] = [(module, "python_module", path, "python", {})]
    edges: list[Edge] = []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return nodes, edges
    own: dict[str, str] = {}
    for n in ast.walk(tree):
        doc = (ast.get_docstring(n) or "").split("\n")[0] if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else ""
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            id_ = f"py_func:{path}:{n.name}"
            meta = {"line": n.lineno, "args": _arguments(n.args), "decorators": [x for x in map(_decorator, n.decorator_list) if x], "doc": doc}
            nodes.append((id_, "py_function", n.name, "python", meta))
        elif isinstance(n, ast.ClassDef):
            id_ = f"py_class:{path}:{n.name}"
            nodes.append((id_, "py_class", n.name, "python", {"line": n.lineno, "bases": [x for x in map(_dotted, n.bases) if x], "doc": doc}))
        else:
            continue
        own[n.name] = id_
        edges.append((module, id_, "declares", {"line": n.lineno}))
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            found = [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.module:
            found = [n.module]
        else:
            found = []
        for name in found:
            nodes.append((f"py_module:{name}", "python_module", name, "python", {"synthetic": True}))
            edges.append((module, f"py_module:{name}", "python_imports", {"line": n.lineno}))
        if isinstance(n, ast.Call) and (called := _dotted(n.func)) in own:
            edges.append((module, own[called], "calls", {"line": n.lineno}))
    return nodes, edges
