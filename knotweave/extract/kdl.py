"""KDL files: key bindings, spawned programs and window rules.

Two dialects are read: statements of one line with quoted arguments (``bind "Mod+T"
spawn "term"``, ``rule "float"``), and blocks (``Mod+T { spawn "term"; }``, ``window-rule``).
"""

from __future__ import annotations

import re

from knotweave.extract.registry import Edge, Node, register

_BIND = re.compile(r"^[ \t]*(?P<key>[A-Za-z0-9_+]*\+[A-Za-z0-9_+]+|XF86\w+)[^{\n]*\{(?P<body>[^}]*)\}", re.MULTILINE)
_SPAWN = re.compile(r"^[ \t]*spawn(?:-at-startup)?[ \t]+\"(?P<command>[^\"]+)\"", re.MULTILINE)
_INNER = re.compile(r"\bspawn(?:-at-startup)?\s+\"(?P<command>[^\"]+)\"")
_RULE = re.compile(r"^[ \t]*(?P<rule>window-rule|layer-rule)\b", re.MULTILINE)


_BIND_LINE = re.compile(r"^[ \t]*bind[ \t]+\"(?P<key>[^\"]+)\"[ \t]+spawn[ \t]+\"(?P<command>[^\"]+)\"", re.MULTILINE)
_RULE_LINE = re.compile(r"^[ \t]*rule[ \t]+\"(?P<rule>[^\"]+)\"", re.MULTILINE)


@register("kdl")
def parse(path: str, text: str) -> tuple[list[Node], list[Edge]]:
    root = f"kdl:{path}"
    nodes: list[Node] = [(root, "heading", path, "kdl", {})]
    edges: list[Edge] = []
    line = lambda at: text.count("\n", 0, at) + 1

    def spawn(source: str, command: str, at: int) -> None:
        target = f"kdl_spawn:{path}:{command}"
        nodes.append((target, "kdl_spawn", command, "kdl", {"line": line(at)}))
        edges.append((source, target, "spawns", {}))

    inside: list[tuple[int, int]] = []
    for m in _BIND.finditer(text):
        inside.append(m.span())
        bind = f"kdl_bind:{path}:{m['key']}"
        nodes.append((bind, "kdl_bind", m["key"], "kdl", {"line": line(m.start())}))
        edges.append((root, bind, "binds_key", {}))
        for s in _INNER.finditer(m["body"]):
            spawn(bind, s["command"], m.start())
    for m in _BIND_LINE.finditer(text):
        bind = f"kdl_bind:{path}:{m['key']}"
        nodes.append((bind, "kdl_bind", m["key"], "kdl", {"line": line(m.start()), "command": m["command"]}))
        edges.append((root, bind, "binds_key", {}))
        spawn(bind, m["command"], m.start())
    ruled: dict[str, int] = {}
    for m in _RULE_LINE.finditer(text):
        if ruled.setdefault(m["rule"], m.start()) == m.start():  # a rule's first line counts
            rule = f"kdl_rule:{path}:{m['rule']}"
            nodes.append((rule, "kdl_rule", m["rule"], "kdl", {"line": line(m.start())}))
            edges.append((root, rule, "binds_key", {}))
    spawned = {e[1] for e in edges if e[2] == "spawns"}
    for n, m in enumerate(_RULE.finditer(text)):
        rule = f"kdl_rule:{path}:{m['rule']}-{n}"
        nodes.append((rule, "kdl_rule", m["rule"], "kdl", {"line": line(m.start())}))
        edges.append((root, rule, "binds_key", {}))
    for m in _SPAWN.finditer(text):
        # a program that some key spawns has its edge already
        if not any(a <= m.start() < b for a, b in inside) and f"kdl_spawn:{path}:{m['command']}" not in spawned:
            spawn(root, m["command"], m.start())
    return nodes, edges
