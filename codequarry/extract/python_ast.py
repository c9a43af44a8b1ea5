"""Facts of one Python file from its syntax tree."""

from __future__ import annotations

import ast
import io
import tokenize

from .lexer import Facts

_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case, ast.comprehension)
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Match)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)


def extract(text: str) -> Facts:
    """Raises SyntaxError, ValueError or RecursionError where there is no tree."""
    tree, facts = ast.parse(text), Facts()
    lines = text.split("\n")
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type == tokenize.COMMENT:
            facts.comment_lines.add(t.start[0])

    def visit(node: ast.AST, caller: str | None, parent: ast.AST | None, in_import: bool = False) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            kind = "class" if is_class else "method" if isinstance(parent, ast.ClassDef) else "function"
            head = " ".join(" ".join(lines[node.lineno - 1 : node.body[0].lineno - 1] or [lines[node.lineno - 1]]).split()).rstrip(":")[:200]
            facts.definitions.append((node.name, kind, node.lineno, node.end_lineno, head, isinstance(parent, ast.Module) and not node.name.startswith("_")))
            if is_class:
                bases = [b.attr if isinstance(b, ast.Attribute) else b.id for b in node.bases if isinstance(b, (ast.Attribute, ast.Name))]
                if bases:
                    facts.relations.append((node.name, bases, [], node.lineno))
            else:
                cyc, cog = _complexity(node)
                sloc = sum(1 for k in range(node.lineno, node.end_lineno + 1) if lines[k - 1].strip() and k not in facts.comment_lines)
                facts.functions.append((node.name, node.lineno, node.end_lineno, cyc, cog, sloc))
                caller = node.name
        elif isinstance(node, ast.ImportFrom):
            facts.imports.append("." * node.level + (node.module or ""))
            return
        elif isinstance(node, ast.Import):
            facts.imports += [a.name for a in node.names]
            return
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                col = (f.col_offset if isinstance(f, ast.Name) else f.end_col_offset - len(name)) + 1
                facts.calls.append((caller, name, node.lineno))
                facts.refs.append((name, node.lineno, col, "call"))
        elif isinstance(node, ast.Name) and not (isinstance(parent, ast.Call) and parent.func is node):
            facts.refs.append((node.id, node.lineno, node.col_offset + 1, "identifier"))
        for child in ast.iter_child_nodes(node):
            visit(child, caller, node)

    visit(tree, None, None)
    facts.top_decisions = _decisions(tree)
    return facts


def _children(node: ast.AST):
    return (c for c in ast.iter_child_nodes(node) if not isinstance(c, (*_FUNCTIONS, ast.ClassDef)))


def _complexity(function: ast.AST) -> tuple[int, int]:
    """Cyclomatic and cognitive complexity; functions within are measured on their own. ``elif`` is a decision and adds no depth."""
    cyc, cog = 1, 0

    def walk(node: ast.AST, depth: int) -> None:
        nonlocal cyc, cog
        for c in _children(node):
            deeper = depth
            chained = isinstance(node, ast.If) and isinstance(c, ast.If) and node.orelse == [c]
            if isinstance(c, _DECISIONS):
                cyc += 1
                cog += 1 + (depth - 1 if chained and depth else depth)
            if isinstance(c, ast.BoolOp):
                cyc += len(c.values) - 1
                cog += len(c.values) - 1
            if isinstance(c, (ast.Break, ast.Continue)):
                cog += 1
            if isinstance(c, _NESTING):
                deeper = depth if chained else depth + 1
            walk(c, deeper)

    walk(function, 0)
    return cyc, cog


def _decisions(node: ast.AST) -> int:
    return sum(isinstance(c, _DECISIONS) + _decisions(c) for c in ast.iter_child_nodes(node) if not isinstance(c, _FUNCTIONS))
