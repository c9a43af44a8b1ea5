"""Facts of one file by a table-driven scan: definitions, calls, references, imports, supertypes and complexity.

A single pass cuts the text into words and marks, leaving out comments and strings; a second walks them with a stack of open
blocks. It reads no grammar, so it keeps going on broken source, and unusual layouts are read approximately.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .spec import CONTROL, KEYWORDS, SPECS, Spec

_TOKEN = re.compile(r"[A-Za-z_$@][\w$]*|\d[\w.]*|&&|\|\||=>|->|::|\?\?|\?\.|[^\s\w]|\n")


@dataclass
class Facts:
    definitions: list[tuple] = field(default_factory=list)  # name, kind, line, end_line, signature, exported
    calls: list[tuple] = field(default_factory=list)  # from, to, line
    refs: list[tuple] = field(default_factory=list)  # name, line, col, kind
    imports: list[str] = field(default_factory=list)
    relations: list[tuple] = field(default_factory=list)  # name, extends, implements, line
    functions: list[tuple] = field(default_factory=list)  # name, line, end_line, cyclomatic, cognitive, sloc
    comment_lines: set[int] = field(default_factory=set)
    top_decisions: int = 0
    has_error: bool = False


def blank_out(text: str, spec: Spec) -> tuple[str, set[int]]:
    """The text with comments and the inside of strings as blanks, line breaks kept; and the lines that comments touch."""
    out, comments, i, line = [], set(), 0, 1
    openers = sorted([*spec.line_comment, *([spec.block_comment[0]] if spec.block_comment else [])], key=len, reverse=True)
    while i < len(text):
        opener = next((o for o in openers if text.startswith(o, i)), None)
        if opener:
            block = spec.block_comment and opener == spec.block_comment[0]
            end = text.find(spec.block_comment[1], i + len(opener)) if block else text.find("\n", i)
            end = len(text) if end < 0 else end + (len(spec.block_comment[1]) if block else 0)
            part = text[i:end]
            comments.update(range(line + (part[:1] == "\n"), line + part.count("\n") + 1))
            out.append(re.sub(r"[^\n]", " ", part))
            line += part.count("\n")
            i = end
        elif text[i] in spec.quotes:
            q = text[i] * 3 if spec.blocks == "indent" and text.startswith(text[i] * 3, i) else text[i]
            j = i + len(q)
            while j < len(text) and not text.startswith(q, j):
                if text[j] == "\n" and len(q) == 1 and q != "`":
                    break
                j += 2 if text[j] == "\\" else 1
            j = min(len(text), j + len(q)) if j < len(text) and text[j] != "\n" else min(j, len(text))
            part = text[i:j]
            out.append(q[0] + re.sub(r"[^\n]", " ", part[1:-1]) + (q[0] if len(part) > 1 else ""))
            line += part.count("\n")
            i = j
        else:
            line += text[i] == "\n"
            out.append(text[i])
            i += 1
    return "".join(out), comments


@dataclass
class _Block:
    kind: str  # type, function, nest, plain
    name: str | None = None
    definition: int | None = None
    function: int | None = None
    access: str = "public"


def extract(text: str, language: str) -> Facts:
    spec, facts = SPECS[language], Facts()
    code, facts.comment_lines = blank_out(text, spec)
    for pattern in spec.imports:
        facts.imports += [m.group(1).strip() for m in re.finditer(pattern, _keep_strings(text, facts.comment_lines), re.M)]
    lines = code.split("\n")
    import_lines = {i for i, x in enumerate(lines, 1) if re.match(r"\s*(import\b|from\b.*\bimport\b|use\b|using\b|#\s*include|require|package\b)", x)}
    tokens, line, begin = [], 1, 0
    for m in _TOKEN.finditer(code):
        if m.group() == "\n":
            line, begin = line + 1, m.end()
        else:
            tokens.append((m.group(), line, m.start() - begin + 1))
    if spec.blocks == "indent":
        _indented(tokens, lines, spec, facts, import_lines)
    else:
        _braced(tokens, lines, spec, facts, import_lines)
    facts.definitions = list(dict.fromkeys(facts.definitions))
    return facts


def _keep_strings(text: str, comments: set[int]) -> str:
    return "\n".join("" if i in comments and re.match(r"\s*(//|#(?!\s*include)|/\*|\*)", x) else x for i, x in enumerate(text.split("\n"), 1))


def _exported(spec: Spec, name: str, before: list[str], inside: _Block | None) -> bool:
    words = set(before)
    return {
        "export": "export" in words, "capital": name[:1].isupper(), "pub": "pub" in words, "public": "public" in words, "static": not words & {"static", "private", "protected"},
        "not-private": not words & {"private", "protected", "fileprivate"}, "ruby": True, "underscore": not name.startswith("_") and inside is None, "none": False,
    }[spec.export]


def _braced(tokens: list[tuple], lines: list[str], spec: Spec, facts: Facts, import_lines: set[int]) -> None:
    n, stack, pending = len(tokens), [], None
    owner: list[dict] = []  # functions being measured
    private_from: set[int] = set()
    ruby = spec.blocks == "end"

    def statement(i: int) -> list[str]:
        """The words of the statement before token i."""
        j = i - 1
        while j >= 0 and tokens[j][0] not in ";{}" and (tokens[j][1] == tokens[i][1] or not ruby):
            j -= 1
        return [t[0] for t in tokens[j + 1 : i]]

    def supertypes(i: int) -> tuple[list[str], list[str]]:
        j, mode, out = i + 1, None, {"extends": [], "implements": []}
        depth, part = 0, ""
        built: set[str] = set()
        while j < n and (tokens[j][0] not in "{;" or depth) and not (ruby and tokens[j][1] != tokens[i][1]):
            t = tokens[j][0]
            depth += t in "<([" and not (ruby and t == "<")
            if depth == 0 and t in (spec.extends, spec.implements) and t:
                if mode and part:
                    out[mode].append(part)
                mode, part = ("extends" if t == spec.extends else "implements"), ""
            elif depth == 0 and t == ",":
                if mode and part:
                    out[mode].append(part)
                part = ""
            elif depth == 0 and mode and t not in ("public", "private", "protected", "virtual"):
                part = t if re.match(r"[A-Za-z_$]", t) else part
                if j + 1 < n and tokens[j + 1][0] == "(":
                    built.add(part)
            depth -= t in ">)]" and depth > 0
            j += 1
        if mode and part:
            out[mode].append(part)
        if spec is SPECS["kotlin"]:  # a constructor is called for the superclass only
            return [x for x in out["extends"] if x in built], [x for x in out["extends"] if x not in built]
        if spec is SPECS["swift"]:
            first = 1 if tokens[i - 1][0] == "class" else 0
            return out["extends"][:first], out["extends"][first:]
        return out["extends"], out["implements"]

    def close(i: int, line: int) -> int:
        return close_at(i, line)[0]

    def close_at(i: int, line: int) -> tuple[int, int]:
        """The line and the token where the block that opens after token i ends."""
        depth, j = 0, i
        if ruby:
            openers = {"def", "class", "module", "do", "begin", "case", "if", "unless", "while", "until", "for"}
            while j < n:
                t, at = tokens[j][0], tokens[j][1]
                first = j == 0 or tokens[j - 1][1] != at
                if t in openers and (t in ("def", "class", "module", "do", "begin", "case") or first or tokens[j - 1][0] == "=") and not (j and tokens[j - 1][0] == "."):
                    depth += 1
                elif t == "end":
                    depth -= 1
                    if depth == 0:
                        return at, j
                j += 1
            return tokens[-1][1], n
        parens = 0
        while j < n:
            t = tokens[j][0]
            parens += (t in "([") - (t in ")]")
            if t == "{":
                depth += 1
            elif t == "}":
                depth -= 1
                if depth <= 0:
                    return tokens[j][1], j
            elif depth == 0 and t == ";" and parens <= 0 and j > i:
                return tokens[j][1], j
            j += 1
        facts.has_error = depth > 0 or parens > 0
        return (tokens[-1][1] if tokens else line), n

    def is_function(i: int) -> bool:
        """Whether a function is assigned in the declaration whose name is token i."""
        j = i + 1
        while j < n and tokens[j][0] not in "=;" and j < i + 12:
            j += 1
        if j >= n or tokens[j][0] != "=":
            return False
        j += 1 + (j + 1 < n and tokens[j + 1][0] == "async")
        if j + 1 < n and (tokens[j][0] == "function" or tokens[j + 1][0] == "=>"):
            return True
        if j < n and tokens[j][0] == "(":
            depth = 0
            while j < n:
                depth += (tokens[j][0] == "(") - (tokens[j][0] == ")")
                j += 1
                if depth == 0:
                    break
            return "=>" in [t[0] for t in tokens[j : j + (8 if j < n and tokens[j][0] == ":" else 1)]]
        return False

    def signature(line: int) -> str:
        return re.sub(r"\s+", " ", lines[line - 1].split("{")[0]).strip()[:200]

    i = 0
    while i < n:
        t, line, col = tokens[i]
        nxt = tokens[i + 1][0] if i + 1 < n else ""
        prev = tokens[i - 1][0] if i else ""
        inside = next((b for b in reversed(stack) if b.kind in ("type", "function")), None)
        started = None
        if t in spec.types and re.match(r"[A-Za-z_]", nxt) and nxt not in KEYWORDS and prev not in (".", "::"):
            at = line
            end = close(i, at)
            if end >= at and not (spec.types is SPECS["c"].types and "{" not in [x[0] for x in tokens[i : i + 3]]):
                kind = spec.types[t]
                facts.definitions.append((nxt, kind, at, end, signature(at), _exported(spec, nxt, statement(i), inside)))
                ext, imp = supertypes(i + 1)
                if kind == "class" and (ext or imp):
                    facts.relations.append((nxt, ext, imp, at))
                pending = _Block("type", nxt, access="private" if t == "class" and spec is SPECS["cpp"] else "public")
            i += 2
            if ruby:
                stack.append(pending)
            continue
        if t == "impl" and spec is SPECS["rust"]:
            pending = _Block("type", nxt)
        if t in ("public", "private", "protected") and nxt == ":" and inside is not None:
            inside.access = t
        if t == "type" and spec is SPECS["go"] and i + 2 < n and tokens[i + 2][0] in ("struct", "interface"):
            facts.definitions.append((nxt, "class", line, close(i, line), signature(line), nxt[:1].isupper()))
            pending = _Block("type", nxt)
            i += 3
            continue
        if t in spec.functions:
            j = i + 1
            receiver = spec is SPECS["go"] and nxt == "("
            if receiver:
                while j < n and tokens[j][0] != ")":
                    j += 1
                j += 1
            if ruby and j + 2 < n and tokens[j][0] == "self" and tokens[j + 1][0] == ".":
                j += 2
            word = t if t in ("init", "deinit", "subscript") else tokens[j][0] if j < n else ""
            if word == "*":
                j += 1
                word = tokens[j][0] if j < n else ""
            if re.match(r"[A-Za-z_$]", word) and prev != ".":
                started = (word, "method" if receiver or inside is not None and inside.kind == "type" else "function")
                i = j
        elif spec.headed and re.match(r"[A-Za-z_$~]", t) and nxt == "(" and t not in CONTROL and prev not in (".", "new", "->", "=", "return"):
            j, depth = i + 1, 0
            while j < n:
                depth += (tokens[j][0] == "(") - (tokens[j][0] == ")")
                j += 1
                if depth == 0:
                    break
            k = j
            while k < n and tokens[k][0] not in "{;}=(" and k - j < 12:
                k += 1
            is_class = inside is not None and inside.kind == "type"
            if k < n and tokens[k][0] == "{" and (is_class or spec.export == "static" and not stack) and (k == j or spec.export != "export" or tokens[j][0] == ":"):
                started = (t, "method" if is_class or "::" in prev else "function")
        if started is None and spec.export == "export" and t in ("const", "let", "var") and re.match(r"[A-Za-z_$]", nxt):
            if is_function(i + 1):
                facts.definitions.append((nxt, "function", line, close(i, line), signature(line), _exported(spec, nxt, statement(i), inside)))
                i += 2
                continue
        if started is not None:
            name, kind = started
            end, last = close_at(i - (0 if not ruby else 1), line)
            words = statement(i)
            exported = _exported(spec, name, words, inside)
            if inside is not None and inside.access != "public":
                exported = False
            if ruby:
                exported = not (inside is not None and id(inside) in private_from and "self" not in words)
            facts.definitions.append((name, kind, line, end, signature(line), exported))
            facts.functions.append((name, line, end, 1, 0, 0))
            pending = _Block("function", name, function=len(facts.functions) - 1)
            owner.append({"i": len(facts.functions) - 1, "end": last, "nest": []})
            if ruby:
                stack.append(pending)
            i += 1
            continue
        while owner and i > owner[-1]["end"]:
            owner.pop()
        top = owner[-1] if owner else None
        if ruby and t == "private" and inside is not None and nxt != ":":
            private_from.add(id(inside))
        if t == "{":
            stack.append(pending or _Block("plain"))
            pending = None
        elif t == "}" or ruby and t == "end":
            if stack:
                stack.pop()
            else:
                facts.has_error = True
        elif ruby and t in ("do", "begin", "case") or ruby and t in ("if", "unless", "while", "until", "for") and (i == 0 or tokens[i - 1][1] != line):
            stack.append(_Block("plain"))
        if top is not None:
            top["nest"] = [e for e in top["nest"] if e >= i]
        ternary = t == "?" and nxt not in (".", ":", ")", ",") and spec.export in ("export", "public", "static", "not-private")
        if t in spec.decisions and prev != "." or ternary:
            if top is None:
                facts.top_decisions += 1
            else:
                f = facts.functions[top["i"]]
                depth = len(top["nest"])
                facts.functions[top["i"]] = (*f[:3], f[3] + 1, f[4] + 1 + depth, f[5])
        elif t in spec.logical and top is not None:
            f = facts.functions[top["i"]]
            facts.functions[top["i"]] = (*f[:3], f[3] + 1, f[4] + 1, f[5])
        elif t in spec.jumps and top is not None:
            f = facts.functions[top["i"]]
            facts.functions[top["i"]] = (*f[:3], f[3], f[4] + 1, f[5])
        if t in spec.nesting and top is not None and prev != ".":
            j, depth = i + 1, 0
            while j < n and not (tokens[j][0] in "{;" and depth <= 0) and not ruby:
                depth += (tokens[j][0] == "(") - (tokens[j][0] == ")")
                if depth == 0 and tokens[j][0] == ")":
                    j += 1
                    break
                j += 1
            if ruby or j < n and tokens[j][0] == "{":
                top["nest"].append(close_at(i if ruby else j, line)[1])
        if re.match(r"[A-Za-z_$]", t) and t not in KEYWORDS and line not in import_lines:
            if nxt == "(" and not (prev == "new" and not spec.new_is_call) or ruby and prev == "." and nxt != "=":
                caller = next((b.name for b in reversed(stack) if b.kind == "function"), None)
                facts.calls.append((caller, t, line))
                facts.refs.append((t, line, col, "call"))
            else:
                facts.refs.append((t, line, col, "identifier"))
        i += 1


def _indented(tokens: list[tuple], lines: list[str], spec: Spec, facts: Facts, import_lines: set[int]) -> None:
    """Blocks by indentation, for source that can't be parsed."""
    facts.has_error = True
    opened: list[tuple[int, str, str]] = []  # indent, kind, name
    for k, x in enumerate(lines, 1):
        m = re.match(r"(\s*)(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)", x)
        indent = len(x) - len(x.lstrip())
        if x.strip():
            while opened and indent <= opened[-1][0]:
                opened.pop()
        if m:
            end = next((j - 1 for j in range(k + 1, len(lines) + 1) if lines[j - 1].strip() and len(lines[j - 1]) - len(lines[j - 1].lstrip()) <= len(m[1])), len(lines))
            kind = "class" if m[2] == "class" else "method" if any(o[1] == "class" for o in opened[-1:]) else "function"
            facts.definitions.append((m[3], kind, k, end, x.strip()[:200], not m[1] and not m[3].startswith("_")))
            if kind != "class":
                facts.functions.append((m[3], k, end, 1, 0, 0))
            opened.append((len(m[1]), kind, m[3]))
        caller = next((o[2] for o in reversed(opened) if o[1] != "class"), None)
        for name in re.findall(r"([A-Za-z_]\w*)\s*\(", x):
            if name not in KEYWORDS and k not in import_lines and not (m and name == m[3]):
                facts.calls.append((caller, name, k))
