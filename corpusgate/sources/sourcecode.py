"""Functions and methods of one source file: place, code, leading comment, complexity and parameters.

Python files are read with the standard ``ast``; Go, TypeScript and JavaScript files by masking
strings and comments, so that plain patterns and brace pairs find the declarations. What cannot
be parsed gives what was found up to there, never an error.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from typing import NamedTuple

LANGUAGES = {".go": "go", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript"}


class Symbol(NamedTuple):
    name: str
    kind: str
    owner: str | None
    bases: tuple[str, ...]
    line: int
    end_line: int
    code: str
    doc: str
    complexity: int = 0
    params: tuple[str, ...] = ()
    param_count: int = 0
    nil_guards: int = 0


def language_of(path: str | None) -> str | None:
    dot = (path or "").rfind(".")
    return LANGUAGES.get(path[dot:].lower()) if dot >= 0 else None


def symbols_of(path: str | None, content: str | None) -> list[Symbol]:
    """Every named function and method of a file of the known languages, also nested ones, in line order."""
    language = language_of(path)
    if language is None or not content:
        return []
    text = content.removeprefix("﻿")
    if language == "python":
        return _python(text)
    at = _Places(text, *_masked(text, language))
    return (_go if language == "go" else _script)(at)


class Class(NamedTuple):
    """A class, struct or interface; ``sources`` has, beside each base, the module that it is imported from, '' for none."""

    name: str
    bases: tuple[str, ...]
    sources: tuple[str, ...]
    line: int


def symbols_and_hierarchy(path: str | None, content: str | None) -> tuple[list[Symbol], list[Class], list[Symbol]]:
    """The symbols of ``symbols_of`` without their measures, the classes of the file, and members without a body as symbols without code."""
    language = language_of(path)
    if language is None or not content:
        return [], [], []
    text = content.removeprefix("﻿")
    if language == "python":
        classes: list[Class] = []
        return _python(text, classes, False), classes, []
    at = _Places(text, *_masked(text, language))
    if language == "go":
        return _go(at, False), *_go_hierarchy(at)
    return _script(at, False), *_script_hierarchy(at)


# Python


def _statements(node: ast.AST) -> list[ast.AST]:
    """The statements, handlers and cases right below ``node``."""
    out = []
    for name in ("body", "handlers", "orelse", "finalbody", "cases"):
        below = getattr(node, name, None)
        if isinstance(below, list):
            out += below
    return out


def _python_class(node: ast.ClassDef, imports: dict[str, tuple[str, str]]) -> Class:
    bases, sources = [], []
    for b in node.bases:
        b = b.value if isinstance(b, ast.Subscript) else b
        source, name = imports.get(b.id, ("", b.id)) if isinstance(b, ast.Name) else ("", getattr(b, "attr", ""))
        bases.append(name)
        sources.append(source)
    return Class(node.name, tuple(bases), tuple(sources), node.lineno)


def _python(text: str, classes: list[Class] | None = None, measures: bool = True) -> list[Symbol]:
    # ``\f`` and the like do not end a line here, as in the line numbers of ``ast``.
    try:
        tree = ast.parse(text.replace("\r\n", "\n"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_lines(text, classes)
    lines = text.replace("\r\n", "\n").split("\n")
    out, todo, imports, found = [], [(tree, None, ())], {}, []
    while todo:
        node, owner, bases = todo.pop()
        for child in _statements(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                code = "\n".join(lines[child.lineno - 1 : child.end_lineno])
                facts = (_python_complexity(child), params := _python_params(child), len(params)) if measures else ()
                out.append(Symbol(child.name, "method" if owner else "function", owner, bases, child.lineno, child.end_lineno, code, ast.get_docstring(child) or "", *facts))
                todo.append((child, None, ()))
            elif isinstance(child, ast.ClassDef):
                found.append(child)
                todo.append((child, child.name, tuple(b.attr if isinstance(b, ast.Attribute) else getattr(b, "id", "") for b in child.bases)))
            elif isinstance(child, ast.ImportFrom):
                imports |= {a.asname or a.name: ("." * child.level + (child.module or ""), a.name) for a in child.names}
            else:
                todo.append((child, owner, bases))
    if classes is not None:
        classes += [_python_class(c, imports) for c in found]
    return sorted(out, key=lambda s: s.line)


_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler)


def _python_complexity(node: ast.FunctionDef | ast.AsyncFunctionDef) -> int:
    """1 and one for each branch, loop, handler, match case and further operand of a boolean; nested functions count too."""
    n = 1
    for part in (x for statement in node.body for x in ast.walk(statement)):
        if isinstance(part, _BRANCHES):
            n += 1
        elif isinstance(part, ast.Match):
            n += len(part.cases)
        elif isinstance(part, ast.BoolOp):
            n += len(part.values) - 1
    return n


def _python_params(node: ast.FunctionDef | ast.AsyncFunctionDef) -> tuple[str, ...]:
    a = node.args
    return tuple(x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg] if x)


_DEF = re.compile(r"(?m)^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*(?:\[[^\]]*\])?\(")
_DOCSTRING = re.compile(r'[ \t\r\n]*(?:#[^\n]*\n[ \t\r\n]*)*([rRuU]?)("""|\'\'\'|"|\')')


_PYTHON_CLASS = re.compile(r"(?m)^([ \t]*)class[ \t]+(\w+)[ \t]*(?:\[[^\]]*\])?(?:\(([^()]*)\))?[ \t]*:")
_PYTHON_FROM = re.compile(r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+(?:\(([^)]*)\)|([^\n(]+))")


def _python_lines(text: str, classes: list[Class] | None = None) -> list[Symbol]:
    """Definitions by line, for a file that does not parse; strings are masked first. A method belongs to the class above it that is indented less."""
    masked, _ = _masked(text, "python")
    imports = {}
    for m in _PYTHON_FROM.finditer(masked):
        for names in (m.group(2) or m.group(3)).split(","):
            if words := names.split():
                imports[words[-1]] = (m.group(1), words[0])
    found = [(m.start(), m.group(1), m.group(2), [imports.get(b, ("", b.split(".")[-1])) for b in (x.strip() for x in (m.group(3) or "").split(",")) if b and "=" not in b]) for m in _PYTHON_CLASS.finditer(masked)]
    if classes is not None:
        classes += [Class(name, tuple(b for _, b in bases), tuple(x for x, _ in bases), text.count("\n", 0, at) + 1) for at, _, name, bases in found]
    out, k, above = [], 0, []
    for m in _DEF.finditer(masked):
        while k < len(found) and found[k][0] < m.start():
            above = [c for c in above if len(c[1]) < len(found[k][1])] + [found[k]]
            k += 1
        above = [c for c in above if len(c[1]) < len(m.group(1))]
        i, depth = m.end(), 1
        while i < len(masked) and depth:
            depth += masked[i] in "([{"
            depth -= masked[i] in ")]}"
            i += 1
        colon = re.compile(r"[^\n:]*:").match(masked, i)
        if not colon:
            continue
        doc, rest = "", _DOCSTRING.match(text, colon.end())
        if rest:
            close = text.find(rest.group(2), rest.end())
            doc = text[rest.end() : close] if close >= 0 else ""
        line = text.count("\n", 0, m.start()) + 1
        deeper = re.compile(rf"(?m)^(?![ \t]*$)(?!{m.group(1)}[ \t])")
        stop = deeper.search(masked, masked.find("\n", colon.end()) + 1 or len(masked))
        end = stop.start() if stop else len(text)
        code = text[m.start() : end].rstrip()
        owner, bases = (above[-1][2], tuple(b for _, b in above[-1][3])) if above else (None, ())
        out.append(Symbol(m.group(2), "method" if m.group(1) else "function", owner, bases, line, line + code.count("\n"), code, doc))
    return out


# Go, TypeScript, JavaScript

_TOKEN = {
    "go": re.compile(r"(//[^\n]*|/\*.*?(?:\*/|\Z))|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'", re.S),
    "script": re.compile(
        r"(//[^\n]*|/\*.*?(?:\*/|\Z))|`(?:\\.|\$\{[^{}`]*\}|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
        r"|(?<=[=(,:\[!&|?;{}])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*",
        re.S,
    ),
    "python": re.compile(r"(#[^\n]*)|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
}
_INK = re.compile(r"[^\n]")


class Comment(NamedTuple):
    start: int
    end: int


def _masked(text: str, language: str) -> tuple[str, list[Comment]]:
    """The text with strings and comments blanked at equal length, and the comments' places."""
    out, last, comments = [], 0, []
    for m in _TOKEN.get(language, _TOKEN["script"]).finditer(text):
        out += [text[last : m.start()], _INK.sub(" ", m.group())]
        last = m.end()
        if m.group(1) is not None:
            comments.append(Comment(m.start(), m.end()))
    return "".join([*out, text[last:]]), comments


class _Places:
    """Line numbers, brace pairs and leading comments of one file."""

    def __init__(self, text: str, masked: str, comments: list[Comment]) -> None:
        self.text, self.masked, self.comments = text, masked, comments
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.comment_ends = [c.end for c in comments]
        self.close: dict[int, int] = {}
        self.at: list[int] = []
        self.inner: list[int] = []
        stack: list[int] = []
        for m in re.finditer("[{}]", masked):
            if m.group() == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()
            self.at.append(m.start())
            self.inner.append(stack[-1] if stack else -1)

    def line(self, place: int) -> int:
        return bisect_right(self.breaks, place - 1) + 1

    def open_brace(self, place: int) -> int:
        """Place of the innermost brace that is open at ``place``; -1 if there is none."""
        i = bisect_right(self.at, place - 1) - 1
        return self.inner[i] if i >= 0 else -1

    def closing(self, masked_open: int, opening: str, closing: str) -> int:
        depth = 0
        for m in re.compile(f"[{re.escape(opening + closing)}]").finditer(self.masked, masked_open):
            depth += 1 if m.group() == opening else -1
            if not depth:
                return m.start()
        return -1

    def attached(self, start: int, breaks: int) -> str:
        """The comments above ``start`` with at most ``breaks`` line breaks in each gap; none that follows code on its line."""
        out, expected = [], start
        i = bisect_right(self.comment_ends, start) - 1
        while i >= 0:
            c = self.comments[i]
            gap = self.text[c.end : expected]
            if gap.strip() or gap.count("\n") > breaks:
                break
            head = self.text.rfind("\n", 0, c.start) + 1
            if self.masked[head : c.start].strip("﻿ \t\r"):
                break
            out.append(self.text[c.start : c.end])
            expected = c.start
            i -= 1
        return "\n".join(reversed(out))

    def body(self, after: int) -> int:
        """End of the declaration whose signature ends before ``after``: its brace pair, or its line."""
        m = re.compile(r"[^{;\n]*(\{)").match(self.masked, after)
        while m and re.search(r"\b(?:interface|struct)\s*$", self.masked[: m.start(1)][-20:]) and m.start(1) in self.close:
            m = re.compile(r"[^{;\n]*(\{)").match(self.masked, self.close[m.start(1)] + 1)
        if m and m.start(1) in self.close:
            return self.close[m.start(1)] + 1
        stop = self.text.find("\n", after)
        return len(self.text) if stop < 0 else stop


_GO_FUNC = re.compile(r"(?m)^func[ \t]*(?:\(([^()]*)\)[ \t]*)?([^\W\d]\w*)[ \t]*(\[[^\]]*\][ \t]*)?\(")


def _go(at: _Places, measures: bool = True) -> list[Symbol]:
    text, masked, out = at.text, at.masked, []
    for m in _GO_FUNC.finditer(masked):
        if at.open_brace(m.start()) >= 0:
            continue
        params_end = at.closing(m.end() - 1, "(", ")")
        after = params_end + 1 if params_end > 0 else m.end()
        # A result list may hold function types, but no brace of the body stands before it.
        end = at.body(after)
        owner = re.sub(r"\[.*|[*\s]", "", m.group(1).split()[-1]) if (m.group(1) or "").strip() else None
        complexity, guards = _go_complexity(masked[after:end]) if measures else (0, 0)
        names = _go_params(masked[m.end() : params_end]) if measures and params_end > 0 else 0
        kind = "method" if m.group(1) is not None else "function"
        place = (at.line(m.start()), at.line(max(m.start(), end - 1)))
        out.append(Symbol(m.group(2), kind, owner, (), *place, text[m.start() : end], at.attached(m.start(), 1), complexity, (), names, guards))
    return out


_GO_TYPE = re.compile(r"(?m)^[ \t]*(?:type[ \t]+)?([^\W\d]\w*)[ \t]*(?:\[[^\]\n]*\][ \t]*)?(struct|interface)[ \t]*(\{)")
_GO_EMBEDDED = re.compile(r"[ \t]*\*?(?:\w+\.)?([^\W\d]\w*)(?:\[[^\n]*\])?\s*")
_GO_MEMBER = re.compile(r"[ \t]*([^\W\d]\w*)[ \t]*\(")


def _go_hierarchy(at: _Places) -> tuple[list[Class], list[Symbol]]:
    """Types with what they embed, and the methods of interfaces."""
    masked, classes, members = at.masked, [], []
    for t in _GO_TYPE.finditer(masked):
        opened = t.start(3)
        if at.open_brace(t.start(1)) >= 0 or opened not in at.close:
            continue
        bases, place = [], opened + 1
        for line in re.split(r"[\n;]", masked[opened + 1 : at.close[opened]]):
            if at.open_brace(place) == opened:
                if m := _GO_EMBEDDED.fullmatch(line):
                    bases.append(m.group(1))
                elif t.group(2) == "interface" and (m := _GO_MEMBER.match(line)):
                    start = place + m.start(1)
                    members.append(Symbol(m.group(1), "member", t.group(1), (), at.line(start), at.line(start), "", at.attached(start, 1)))
            place += len(line) + 1
        classes.append(Class(t.group(1), tuple(bases), ("",) * len(bases), at.line(t.start(1))))
    return classes, members


def _top_level(text: str, cut: str) -> list[str]:
    """Pieces between the characters of ``cut`` that stand outside of all brackets; blank ones left out."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c in cut and depth == 0:
            out.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*out, text[last:]] if p.strip()]


def _go_params(text: str) -> int:
    """Parameter names of a list like ``a, b int, c string``; a list of types alone counts its types."""
    return len(_top_level(text, ","))


_GO_BRANCH = re.compile(r"\b(if|for|case)\b|&&|\|\|")
_GO_LITERAL = re.compile(r"\bfunc\s*\(")
_NESTED = re.compile(r"\b(?:if|for|switch|select)\b")
_GUARD = re.compile(r"^(?:(\w+)\s*[!=]=\s*nil|nil\s*[!=]=\s*(\w+))$")


def _go_complexity(body: str) -> tuple[int, int]:
    """Complexity of a function's masked body, and how often its most repeated plain nil guard occurs (0 if none repeats)."""
    opened = body.find("{")
    if opened < 0:
        return 0, 0
    braces, stack = {}, []
    for m in re.finditer("[{}]", body):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            braces[stack.pop()] = m.start()
    literals = []
    for m in _GO_LITERAL.finditer(body):
        depth, i = 1, m.end()
        while i < len(body) and depth:
            depth += (body[i] == "(") - (body[i] == ")")
            i += 1
        brace = body.find("{", i)
        if brace in braces:
            literals.append((m.start(), braces[brace]))
    n, checked, guards = 1, set(), {}
    for m in _GO_BRANCH.finditer(body, opened):
        counted = not any(a < m.start() < b for a, b in literals)
        if m.group(1) != "if":
            n += counted
            continue
        brace = body.find("{", m.end())
        if brace not in braces:
            n += counted
            continue
        condition = body[m.end() : brace].rsplit(";", 1)[-1].strip()
        inside = body[brace + 1 : braces[brace]]
        behind = re.compile(r"\s*else\b\s*(if\b)?").match(body, braces[brace] + 1)
        guard = _GUARD.match(condition)
        plain = guard is not None and behind is None and not _NESTED.search(inside)
        name = (guard.group(1) or guard.group(2)) if plain else None
        if plain:
            guards[name] = guards.get(name, 0) + 1
        if counted:
            if plain and condition.replace(" ", "") == "err!=nil" and _returns_err(inside):
                pass
            elif plain and name not in checked:
                checked.add(name)
            else:
                n += 1
            n += behind is not None and behind.group(1) is None
    repeated = max((g for g in guards.values() if g > 1), default=0)
    return n, repeated


def _returns_err(block: str) -> bool:
    """One to three statements: a return that mentions err, and calls without control flow."""
    statements = _top_level(block, "\n;")
    returns = [s for s in statements if re.match(r"return\b", s)]
    rest = [s for s in statements if s not in returns[:1]]
    calls = all(re.match(r"[\w.\[\]]+\(.*\)$", s, re.S) and "func(" not in s for s in rest)
    return 1 <= len(statements) <= 3 and bool(returns) and bool(re.search(r"\berr\b", returns[0][6:])) and calls


_ID = r"[^\W\d][\w$]*|\$[\w$]*"
_FUNCTION = re.compile(rf"(?<![\w$.])(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function\b\s*\*?\s*({_ID})\s*(?:<[^>(]*>)?\s*(\()")
_VARIABLE = re.compile(
    rf"(?<![\w$.])(?:export[ \t]+)?(?:const|let|var)\s+({_ID})\s*(?::[^=;\n]+)?=\s*(?:async\b\s*)?"
    rf"(?:function\b\s*\*?\s*(?:{_ID})?\s*(?:<[^>(]*>)?\s*(\()|(?:<[^>(]*>\s*)?(\()|({_ID})\s*=>)"
)
_ARROW = re.compile(r"\s*(?::(?:[^={;]|=(?!>)|\{[^{}]*\})+?)?\s*=>")
_CLASS = re.compile(rf"(?<![\w$.])class\s+({_ID})(?:\s*<[^{{]*?>)?(?:\s+extends\s+([\w$.]+)[^{{]*?)?(?:\s+implements\s+([^{{]+?))?\s*(\{{)")
_METHOD = re.compile(rf"(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set|declare|accessor)\s+)*\*?\s*(#?(?:{_ID}))\s*\??\s*(?:<[^>({{]*>)?\s*(\()")
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "function", "super", "await", "typeof", "new", "do", "else", "with", "throw", "yield", "import"}


def _script(at: _Places, measures: bool = True) -> list[Symbol]:
    text, masked, out = at.text, at.masked, []

    def add(name: str, kind: str, owner: str | None, bases: tuple[str, ...], start: int, end: int, params: str, body: int) -> None:
        facts = ()
        if measures:
            names = tuple(re.match(r"[.\s]*(?:(?:public|private|protected|readonly)\s+)*([\w$]*)", p).group(1) for p in _top_level(params, ","))
            facts = (_script_complexity(masked[body:end]), names, len(names))
        out.append(Symbol(name, kind, owner, bases, at.line(start), at.line(max(start, end - 1)), text[start:end], at.attached(start, 1), *facts))

    for m in _FUNCTION.finditer(masked):
        close = at.closing(m.start(2), "(", ")")
        add(m.group(1), "function", None, (), m.start(), at.body(close + 1 if close > 0 else m.end()), masked[m.end() : max(close, m.end())], max(close, m.end()))
    for m in _VARIABLE.finditer(masked):
        after, params = m.end(), m.group(4) or ""
        if not m.group(4):
            group = 2 if m.group(2) else 3
            close = at.closing(m.start(group), "(", ")")
            after, params = close + 1, masked[m.end() : max(close, m.end())]
            if close < 0 or (group == 3 and not (arrow := _ARROW.match(masked, after))):
                continue
            if group == 3:
                after = arrow.end()
        add(m.group(1), "function", None, (), m.start(), at.body(after), params, after)
    for c in _CLASS.finditer(masked):
        opened = c.start(4)
        closed = at.close.get(opened, len(masked))
        bases = tuple(x.split(".")[-1] for x in [c.group(2) or "", *[re.sub(r"<.*", "", b).strip() for b in (c.group(3) or "").split(",")]] if x)
        # Members begin behind the class's brace, a member's closing brace or a semicolon.
        place = opened + 1
        while place < closed:
            while place < closed and (masked[place].isspace() or masked[place] == ";"):
                place += 1
            m = _METHOD.match(masked, place, closed)
            if m and m.group(1) not in _NOT_NAMES:
                close = at.closing(m.start(2), "(", ")")
                end = at.body(close + 1) if close > 0 else closed
                if close > 0 and re.compile(r"[^;{]*\{").match(masked, close + 1, closed):
                    named = c.group(1) if m.group(1) == "constructor" else m.group(1)
                    add(named, "method", c.group(1), bases, place, end, masked[m.end() : close], close)
                place = max(end, place + 1)
                continue
            # Some other member, or a decorator's line: go behind it.
            stop = re.compile(r"[{;\n]").search(masked, place, closed)
            if not stop:
                break
            place = at.close.get(stop.start(), stop.start()) + 1
    seen, once = set(), []
    for s in sorted(out, key=lambda s: (s.line, s.kind == "function")):
        if (s.name, s.line) not in seen:
            seen.add((s.name, s.line))
            once.append(s)
    return once


_INTERFACE = re.compile(rf"(?<![\w$.])interface\s+({_ID})(?:\s*<[^{{]*?>)?(?:\s+extends\s+([^{{]+?))?\s*(\{{)")
_CALLED = re.compile(rf"(?:(?:public|protected|readonly|abstract|static|declare)\s+)*({_ID})\s*[?!]?\s*:\s*(?:<[^>({{]*>\s*)?(\()")
_IMPORT = re.compile(rf"import\s+(?:type\s+)?(?:({_ID})\s*,?\s*)?(?:\{{([^}}]*)\}})?\s*from\s*['\"]([^'\"\n]+)['\"]")


def _bare_types(listed: str | None) -> list[str]:
    """The types of a list, without their arguments."""
    text, last = listed or "", None
    while text != last:
        last, text = text, re.sub(r"<[^<>]*>", "", text)
    return [t.strip() for t in text.split(",")]


def _script_hierarchy(at: _Places) -> tuple[list[Class], list[Symbol]]:
    """Classes and interfaces with their bases, and their members without a body."""
    text, masked = at.text, at.masked
    imports: dict[str, tuple[str, str]] = {}
    for m in _IMPORT.finditer(text):
        if masked[m.start()] == " ":
            continue
        if m.group(1):
            imports[m.group(1)] = (m.group(3), m.group(1))
        for part in (m.group(2) or "").split(","):
            names = re.sub(r"^\s*type\s+", "", part).split()
            if names:
                imports[names[-1]] = (m.group(3), names[0])
    classes, members = [], []
    found = [(c.start(), c.group(1), [c.group(2) or "", *_bare_types(c.group(3))], c.start(4)) for c in _CLASS.finditer(masked)]
    found += [(c.start(), c.group(1), _bare_types(c.group(2)), c.start(3)) for c in _INTERFACE.finditer(masked)]
    for start, name, listed, opened in sorted(found):
        resolved = [imports.get(b, ("", b.split(".")[-1])) for b in (x.strip() for x in listed) if b]
        classes.append(Class(name, tuple(b for _, b in resolved), tuple(s for s, _ in resolved), at.line(start)))
        place, closed = opened + 1, at.close.get(opened, len(masked))
        while place < closed:
            while place < closed and (masked[place].isspace() or masked[place] in ";,"):
                place += 1
            m = _METHOD.match(masked, place, closed) or _CALLED.match(masked, place, closed)
            after = place
            if m and m.group(1) not in _NOT_NAMES and (close := at.closing(m.start(2), "(", ")")) > 0:
                after = close + 1
                if m.re is _CALLED and not _ARROW.match(masked, after):
                    m = None
                elif not re.compile(r"[^;{\n]*\{").match(masked, after, closed) or masked[start : start + 9] == "interface":
                    members.append(Symbol(m.group(1), "member", name, (), at.line(place), at.line(place), "", at.attached(place, 1)))
            # Behind the member: its line or semicolon, or its braces.
            stop = re.compile(r"[{;\n]").search(masked, after, closed)
            if not stop:
                break
            place = at.close.get(stop.start(), stop.start()) + 1
    return classes, members


_SCRIPT_BRANCH = re.compile(r"\b(?:if|for|catch|case|do)\b(?!\s*:)|(?<!\}) ?\bwhile\b|&&|\|\||(?<![?.\w)\]])\?(?![?.:])|(?<=[\w)\]\s])\?(?=\s)")


def _script_complexity(body: str) -> int:
    """1 and one for each branch, loop, handler, case, conditional and short-circuit operator; nested functions count too."""
    return 1 + len(_SCRIPT_BRANCH.findall(body))
