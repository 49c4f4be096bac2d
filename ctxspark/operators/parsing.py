"""Symbols and relationships of source files, by language.

Each parser is a plain function source, path -> Parsed; `parse_files` runs them over a table of files in
one Arrow pass and leaves identifiers to column expressions. Python is read with `ast`; PHP, C#, SQL, .NET
projects and ASP pages by walking tokens; TypeScript with a scanner that blanks comments and strings
(keeping positions) and matches braces. Unknown languages give an empty result with an error, none raises.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .tokens import Tokens, tags

SYMBOL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "qualified_name", "symbol_type")]
    + [T.StructField(n, T.IntegerType()) for n in ("line_start", "line_end")]
    + [T.StructField(n, T.StringType()) for n in ("visibility", "docstring", "parent_name", "detail")]
)
RELATIONSHIP = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_line", T.IntegerType()), T.StructField("target_name", T.StringType()), T.StructField("relationship_type", T.StringType()), T.StructField("confidence", T.DoubleType())])

# Relation methods of models, and hooks of data queries.
MODEL_RELATIONS = {"hasOne": "has_one", "hasMany": "has_many", "belongsTo": "belongs_to", "belongsToMany": "belongs_to_many", "hasOneThrough": "has_one_through", "hasManyThrough": "has_many_through", "morphOne": "morph_one", "morphMany": "morph_many"}
QUERY_HOOKS, MUTATION_HOOKS = ("useQuery", "useInfiniteQuery", "useSuspenseQuery"), ("useMutation",)
# Role of a PHP class by a part of its parent's or the end of its own name, in this order.
CLASS_ROLES = [("Controller", "controller"), ("Request", "request"), ("Resource", "resource"), ("Policy", "policy"), ("Middleware", "middleware"), ("Event", "event"), ("Listener", "listener"), ("Job", "job"), ("Command", "command"), ("Notification", "notification"), ("Observer", "observer"), ("Rule", "rule"), ("ServiceProvider", "provider"), ("Seeder", "seeder"), ("Factory", "factory")]


@dataclass
class Parsed:
    symbols: list[dict] = field(default_factory=list)
    relationships: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def symbol(self, name, kind, start, end=None, qualified=None, visibility=None, docstring=None, parent=None, detail=None) -> dict:
        row = {"name": name, "qualified_name": qualified or name, "symbol_type": kind, "line_start": start, "line_end": end or start, "visibility": visibility, "docstring": docstring, "parent_name": parent, "detail": detail}
        self.symbols.append(row)
        return row

    def relate(self, source: dict | None, target: str, kind: str, confidence: float = 1.0) -> None:
        target = target.strip()
        if target:
            self.relationships.append({"source": source["qualified_name"] if source else None, "source_line": source["line_start"] if source else None, "target_name": target, "relationship_type": kind, "confidence": confidence})


class Lines:
    """Line numbers of positions."""

    def __init__(self, source: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", source)]

    def __call__(self, pos: int) -> int:
        return bisect_right(self.starts, pos)


_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def blanked(source: str) -> str:
    """The source with comments and the insides of strings as spaces; positions and lines stay."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] in "/#" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1], source)


def block_end(code: str, start: int, pair: str = "{}") -> int:
    """Position after the bracket that closes the one at or after start; the end of the code without one."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(code, start):
        depth += 1 if m[0] == pair[0] else -1
        if depth <= 0:
            return m.end()
    return len(code)


# ---------------------------------------------------------------- Python

def parse_python(source: str, path: str) -> Parsed:
    out = Parsed()
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        out.errors.append(str(e))
        lines = Lines(source)
        for m in re.finditer(r"(?m)^[ \t]*class[ \t]+(\w+)", source):
            out.symbol(m[1], "class", lines(m.start()))
        for m in re.finditer(r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", source):
            out.symbol(m[1], "function", lines(m.start()))
        return out

    def first_line(node) -> int:
        return min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])

    def walk(body, owner: str, parent: str | None):
        for node in body:
            if isinstance(node, ast.ClassDef):
                name = f"{owner}.{node.name}" if owner else node.name
                own = out.symbol(node.name, "class", first_line(node), node.end_lineno, name, docstring=ast.get_docstring(node), parent=parent)
                for base in node.bases:
                    out.relate(own, ast.unparse(base), "extends")
                walk(node.body, name, node.name)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "function" if parent is None else "constructor" if node.name == "__init__" else "method"
                out.symbol(node.name, kind, first_line(node), node.end_lineno, f"{owner}.{node.name}" if owner else node.name, "private" if node.name.startswith("_") and not node.name.startswith("__") else "public", ast.get_docstring(node), parent)
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                out.relate(None, ast.unparse(node), "imports")
            elif type(node).__name__ == "TypeAlias":
                out.symbol(node.name.id, "type_alias", node.lineno, node.end_lineno)
            elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) and ast.unparse(node.annotation).split(".")[-1] == "TypeAlias":
                out.symbol(node.target.id, "type_alias", node.lineno, node.end_lineno)
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9_]+", target.id):
                        out.symbol(target.id, "constant", node.lineno, node.end_lineno, f"{owner}.{target.id}" if owner else target.id, parent=parent)
            elif isinstance(node, (ast.If, ast.Try)):
                walk([*node.body, *getattr(node, "orelse", [])], owner, parent)

    walk(tree.body, "", None)
    return out


# ---------------------------------------------------------------- PHP

def php_role(name: str, parent: str, path: str) -> str:
    """Role of a class: migration file, parent class, Model parent, own name, folder, else class."""
    if re.search(r"\d{4}_\d{2}_\d{2}_\d{6}_", path.rsplit("/", 1)[-1]):
        return "migration"
    for part, role in CLASS_ROLES:
        if part in parent:
            return role
    if parent.rsplit("\\", 1)[-1] in ("Model", "Authenticatable", "Pivot"):
        return "model"
    for part, role in [*CLASS_ROLES, ("Service", "service"), ("Repository", "repository")]:
        if name.endswith(part):
            return role
    for folder, role in (("/Models/", "model"), ("/Services/", "service"), ("/Repositories/", "repository"), ("/Controllers/", "controller"), ("/Policies/", "policy"), ("/Middleware/", "middleware")):
        if folder.lower() in f"/{path}".lower():
            return role
    return "class"


def _doc(note: str | None) -> str | None:
    """The text of a /** comment."""
    return "\n".join(x.strip().lstrip("*").strip() for x in note[3:].removesuffix("*/").strip().split("\n")).strip() if note else None


_SEEN = ("public", "protected", "private")
_PHP_MODIFIERS = {*_SEEN, "abstract", "final", "readonly", "static", "var"}


class _Php:
    """Declarations of one PHP source, found by walking its tokens."""

    def __init__(self, source: str, path: str):
        self.out, self.path, self.space = Parsed(), path, ""
        self.t = Tokens(source, "php")

    def qualify(self, name: str) -> str:
        return f"{self.space}\\{name}" if self.space else name

    def walk(self, i: int, stop: int, owner: dict | None) -> None:
        """Declarations in [i, stop): the members of owner, or what stands outside of classes."""
        t, begin, modifiers = self.t, None, []
        while i < stop:
            word = t[i].text.lower() if t[i].kind == "word" else ""
            if word in _PHP_MODIFIERS:
                begin, modifiers, i = i if begin is None else begin, [*modifiers, word], i + 1
                continue
            if t[i].text == "#" and t.text(i + 1) == "[":
                begin, i = i if begin is None else begin, t.partner[i + 1] + 1
                continue
            first = i if begin is None else begin
            if word in ("class", "interface", "trait", "enum") and t.is_word(i + 1) and t.text(i - 1) not in ("::", "new"):
                i = self.type(i, first, word, modifiers)
            elif word == "function" and (t.is_word(i + 1) or (t.text(i + 1) == "&" and t.is_word(i + 2))):
                i = self.function(i, first, modifiers, owner)
            elif word == "const":
                i = self.constants(i, modifiers, owner)
            elif word == "use" and t[i].leads:
                i = self.uses(i, owner)
            elif word == "namespace" and owner is None:
                self.space, i = t.text(i + 1) if t.is_word(i + 1) else "", i + 2
            elif owner is not None and t[i].text.startswith("$") and any(m in _SEEN for m in modifiers):
                name = t[i].text[1:]
                self.out.symbol(name, "property", t[i].line, None, f"{owner['qualified_name']}::${name}", next(m for m in modifiers if m in _SEEN), parent=owner["name"])
                i = t.seek(i, ";") + 1
            elif word or t[i].text in "?|&":  # the type of a property
                i += 1
                continue
            else:
                i = t.partner[i] + 1 if owner is not None and i in t.partner else i + 1
            begin, modifiers = None, []

    def type(self, i: int, first: int, kind: str, modifiers: list[str]) -> int:
        t, name = self.t, self.t.text(i + 1)
        brace = t.seek(i, "{")
        if brace >= len(t):
            return i + 1
        heads = {"extends": [], "implements": []}
        current = None
        for j in range(i + 2, brace):
            if t[j].text.lower() in heads:
                current = heads[t[j].text.lower()]
            elif current is not None and t.is_word(j):
                current.append(t[j].text.rsplit("\\", 1)[-1])
        role = kind if kind != "class" else "abstract_class" if "abstract" in modifiers else php_role(name, "".join(t.text(j) for j in range(i, brace) if t.text(j - 1).lower() == "extends"), self.path)
        end = t.partner[brace]
        own = self.out.symbol(name, role, t[first].line, t[end].line, self.qualify(name), docstring=_doc(t[first].note))
        for relation, targets in heads.items():
            for target in targets:
                self.out.relate(own, target, relation)
        self.walk(brace + 1, end, own)
        if role == "model":
            for j in range(brace, end):
                if t.text(j) == "$this" and t.text(j + 1) == "->" and t.text(j + 2) in MODEL_RELATIONS and t.text(j + 3) == "(" and t.is_word(j + 4) and t.text(j + 5) == "::":
                    self.out.relate(own, t.text(j + 4).rsplit("\\", 1)[-1], MODEL_RELATIONS[t.text(j + 2)])
        return end + 1

    def function(self, i: int, first: int, modifiers: list[str], owner: dict | None) -> int:
        t = self.t
        at = i + 2 if t.text(i + 1) == "&" else i + 1
        name, stop = t[at].text, min(t.seek(at, "{", ";"), len(t) - 1)
        stop = t.partner.get(stop, stop)
        if owner is None:
            self.out.symbol(name, "function", t[first].line, t[stop].line, self.qualify(name), docstring=_doc(t[first].note))
        else:
            kind = "constructor" if name == "__construct" else "method"
            self.out.symbol(name, kind, t[first].line, t[stop].line, f"{owner['qualified_name']}::{name}", next((m for m in modifiers if m in _SEEN), "public"), _doc(t[first].note), owner["name"])
        return stop + 1

    def constants(self, i: int, modifiers: list[str], owner: dict | None) -> int:
        t, stop = self.t, self.t.seek(i, ";")
        for j in range(i + 1, stop):
            if t.is_word(j) and t.text(j + 1) == "=" and t[j].text.upper() == t[j].text:
                name = t[j].text
                if owner is None:
                    self.out.symbol(name, "constant", t[j].line, None, self.qualify(name))
                else:
                    self.out.symbol(name, "constant", t[j].line, None, f"{owner['qualified_name']}::{name}", next((m for m in modifiers if m in _SEEN), "public"), parent=owner["name"])
        return stop + 1

    def uses(self, i: int, owner: dict | None) -> int:
        """Traits of a class, or imports of a file (not of functions and constants)."""
        t = self.t
        if owner is not None:
            stop = t.seek(i, ";", "{")
            for target in t.names(i + 1, stop):
                self.out.relate(owner, target.rsplit("\\", 1)[-1], "uses")
            return t.partner.get(stop, stop) + 1
        stop = t.seek(i, ";")
        if t.text(i + 1).lower() not in ("function", "const", "("):
            brace = next((j for j in range(i, stop) if t.text(j) == "{"), None)
            stem, j = ("", i + 1) if brace is None else (t.text(brace - 1).rstrip("\\") + "\\", brace + 1)
            while j < stop:
                if t.is_word(j) and t.text(j - 1).lower() != "as" and t[j].text.lower() != "as":
                    name = stem + t[j].text
                    own = self.out.symbol(name.rsplit("\\", 1)[-1], "import", t[j].line, None, name)
                    self.out.relate(own, name, "imports")
                j += 1
        return stop + 1


def parse_php(source: str, path: str) -> Parsed:
    php = _Php(source, path)
    php.walk(0, len(php.t), None)
    return php.out


# ---------------------------------------------------------------- TypeScript, JavaScript

def function_kind(name: str) -> str:
    return "hook" if re.match("use[A-Z]", name) else "react_component" if re.fullmatch("[A-Z][a-zA-Z0-9]*", name) else "function"


def parse_typescript(source: str, path: str) -> Parsed:
    out, code, line = Parsed(), blanked(source), Lines(source)
    lead = r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?"

    def hooks(own: dict, body: str) -> None:
        for names, kind in ((QUERY_HOOKS, "queries"), (MUTATION_HOOKS, "mutates")):
            for name in names:
                if name in body:
                    out.relate(own, name, kind, 0.9)

    for m in re.finditer(lead + r"(abstract[ \t]+)?class[ \t]+(\w+)(?:<[^{]*?>)?(?:\s+extends\s+([\w.]+)(?:<[^{]*?>)?)?(?:\s+implements\s+([^{]+))?\s*\{", code):
        end = block_end(code, m.end() - 1)
        own = out.symbol(m[2], "abstract_class" if m[1] else "class", line(m.start(2)), line(end - 1))
        out.relate(own, m[3] or "", "extends")
        for i in (m[4] or "").split(","):
            out.relate(own, re.sub("<.*", "", i), "implements")
        at = m.end()
        member = re.compile(r"(?m)^[ \t]*((?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)[ \t]+)*)(#?\w+)[ \t]*(?:<[^(]*>)?\(")
        while f := member.search(code, at, end):
            if f[2] in ("if", "for", "while", "switch", "catch", "return", "function", "super"):
                at = f.end()
                continue
            close = block_end(code, f.end() - 1, "()")
            brace = re.compile(r"[^;{}]*\{").match(code, close, end)
            stop = block_end(code, brace.end() - 1) if brace else close
            see = re.search("public|private|protected", f[1])
            out.symbol(f[2], "constructor" if f[2] == "constructor" else "method", line(f.start(2)), line(stop - 1), f"{m[2]}.{f[2]}", see[0] if see else "public", parent=m[2])
            at = stop
    for m in re.finditer(lead + r"interface[ \t]+(\w+)(?:<[^{]*?>)?(?:\s+extends\s+([^{]+))?\s*\{", code):
        own = out.symbol(m[1], "interface", line(m.start(1)), line(block_end(code, m.end() - 1) - 1))
        for p in (m[2] or "").split(","):
            out.relate(own, re.sub("<.*", "", p), "extends")
    for m in re.finditer(lead + r"type[ \t]+(\w+)(?:<[^=]*>)?[ \t]*=", code):
        stop = code.find(";", m.end())
        out.symbol(m[1], "type_alias", line(m.start(1)), line(stop if stop >= 0 else m.end()))
    for m in re.finditer(lead + r"(?:const[ \t]+)?enum[ \t]+(\w+)\s*\{", code):
        out.symbol(m[1], "enum", line(m.start(1)), line(block_end(code, m.end() - 1) - 1))
    for m in re.finditer(lead + r"(?:async[ \t]+)?function[ \t]*\*?[ \t]*(\w+)[ \t]*(?:<[^(]*>)?\(", code):
        brace = code.find("{", block_end(code, m.end() - 1, "()"))
        stop = block_end(code, brace) if brace >= 0 else m.end()
        own = out.symbol(m[1], function_kind(m[1]), line(m.start(1)), line(stop - 1))
        hooks(own, code[m.start() : stop])
    for m in re.finditer(lead + r"(?:const|let|var)[ \t]+(\w+)(?:[ \t]*:[^=;\n]+)?[ \t]*=[ \t]*(?:async[ \t]*)?(?:function\b[^(]*\(|\([^()]*(?:\([^()]*\)[^()]*)*\)(?:[ \t]*:[^={;]+)?[ \t]*=>|\w+[ \t]*=>)", code):
        brace = re.compile(r"[^;{}\n]*\{").match(code, m.end()) if not m[0].endswith("(") else re.compile(r"[^{]*\{").match(code, m.end())
        stop = block_end(code, brace.end() - 1) if brace else (code.find("\n", m.end()) if "\n" in code[m.end() :] else len(code))
        kind = function_kind(m[1])
        own = out.symbol(m[1], "arrow_function" if kind == "function" else kind, line(m.start(1)), line(max(stop - 1, m.start(1))))
        hooks(own, code[m.start() : stop])
    for m in re.finditer(r"(?m)^[ \t]*import\b[^;'\"]*?(?:from[ \t]*)?(['\"])", code):
        close = source.find(m[1], m.end())
        out.relate(None, source[m.end() : close], "imports")
    return out


# ---------------------------------------------------------------- C#

_CS_SEEN = ("public", "private", "protected", "internal")
_CS_TYPES = {"class": "class", "interface": "interface", "struct": "class", "record": "class", "enum": "enum"}
_NOT_METHODS = {"if", "for", "foreach", "while", "switch", "catch", "using", "lock", "return", "else", "new", "await", "throw", "fixed", "sizeof", "typeof", "nameof", "when"}


def _method_end(t: Tokens, i: int) -> int:
    """Index of the { or => of a method whose name is at i, or -1: after its parameters may stand constraints or a call of another constructor."""
    if not t.is_word(i) or t[i].text in _NOT_METHODS:
        return -1
    at = t.generic_end(i + 1)
    if t.text(at) != "(":
        return -1
    at = t.partner[at] + 1
    if t.text(at) in (":", "where"):
        at = t.seek(at, "{", ";", "=>")
    return at if t.text(at) in ("{", "=>") else -1


class _CSharp:
    """Declarations of one C# source, found by walking its tokens."""

    def __init__(self, source: str):
        self.out, self.space, self.t = Parsed(), "", Tokens(source)

    def walk(self, i: int, stop: int, owner: dict | None) -> None:
        t = self.t
        begin = i  # of the current declaration
        while i < stop:
            text = t[i].text
            if text == "namespace" and owner is None:
                self.space, i = t.dotted(i + 1)
                if self.space:
                    self.out.symbol(self.space, "namespace", t[i - 1].line)
                i = begin = i + (t.text(i) in ("{", ";"))
            elif text == "using" and owner is None and t[i].leads:
                i = begin = self.using(i)
            elif text in _CS_TYPES and (t.is_word(i + 1)) and t.text(i - 1) != ":":
                i = begin = self.type(i, [x.text for x in t[begin:i]])
            elif owner is not None and (body := _method_end(t, i)) >= 0 and (i > begin and (t.text(i - 1) in (">", "]", "?") or t.is_word(i - 1)) or text == owner["name"]) and text not in _NOT_METHODS and t.text(i - 1) not in _NOT_METHODS and "=" not in [x.text for x in t[begin:i]]:
                words = [x.text for x in t[begin:i]]
                is_own = text == owner["name"]
                if is_own or any(w not in _CS_SEEN for w in words):
                    self.out.symbol(text, "constructor" if is_own else "method", t[i].line, None, f"{owner['qualified_name']}.{text}", next((w for w in words if w in _CS_SEEN), None), parent=owner["name"])
                i = begin = (t.partner[body] if t.text(body) == "{" else t.seek(body, ";")) + 1
            elif text in (";", "}"):
                i = begin = i + 1
            elif i in t.partner and (owner is not None or text != "{"):
                begin = t.partner[i] + 1 if text == "{" or (text == "[" and begin == i) else begin
                i = t.partner[i] + 1
            else:
                i += 1
                begin = i if text == "{" else begin

    def using(self, i: int) -> int:
        t, stop = self.t, self.t.seek(i, ";")
        at = i + 1
        at += t.text(at) == "static"
        at += 2 * (t.text(at + 1) == "=")
        name, end = t.dotted(at)
        if name and end == stop:
            self.out.symbol(name.rsplit(".", 1)[-1], "import", t[i].line, None, name)
        return stop + 1

    def type(self, i: int, before: list[str]) -> int:
        t, kind = self.t, self.t.text(i)
        i += t.text(i + 1) in ("class", "struct")
        name = t.text(i + 1)
        at = t.generic_end(i + 2)
        at = t.partner[at] + 1 if t.text(at) == "(" else at
        stop = t.seek(at, "{", ";")
        ends = next((j for j in range(at, stop) if t.text(j) == "where"), stop)
        own = self.out.symbol(name, "abstract_class" if kind == "class" and "abstract" in before else _CS_TYPES[kind], t[i + 1].line, None, f"{self.space}.{name}" if self.space else name, detail=kind)
        if t.text(at) == ":":
            for n, base in enumerate(t.names(at + 1, ends)):
                self.out.relate(own, base, "extends" if n == 0 and kind != "interface" else "implements")
        if t.text(stop) != "{":
            return stop + 1
        if kind != "enum":
            self.walk(stop + 1, t.partner[stop], own)
        return t.partner[stop] + 1


def parse_csharp(source: str, path: str) -> Parsed:
    cs = _CSharp(source)
    cs.walk(0, len(cs.t), None)
    return cs.out


# ---------------------------------------------------------------- SQL, .NET projects, ASP

#: Symbol type of what a CREATE statement makes.
_CREATED = {"table": "table", "view": "view", "procedure": "stored_procedure", "proc": "stored_procedure", "function": "function", "trigger": "function", "index": "unknown"}


def parse_sql(source: str, path: str) -> Parsed:
    out, t = Parsed(), Tokens(source, "sql")
    low = [x.text.lower() for x in t] + [""] * 4
    for i, x in enumerate(t):
        if low[i] != "create" or not x.leads:
            continue
        at = i + 1
        at += 2 * (low[at] == "or" and low[at + 1] in ("alter", "replace"))
        at += low[at] == "temporary"
        kind = low[at]
        if kind not in _CREATED:
            continue
        at += 1 + 3 * (low[at + 1 : at + 4] == ["if", "not", "exists"])
        name, _ = t.dotted(at)
        if name:
            out.symbol(name.rsplit(".", 1)[-1], _CREATED[kind], x.line, None, name, detail=kind)
    return out


#: Symbol type and detail of a project file's tags, and the attribute that names it (the tag's text without one).
_PROJECT_TAGS = {"ProjectReference": ("project", "project_reference", "Include"), "PackageReference": ("package", "package_reference", "Include"), "TargetFramework": ("constant", "target_framework", None), "TargetFrameworks": ("constant", "target_framework", None)}


def parse_dotnet(source: str, path: str) -> Parsed:
    out, line = Parsed(), Lines(source)

    def add(value: str, kind: str, detail: str, at: int) -> None:
        if value := value.strip():
            out.symbol(value.replace("\\", "/").rsplit("/", 1)[-1], kind, at, None, value, detail=detail)

    t = Tokens(source)
    for i, x in enumerate(t):  # Project("{type}") = "name", "file", "{id}"
        if x.leads and x.text.lower() == "project" and t.text(i + 1) == "(" and t.text(i + 4) == "=" and t.is_string(i + 5):
            add(t[i + 5].value, "project", "solution_project", x.line)
    for mark, name, given, at, inside in tags(source):
        if not mark and name in _PROJECT_TAGS:
            kind, detail, attribute = _PROJECT_TAGS[name]
            add(given.get(attribute, "") if attribute else inside, kind, detail, line(at))
    return out


def parse_asp(source: str, path: str) -> Parsed:
    """Classes of page directives; subs, functions, methods, routes and code blocks that begin a line."""
    out, line, t = Parsed(), Lines(source), Tokens(source)
    for mark, name, given, at, _ in tags(source):
        if mark == "%@" and name in ("Page", "Control", "Master") and "Inherits" in given:
            out.symbol(given["Inherits"], "class", line(at))
    for i, x in enumerate(t):
        if not x.leads:
            continue
        at = i
        while t.text(at).lower() in (*_CS_SEEN, "static", "async"):
            at += 1
        low = t.text(at).lower()
        if low in ("sub", "function") and t.is_word(at + 1):
            out.symbol(t.text(at + 1), "method", x.line)
        elif low == "@page" and t.is_string(at + 1):
            out.symbol(t[at + 1].value, "route", x.line)
        elif low in ("@functions", "@code", "functions", "code") and t.text(at + 1) == "{":
            out.symbol("code", "unknown", x.line)
        elif t.is_word(at) and low not in _NOT_METHODS:
            _, after = t.dotted(at)
            after = t.generic_end(after)
            while t.text(after) in ("[", "]", "?"):
                after += 1
            if after > at and _method_end(t, after) >= 0 and t.is_word(after):
                out.symbol(t.text(after), "method", x.line)
    seen: dict[tuple, dict] = {}
    for own in out.symbols:
        seen.setdefault((own["name"], own["line_start"]), own)
    out.symbols = list(seen.values())
    return out


Parser = Callable[[str, str], Parsed]
PARSERS: dict[str, Parser] = {"python": parse_python, "php": parse_php, "csharp": parse_csharp, "sql": parse_sql, "dotnet": parse_dotnet, "asp": parse_asp, "aspnet": parse_asp} | dict.fromkeys(("typescript", "tsx", "javascript", "jsx"), parse_typescript)


def parse(source: str, language: str, path: str, parsers: dict[str, Parser] = PARSERS) -> Parsed:
    parser = parsers.get(language)
    if parser is None:
        return Parsed(errors=[f"no parser for {language}"])
    try:
        return parser(source, path)
    except Exception as e:  # a file that breaks a parser must not stop the others
        return Parsed(errors=[f"{type(e).__name__}: {e}"])


PARSED = T.StructType([T.StructField("path", T.StringType()), T.StructField("symbols", T.ArrayType(SYMBOL)), T.StructField("relationships", T.ArrayType(RELATIONSHIP)), T.StructField("errors", T.ArrayType(T.StringType()))])


def parse_files(files: DataFrame, parsers: dict[str, Parser] = PARSERS) -> DataFrame:
    """path, symbols, relationships, errors for files (path, language, source)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(PARSED)

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            got = [parse(s or "", lang or "unknown", p, parsers) for p, lang, s in zip(rows["path"], rows["language"], rows["source"], strict=True)]
            yield pa.RecordBatch.from_pydict({"path": rows["path"], "symbols": [g.symbols for g in got], "relationships": [g.relationships for g in got], "errors": [g.errors for g in got]}, schema=schema)

    return files.select("path", "language", "source").mapInArrow(run, PARSED)


def symbols_of(parsed: DataFrame, languages: DataFrame) -> DataFrame:
    """The symbols table, the last of equal ids; languages: path, language."""
    from .graph import last_wins

    rows = parsed.select("path", F.posexplode("symbols").alias("seq", "s")).select("path", "seq", "s.*").join(languages.select("path", "language"), "path")
    rows = rows.withColumn("file_id", X.file_id(F.col("path"))).withColumn("id", X.symbol_id(F.col("file_id"), F.col("qualified_name"), F.col("line_start")))
    rows = last_wins(rows, "id", "seq").drop("seq").withColumnRenamed("path", "file_path")
    parents = rows.groupBy("file_path", F.col("name").alias("parent_name")).agg(F.min_by("id", "line_start").alias("parent_id"))
    return rows.join(parents, ["file_path", "parent_name"], "left")


def relationships_of(parsed: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """The relationships table; with symbols only rows whose source is one of them (so imports of files go)."""
    from .graph import last_wins

    rows = parsed.select("path", F.posexplode("relationships").alias("seq", "r")).select("path", "seq", "r.*")
    file = X.file_id(F.col("path"))
    source = F.when(F.col("source").isNull(), file).otherwise(X.symbol_id(file, F.col("source"), F.col("source_line")))
    rows = rows.select(source.alias("source_symbol_id"), F.col("path").alias("source_file_path"), F.lit(None).cast("string").alias("target_symbol_id"), "target_name", "relationship_type", "confidence", F.lit("parsed").alias("origin"), F.col("seq").cast("long").alias("seq"))
    rows = rows.withColumn("id", X.relationship_id(F.col("source_symbol_id"), F.col("target_name"), F.col("relationship_type")))
    rows = last_wins(rows, "id", "seq")
    return rows if symbols is None else rows.join(symbols.select(F.col("id").alias("source_symbol_id")), "source_symbol_id", "left_semi")
