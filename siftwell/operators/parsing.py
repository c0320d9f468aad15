"""Symbols, chunks and imports of source files.

There is no grammar library here: symbols are recognised by rules for each language over logical lines (a line and
those that follow while a bracket is open), and blocks end by indentation, braces or ``end``.  Strings and comments are
blanked before brackets are counted and rules are tried, so what they hold is no code.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text

_NAME = r"([A-Za-z_$][\w$]*)"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|override|virtual|open|data|inline|suspend|export|default|readonly|implicit|lazy|case|unsafe|extern|const)\s+)*"


def _rules(*pairs: tuple[str, str]) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(p.replace("NAME", _NAME).replace("MODS", _MODS)), kind) for p, kind in pairs]


_TS = _rules(
    (r"^\s*MODSfunction\s*\*?\s*NAME", "function"), (r"^\s*MODSclass\s+NAME", "class"), (r"^\s*MODSinterface\s+NAME", "interface"), (r"^\s*MODSenum\s+NAME", "enum"),
    (r"^\s*MODStype\s+NAME\s*[=<]", "type"),
    (r"^\s*(?:export\s+)?(?:const|let|var)\s+NAME\s*(?::[^=]*)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]*)?=>|\w+\s*=>)", "function"),
    (r"^\s*(?:export\s+)?(?:const|let|var)\s+NAME", "variable"), (r"^\s+MODS(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)NAME\s*\([^;]*\)\s*(?::[^{]*)?\{\s*$", "method"),
)
_C = _rules((r"^\s*(?:typedef\s+)?struct\s+NAME", "struct"), (r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?NAME", "enum"), (r"^\s*typedef\s+.*?\bNAME\s*;", "type"),
            (r"^(?!\s*(?:return|else|if|for|while|switch|typedef|struct|enum)\b)[A-Za-z_][\w\s\*&:<>,]*?[\s\*&]([A-Za-z_~][\w:~]*\s*\([^;]*\))\s*(?:const\s*)?\{?\s*$", "function"))
RULES: dict[str, list[tuple[re.Pattern, str]]] = {
    "rust": _rules((r"^\s*(?:pub(?:\([^)]*\))?\s+)?MODSfn\s+NAME", "function"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+NAME", "struct"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+NAME", "enum"),
                   (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+NAME", "trait"), (r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?NAME", "class"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+NAME", "module"),
                   (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?NAME\s*:", "constant"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+NAME", "type"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+NAME\s*;", "import")),
    "typescript": _TS, "javascript": _TS,
    "python": _rules((r"^\s*(?:async\s+)?def\s+NAME", "function"), (r"^\s*class\s+NAME", "class"), (r"^\s*import\s+([\w.]+(?:\s+as\s+\w+)?)", "import"),
                     (r"^\s*from\s+\.*[\w.]*\s+import\s+\(?\s*(\w+(?:\s+as\s+\w+)?)", "import")),
    "go": _rules((r"^func\s+NAME", "function"), (r"^func\s+\([^)]*\)\s*NAME", "method"), (r"^\s*type\s+NAME", "type"), (r"^\s*const\s+NAME", "constant"), (r"^\s*var\s+NAME", "variable")),
    "java": _rules((r"^\s*import\s+NAME\s*;", "import"), (r"^\s*MODSclass\s+NAME", "class"), (r"^\s*MODSinterface\s+NAME", "interface"), (r"^\s*MODSenum\s+NAME", "enum"),
                   (r"^\s+MODS(?!return\b|new\b|else\b|throw\b)[\w<>\[\], .?]+\s+NAME\s*\([^;]*\)\s*(?:throws\s+[\w, .]+)?\s*[{;]?\s*$", "method"), (r"^\s+MODS(?!return\b|package\b|import\b|throw\b)[\w<>\[\]?]+\s+NAME\s*(?:=[^=].*)?;", "variable")),
    "c": _C, "cpp": _C,
    "php": _rules((r"^\s+(?:(?:public|private|protected|static|final|abstract)\s+)+function\s+&?NAME", "method"), (r"^\s*function\s+&?NAME", "function"), (r"^\s*MODSclass\s+NAME", "class"), (r"^\s*interface\s+NAME", "interface"),
                  (r"^\s*trait\s+NAME", "trait"), (r"^\s*enum\s+NAME", "enum"), (r"^\s*namespace\s+([\w\\]+)", "module"), (r"^\s*MODSconst\s+NAME", "constant")),
    "ruby": _rules((r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", "function"), (r"^\s*class\s+([A-Z][\w:]*)", "class"), (r"^\s*module\s+([A-Z][\w:]*)", "module"), (r"^\s*([A-Z][A-Z0-9_]*)\s*=[^=]", "constant")),
    "csharp": _rules((r"^\s*(?:global\s+)?using\s+NAME\s*[;=]", "import"), (r"^\s*MODSclass\s+NAME", "class"), (r"^\s*MODSstruct\s+NAME", "struct"), (r"^\s*MODSinterface\s+NAME", "interface"), (r"^\s*MODSenum\s+NAME", "enum"), (r"^\s*namespace\s+([\w.]+)", "module"),
                     (r"^\s+MODS(?!return\b|new\b|else\b|throw\b|using\b)[\w<>\[\], .?]+\s+NAME\s*\([^;]*\)\s*[{;]?\s*$", "method"), (r"^\s+MODS(?!return\b|using\b)[\w<>\[\]?]+\s+NAME\s*(?:\{\s*get|=[^=].*;|;)", "variable")),
    "kotlin": _rules((r"^\s*import\s+([\w.]+)", "import"), (r"^\s*MODSfun\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?NAME", "function"), (r"^\s*MODSinterface\s+NAME", "interface"), (r"^\s*MODSenum\s+class\s+NAME", "class"), (r"^\s*MODS(?:class|object)\s+NAME", "class"), (r"^\s*MODS(?:val|var)\s+NAME", "variable")),
    "scala": _rules((r"^\s*import\s+(\w+)", "import"), (r"^\s*MODSdef\s+NAME", "function"), (r"^\s*MODS(?:class|object)\s+NAME", "class"), (r"^\s*MODStrait\s+NAME", "trait"), (r"^\s*enum\s+NAME", "enum"), (r"^\s*MODStype\s+NAME", "type"), (r"^\s*MODS(?:val|var)\s+NAME", "variable")),
    "html": _rules((r"^\s*<(script|style)\b", "module"), (r"^\s*<([a-zA-Z][\w-]*)", "variable")),
    "json": _rules((r"^\s*\"((?:[^\"\\]|\\.)+)\"\s*:", "variable")), "yaml": _rules((r"^\s*(?:-\s+)?([\w.-]+)\s*:(?:\s|$)", "variable")),
    "toml": _rules((r"^\s*\[+([\w.\"-]+)\]+", "struct"), (r"^\s*([\w.-]+)\s*=", "variable")),
    "bash": _rules((r"^\s*(?:function\s+)?([\w-]+)\s*\(\)", "function"), (r"^\s*function\s+([\w-]+)", "function"), (r"^\s*(?:export\s+|local\s+|readonly\s+)?([A-Za-z_]\w*)=", "variable")),
    "elixir": _rules((r"^\s*defp?\s+([a-z_]\w*[?!]?)", "function"), (r"^\s*defmodule\s+([\w.]+)", "module"), (r"^\s*defmacrop?\s+([a-z_]\w*)", "function")),
}
#: One pattern for each language that matches where one of its rules does.
_ANY = {language: re.compile("|".join(f"(?:{rule.pattern})" for rule, _ in rules)) for language, rules in RULES.items()}
#: Kinds at which chunks may be cut.
BOUNDARIES = {
    "rust": ["function", "struct", "enum", "trait", "class", "module"], "typescript": ["function", "variable", "class", "interface", "method"], "javascript": ["function", "variable", "class", "interface", "method"], "python": ["function", "class"],
    "go": ["function", "method", "type"], "java": ["method", "class", "interface"], "c": ["function", "struct"], "cpp": ["function", "struct", "class"], "php": ["function", "method", "class", "interface", "trait"], "ruby": ["function", "class", "module"],
    "csharp": ["method", "class", "struct", "interface"], "kotlin": ["function", "class", "interface"], "scala": ["function", "class", "trait"], "html": ["variable", "module"], "json": [], "yaml": [], "toml": ["struct"], "bash": ["function"], "elixir": ["function", "module"],
}
_COMMENT = {"python": ("#",), "ruby": ("#",), "bash": ("#",), "yaml": ("#",), "toml": ("#",), "elixir": ("#",), "html": ("<!--",)}
_INDENTED, _ENDED = {"python", "yaml"}, {"ruby", "elixir"}


def _split(source: str) -> list[str]:
    out = [x.removesuffix("\r") for x in source.split("\n")]
    return out[:-1] if out and out[-1] == "" else out


_TRIPLE = {"python": ('"""', "'''"), "kotlin": ('"""',), "scala": ('"""',), "elixir": ('"""',)}
_QUOTES = {"rust": '"', "html": "", "json": "", "yaml": "", "toml": ""}


@cache
def _openers(language: str) -> tuple[re.Pattern | None, bool, str | None]:
    """What begins a comment or a string, whether a ``#`` needs white space before it, and the end of a block comment."""
    quotes, triples = _QUOTES.get(language, "\"'`" if language in ("typescript", "javascript", "go") else "\"'"), _TRIPLE.get(language, ())
    marks = () if language == "json" else _COMMENT.get(language, ("//",))
    block = ("<!--", "-->") if language == "html" else None if language in ("python", "ruby", "bash", "yaml", "toml", "elixir", "json") else ("/*", "*/")
    kinds = {"block": block[:1] if block else (), "mark": marks, "triple": triples, "quote": tuple(quotes)}
    parts = [f"(?P<{kind}>{'|'.join(map(re.escape, words))})" for kind, words in kinds.items() if words]
    return re.compile("|".join(parts)) if parts else None, marks == ("#",), block[1] if block else None


_ENDS = {u: re.compile(rf"{u}|\\") for u in ('"', "'", "`", '"""', "'''")}


def _code(lines: list[str], language: str) -> list[str]:
    """The lines with comments gone and what stands in quotes blanked; quotes and lengths before a comment stay.

    In data formats (``json`` to ``toml`` above) quotes name things and are left as they are.
    """
    opener, spaced, block_end = _openers(language)
    if opener is None:
        return lines
    search = opener.search
    out, until = [], ""
    for line in lines:
        if until in ("\"", "'"):  # a plain string ends with its line
            until = ""
        m = None if until else search(line)
        if not until and m is None:
            out.append(line)
            continue
        kept, k, n = [], 0, len(line)
        while k < n:
            if until in _ENDS:
                e = _ENDS[until].search(line, k)
                if e is None:
                    kept.append(" " * (n - k))
                    break
                kept.append(" " * (e.start() - k))
                if e[0] == "\\":
                    kept.append(" " * min(2, n - e.start()))
                    k = e.start() + 2
                else:
                    kept.append(until)
                    k, until = e.end(), ""
                continue
            if until:
                e = line.find(until, k)
                if e < 0:
                    kept.append(" " * (n - k))
                    break
                kept.append(" " * (e - k + len(until)))
                k, until = e + len(until), ""
                continue
            m = search(line, k)
            if m is None:
                kept.append(line[k:])
                break
            at, kind = m.start(), m.lastgroup
            kept.append(line[k:at])
            k = m.end()
            if kind == "block":
                until = block_end
                kept.append(" " * (k - at))
            elif kind == "mark" and not (spaced and at and not line[at - 1].isspace()):
                break
            elif kind == "triple" or (kind == "quote" and not (m[0] == "'" and language in ("scala", "kotlin") and "'" not in line[at + 1 :])):
                until = m[0]
                kept.append(until)
            else:
                kept.append(m[0])
        out.append("".join(kept))
    return out


def _open(line: str) -> int:
    return line.count("(") + line.count("[") - line.count(")") - line.count("]")


def _logical(code: list[str], at: int, most: int = 60) -> tuple[str, int]:
    """The line joined with those that follow while a round or square bracket is open, and the last of them."""
    text_, last = code[at], at
    depth = _open(text_)
    while depth > 0 and last + 1 < len(code) and last - at < most:
        last += 1
        text_ += " " + code[last].strip()
        depth += _open(code[last])
    return (text_, last) if depth <= 0 else (code[at], at)


def _next_smaller(values: list[int]) -> array:
    """For each place the next one with a smaller value (the number of places if there is none)."""
    out, open_ = array("q", [len(values)]) * len(values), []
    for k, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            out[open_.pop()] = k
        open_.append(k)
    return out


class _Blocks:
    """Where blocks end.  Lines are passed a bounded number of times, however many blocks enclose them or stay open."""

    NEAR = 64  # lines that are looked through one by one

    def __init__(self, code: list[str], language: str):
        self.code, self.ended, self.indented = code, language in _ENDED, language in _INDENTED or language in _ENDED
        if self.indented:
            self.full = [k for k, x in enumerate(code) if x.strip()]
            self.level = [len(code[k]) - len(code[k].lstrip()) for k in self.full]
        else:  # braces open behind each line
            self.level = list(accumulate([x.count("{") - x.count("}") for x in code]))
        self.after: array | None = None

    def _until(self, k: int, most: int) -> int:
        """The first place from ``k`` on whose level is ``most`` or less."""
        level, n = self.level, len(self.level)
        near = min(n, k + self.NEAR)
        while k < near and level[k] > most:
            k += 1
        if k == near < n:
            self.after = self.after or _next_smaller(level)
            while k < n and level[k] > most:
                k = self.after[k]
        return k

    def end(self, at: int, header: int) -> int:
        """The last line of the block that the declaration in lines ``at`` to ``header`` opens."""
        code = self.code
        if self.indented:
            first = bisect_left(self.full, header + 1)
            j = self._until(first, len(code[at]) - len(code[at].lstrip()))
            if j < len(self.full) and self.ended and re.match(r"\s*end\b", code[self.full[j]]):
                return self.full[j]
            return self.full[j - 1] if j > first else header
        k = at
        while k < len(code) and "{" not in code[k]:
            if k >= header and (";" in code[k] or k > header + 3):
                return k if ";" in code[k] else header
            k += 1
        if k == len(code):
            return header
        return min(self._until(k, self.level[at - 1] if at else 0), len(code) - 1)


_C_TYPE = re.compile(r"^[A-Za-z_][\w\s\*:<>,&]*$")
_C_NAME = re.compile(r"^[A-Za-z_~][\w:~]*\s*\(")


def _offsets(lines: list[str], ascii_: bool) -> array:
    """Bytes before each line, and behind the last one."""
    return array("q", accumulate([len(x) + 1 for x in lines] if ascii_ else [len(x.encode()) + 1 for x in lines], initial=0))


def extract_symbols(source: str, language: str) -> list[dict]:
    """Symbols in order of lines; the parent is the name of the nearest symbol whose block encloses the line."""
    return list(_symbols(source, language))


def _symbols(source: str, language: str) -> Iterator[dict]:
    if language not in RULES:
        return
    any_rule, rules = _ANY[language].match, RULES[language]
    lines = _split(source)
    code = _code(lines, language)
    offsets = _offsets(lines, source.isascii())
    marks = _COMMENT.get(language, ("//", "/*", "*"))
    blocks = None
    open_: list[dict] = []
    inside = -1  # last line of the header that is being read
    for k, line in enumerate(lines):
        if k <= inside or not code[k].strip():
            continue
        begin = k
        joined, last = _logical(code, k)
        if language in ("c", "cpp") and k and _C_NAME.match(code[k]) and _C_TYPE.match(code[k - 1]) and code[k - 1].strip() and code[k - 1].strip() not in ("else", "do", "public:", "private:"):
            begin, joined = k - 1, code[k - 1].rstrip() + " " + joined  # the type stands on a line of its own
        if not any_rule(joined) and not (last > k and any_rule(code[k])):
            continue
        for rule, kind in rules:
            if m := rule.match(joined) or (last > k and rule.match(code[k])):
                if m.string == joined:
                    inside = last
                while open_ and open_[-1]["end_line"] < begin + 1:
                    open_.pop()
                if kind == "method" and language in ("java", "csharp") and open_ and open_[-1]["name"] == m[1]:
                    continue  # a constructor
                header = last if m.string == joined else k
                if kind == "import":
                    end = last
                else:
                    blocks = blocks or _Blocks(code, language)
                    end = max(header, blocks.end(begin, header))
                above = begin
                while above and lines[above - 1].lstrip().startswith(marks) and not lines[above - 1].lstrip().startswith(("#!", "#[", "#include")):
                    above -= 1
                head = lines[begin].lstrip()
                first = head.strip() if len(head) <= 200 else (head[:200] + "...").strip()
                name = re.sub(r"\s+", " ", m[1].strip())
                if '"' in name or language in _QUOTES and m.string == joined and begin == last:
                    again = rule.match(line)  # names within quotes come from the line as it is
                    name = again[1].strip() if again else name
                sym = {"name": name, "kind": kind, "start_line": begin + 1, "end_line": end + 1, "start_byte": offsets[begin + 1] - 1 - len(head.encode()), "end_byte": offsets[end + 1] - 1,
                       "signature": first, "doc_comment": "\n".join(x.strip() for x in lines[above:begin]) or None, "parent": open_[-1]["name"] if open_ else None}
                yield sym
                if kind != "import":
                    open_.append(sym)
                break


def _cut(offsets: array, size: int) -> Iterator[tuple[int, int]]:
    start, n = 0, len(offsets) - 1
    while start < n:
        end = min(n, bisect_left(offsets, offsets[start] + size, start + 1))
        yield start, end
        start = end - C.OVERLAP_LINES if end - C.OVERLAP_LINES > start else end


def chunk_lines(lines: list[str], size: int = C.CHUNK_BYTES) -> list[tuple[int, int]]:
    """Ranges [start, end) of lines (from 0) for text without boundaries; neighbours share lines."""
    return list(_cut(_offsets(lines, False), size))


def _cut_at(boundaries: Iterable[tuple[int, str]], offsets: array, size: int) -> Iterator[tuple[int, int, list[str]]]:
    start, names = 0, []
    for at, name in boundaries:
        if at > start and names and offsets[at] - offsets[start] >= size:
            yield start, at, names
            start, names = max(0, at - C.OVERLAP_LINES), []
        names.append(name)
    if start < len(offsets) - 1:
        yield start, len(offsets) - 1, names


def chunk(source: str, boundaries: list[tuple[int, str]], size: int = C.CHUNK_BYTES) -> list[dict]:
    """Chunks cut at boundaries (line from 0, name) once they are large enough and name something."""
    return list(_chunks(source, boundaries, size))


def _chunks(source: str, boundaries: list[tuple[int, str]], size: int) -> Iterator[dict]:
    lines, ascii_ = _split(source), source.isascii()
    offsets = _offsets(lines, ascii_)
    total = len(source) if ascii_ else len(source.encode())
    ranges = _cut_at(sorted(boundaries, key=lambda b: b[0]), offsets, size) if boundaries else ((a, b, []) for a, b in _cut(offsets, size))
    for a, b, names in ranges:
        yield {"content": "\n".join(lines[a:b]), "start_line": a + 1, "end_line": b, "start_byte": min(offsets[a], total), "end_byte": min(offsets[b] - 1, total), "symbols": names}


def chunk_source(source: str, language: str, size: int = C.CHUNK_BYTES) -> list[dict]:
    return list(_source_chunks(source, language, size))


def _source_chunks(source: str, language: str, size: int) -> Iterator[dict]:
    kinds = BOUNDARIES.get(language)  # without them nothing is asked of the symbols
    return _chunks(source, [(s["start_line"] - 1, s["name"]) for s in _symbols(source, language) if s["kind"] in kinds] if kinds else [], size)


# -- imports: one pattern for each language over the whole text; the path is its first non-empty group --------

_LINE = r"(?m)^[ \t]*"
_TS_IMPORT = _LINE + r"import\b(?:[^;'\"]*?\bfrom)?[ \t\r\n]*['\"]([^'\"\r\n]+)['\"]"
_INCLUDE = _LINE + r"#[ \t]*include[ \t]+(?:\"([^\"\r\n]+)\"|<([^>\r\n]+)>)"
IMPORTS = {
    "rust": _LINE + r"use\s+([^;]+?)\s*;", "typescript": _TS_IMPORT, "javascript": _TS_IMPORT,
    "python": _LINE + r"(?:from[ \t]+(\.*[\w.]*)[ \t]+import\b|import[ \t]+([\w.]+))", "go": _LINE + r"(?:import[ \t]+)?(?:[\w.]+[ \t]+)?\"([^\"\r\n]+)\"[ \t]*\r?$",
    "java": _LINE + r"import[ \t]+(?:static[ \t]+)?([\w.]+?)(?:\.\*)?[ \t]*;", "c": _INCLUDE, "cpp": _INCLUDE, "php": _LINE + r"use\s+([^;()]+?)(?:\s+as\s+\w+)?\s*;",
    "ruby": _LINE + r"require(?:_relative)?[ \t]*\(?[ \t]*['\"]([^'\"\r\n]+)['\"]", "csharp": _LINE + r"using[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;",
    "kotlin": _LINE + r"import[ \t]+([\w.]+?)(?:\.\*)?(?:[ \t]+as[ \t]+\w+)?[ \t]*;?[ \t]*\r?$", "scala": _LINE + r"import[ \t]+([^\r\n]+?)[ \t]*\r?$",
    "bash": _LINE + r"(?:source|\.)[ \t]+[\"']?([^\s\"']+)", "elixir": _LINE + r"(?:import|alias|use|require)[ \t]+([^\s,]+)",
}


def import_kind(language: Column, path: Column, line: Column) -> Column:
    head = F.split(path, r"\.")[0]
    root = F.split(path, "::")[0]
    local, std = F.lit("local"), F.lit("std")
    return (
        F.when(language == "rust", F.when(root.isin("std", "core", "alloc"), std).when(root.isin("crate", "self", "super"), local).otherwise("external"))
        .when(language.isin("typescript", "javascript"), F.when(path.startswith("."), local).otherwise("external"))
        .when(language == "python", F.when(path.startswith("."), local).when(head.isin(C.PYTHON_STD), std).otherwise("external"))
        .when(language == "go", F.when(path.startswith(".") | path.startswith("/"), local).when(path.contains("."), "external").otherwise(std))
        .when(language == "java", F.when(path.startswith("java.") | path.startswith("javax."), std).otherwise("external"))
        .when(language.isin("c", "cpp"), F.when(line.contains('"'), local).otherwise(std))
        .when(language == "ruby", F.when(line.contains("require_relative"), local).otherwise("external"))
        .when(language == "csharp", F.when(path.startswith("System"), std).otherwise("external"))
        .when(language == "kotlin", F.when(path.startswith("kotlin.") | path.startswith("java."), std).otherwise("external"))
        .when(language == "scala", F.when(path.startswith("scala.") | path.startswith("java."), std).otherwise("external"))
        .when(language == "bash", local)
        .when(language == "elixir", F.when(path.startswith("Elixir.") | path.startswith(":"), std).otherwise("external"))
        .otherwise("external"))


def import_name(language: Column, path: Column) -> Column:
    last = lambda sep: F.element_at(F.split(path, sep), -1)
    return (
        F.when(language == "rust", F.when(~path.contains("{"), last("::")))
        .when(language == "php", last(r"\\"))
        .when(language.isin("typescript", "javascript", "go", "c", "cpp", "ruby", "bash"), last("/"))
        .otherwise(last(r"\.")))


def extract_imports(files: DataFrame) -> DataFrame:
    """(file_id, line, target_path, import_name, kind), by expressions alone; files have content and language.

    Patterns run over whole texts, so imports that spread over lines are found; ``line`` is the first of them.
    """
    language, content = F.col("language"), F.col("content")
    rows = files.filter(language.isin(list(IMPORTS)) & content.isNotNull()).select("file_id", "language", "content")
    row = "array<struct<line:int,hit:string,path:string>>"
    found = F.array().cast(row)
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    for name, pattern in IMPORTS.items():
        hits = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
        paths = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
        for g in range(2, re.compile(pattern).groups + 1):
            paths = F.zip_with(paths, F.regexp_extract_all(content, F.lit(pattern), F.lit(g)), lambda a, b: F.when(a != "", a).otherwise(b))
        steps = F.zip_with(F.slice(F.split(content, pattern, -1), 1, F.size(hits)), F.arrays_zip(hits.alias("hit"), paths.alias("path")), lambda gap, x: F.struct(gap.alias("gap"), x["hit"].alias("hit"), x["path"].alias("path")))
        zero = F.struct(F.lit(1).alias("at"), F.array().cast(row).alias("out"))
        placed = F.aggregate(steps, zero, lambda acc, x: F.struct(
            (acc["at"] + newlines(x["gap"]) + newlines(x["hit"])).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + newlines(x["gap"])).alias("line"), x["hit"].alias("hit"), x["path"].alias("path"))).alias("out")), lambda acc: acc["out"])
        found = F.when((language == name) & content.rlike(pattern), placed).otherwise(found)
    rows = rows.select("file_id", "language", F.explode(found).alias("x")).select("file_id", "language", "x.line", "x.hit", F.col("x.path").alias("target_path"))
    path = F.col("target_path")
    return rows.select("file_id", F.col("line").cast("long").alias("line"), "target_path", import_name(language, path).alias("import_name"), import_kind(language, path, F.col("hit")).alias("kind"))


SYMBOL_ROWS = "file_id long, name string, kind string, start_line long, end_line long, start_byte long, end_byte long, signature string, doc_comment string, parent string"
CHUNK_ROWS = "file_id long, content string, start_line long, end_line long, start_byte long, end_byte long, symbols array<string>"


#: Rows and characters of content after which a batch goes out.
BATCH_ROWS, BATCH_CHARS = 4096, 8_000_000


def _rows(files: DataFrame, function: Callable[[str, str], Iterable[dict]], schema: str) -> DataFrame:
    """The rows of each file's dicts; a file's rows leave as they come, so they never stand in memory at once."""
    values = itemgetter(*[part.split()[0] for part in schema.split(", ")][1:])
    types = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    arrow = pa.schema([(part.split()[0], types[part.split()[1]]) for part in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
            rows.clear()
            return out

        rows: list[tuple] = []
        chars = 0
        for batch in batches:
            for i, source, language in zip(*batch.columns, strict=True):
                if not source.is_valid:
                    continue
                key = i.as_py()
                for row in function(source.as_py(), language.as_py() or ""):
                    rows.append((key, *values(row)))
                    chars += len(row.get("content") or row.get("doc_comment") or "")
                    if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield flush()
                        chars = 0
        if rows:
            yield flush()

    return files.select("file_id", "content", "language").mapInArrow(run, schema)


def parse_symbols(files: DataFrame) -> DataFrame:
    return _rows(files, _symbols, SYMBOL_ROWS)


def parse_chunks(files: DataFrame, size: int = C.CHUNK_BYTES) -> DataFrame:
    return _rows(files, lambda s, lang: _source_chunks(s, lang, size), CHUNK_ROWS)
