"""Symbols, imports and exports of source files, by a tolerant scanner of one file inside the tasks.

Comments and strings are blanked first, so that brackets tell how deep a place lies; declarations are then
looked for at the depth of the file, of a class, trait or impl body, or of an inline module. Damaged files
give what is still there: a bracket that is never closed reaches to the end.

Defined results: a null or empty file and one of another language have no symbols; a declaration that begins neither a line
nor behind a brace or semicolon isn't seen; signatures without a body are no symbols; exported constants are exports like other
declarations; decorated methods of a decorated class are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowmill.operators.code import language_of

SYMBOL = "symbol_name string, symbol_type string, scope_chain string, start_line int, end_line int, is_overview boolean, content string"
FOUND = f"symbols array<struct<{SYMBOL.replace(' ', ':').replace(',:', ',')}>>, imports array<string>, exports array<string>"
_STRINGS = r""""(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?"""
_BLANKED = {
    "python": r'(?P<c>#[^\n]*)|"""(?:\\.|[^\\])*?(?:"""|\Z)|' + r"'''(?:\\.|[^\\])*?(?:'''|\Z)|" + _STRINGS,
    "typescript": r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|`(?:\\.|[^`\\])*`?|" + _STRINGS,
    "rust": r"""(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|\br(#*)".*?"\2|"(?:\\.|[^"\\])*"?|'(?:\\[^']*|[^'\\\n])'""",
}
#: Where a declaration may begin: a line, or behind a brace or semicolon.
_BEGIN = r"(?:^|(?<=[{};]))[ \t]*"
_BLANKED = {k: re.compile(v, re.S) for k, v in _BLANKED.items()}


class Source:
    """A file's text, the same with comments and strings blanked, and how deep in brackets each place lies."""

    def __init__(self, text: str, language: str):
        self.text = text
        self.code = _BLANKED[language].sub(lambda m: re.sub(r"[^\n]", " " if m["c"] else "_", m[0]), text)
        self.closing: dict[int, int] = {}
        self.turns, self.depths, opened = [0], [0], []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            if m[0] in "([{":
                opened.append(m.start())
            elif opened:
                self.closing[opened.pop()] = m.start()
            self.turns.append(m.end())
            self.depths.append(len(opened))
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.symbols: list[tuple] = []
        self.imports: list[str] = []
        self.exports: list[str] = []

    def depth(self, at: int) -> int:
        return self.depths[bisect_right(self.turns, at) - 1]

    def at_depth(self, pattern: str, begin: int, end: int, depth: int) -> Iterator[re.Match]:
        return (m for m in re.compile(pattern, re.M).finditer(self.code, begin, end) if self.depth(m.start()) == depth)

    def first(self, marks: str, begin: int) -> int:
        """The first of the marks at the depth of ``begin``, or the end."""
        return next((m.start() for m in self.at_depth(f"[{re.escape(marks)}]", begin, len(self.code), self.depth(begin))), len(self.code))

    def block(self, begin: int) -> tuple[int, int] | None:
        """The braces of a body, behind types that hold braces themselves; none where a semicolon comes first."""
        at = self.first("{;", begin)
        while at < len(self.code) and self.code[at] == "{":
            close = self.closing.get(at, len(self.code) - 1)
            if not re.compile(r"\s*[>|&{\[]").match(self.code, close + 1):
                return at, close + 1
            at = self.first("{;", close + 1)
        return None

    def statement(self, begin: int) -> int:
        """The end of a statement: behind its semicolon, or where a line is complete and the next one doesn't go on."""
        for m in self.at_depth(r";|\n", begin, len(self.code), self.depth(begin)):
            if m[0] == ";":
                return m.end()
            if not re.search(r"(?:[=,+\-*/&|?:.<({\[]|=>)\s*$", self.code[begin : m.start()]) and not re.compile(r"\s*(?:[.?:=&|+*/)\]}]|=>)").match(self.code, m.end()):
                return m.start()
        return len(self.code.rstrip())

    def add(self, name: str, kind: str, scope: str, begin: int, end: int, overview: bool = False) -> None:
        end = begin + len(self.code[begin:end].rstrip())
        row = lambda at: bisect_right(self.lines, at - 1) + 1
        self.symbols.append((name, kind, scope, row(begin), row(max(begin, end - 1)), overview, self.text[begin:end]))


def _last_string(text: str) -> list[str]:
    return re.findall(r"""["']([^"'\n]*)["']""", text)[-1:]


def read_typescript(s: Source) -> None:
    kinds = {"class": "class", "interface": "interface", "type": "type_alias", "enum": "enum"}
    for m in s.at_depth(_BEGIN + r"(export\s+(default\s+)?)?((?:async\s+)?function\b(?!\s*\*)|class\b|interface\b|type\b(?=\s+[\w$])|(?:const\s+)?enum\b|const\b|let\b)\s*([\w$]+|[{\[])?", 0, len(s.code), 0):
        begin, word, name = m.start(3), m[3].split()[-1], m[4] or "<anonymous>"
        if word in ("const", "let"):
            end = s.statement(begin)
            names = [(m.start(4), name)] if m[4] else []
            names += [(c.start(1), c[1]) for c in s.at_depth(r",\s*([\w$]+)\s*(?::[^=,;]*)?=(?!>)", m.end(), end, 0)]
            for at, n in names:
                if n in "{[":
                    n = s.text[at : s.closing.get(at, end) + 1]
                value = re.compile(r"\s*(?::[^=;]*(?:=>[^=;]*)?)?=\s*(?:async\s*)?(?:<[^>]*>\s*)?").match(s.code, at + len(n))
                arrow = False
                if value and value.end() < len(s.code):
                    behind = s.closing.get(value.end(), -1) + 1 if s.code[value.end()] == "(" else re.compile(r"[\w$]*").match(s.code, value.end()).end()
                    arrow = behind > 0 and bool(re.compile(r"\s*(?::[^;]*?)?=>").match(s.code[behind:end]))
                s.add(n, "function" if arrow else "constant", n, begin, end)
                if m[1]:
                    s.exports.append(n)
            continue
        body = s.block(m.end()) if word != "type" else None
        if word == "type":
            s.add(name, "type_alias", name, begin, s.statement(begin))
        elif not body:
            continue
        else:
            s.add(name, kinds.get(word, "function"), name, begin, body[1], word == "class")
        if word == "class":
            for c in s.at_depth(_BEGIN + r"((?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?[ \t]*(#?[\w$]+)\s*(?:<[^>(]*>)?)(?=\()", body[0] + 1, body[1], 1):
                if inner := s.block(s.closing.get(c.end(), body[1] - 1) + 1 if c.end() in s.closing else c.end()):
                    s.add(c[2], "method", f"{name}.{c[2]}", c.start(1), inner[1])
        if m[1] and m[4]:
            s.exports.append("default" if m[2] else name)
    for m in s.at_depth(_BEGIN + r"(?:import\b(?!\s*\()|export\s*(?:type\s*)?(?=[{*])|export\s+default\s+([\w$]+)\s*(?:;|$))", 0, len(s.code), 0):
        end = s.statement(m.end())
        names = re.match(r"\s*\{([^}]*)\}", s.code[m.end() : end])
        if "export" in m[0]:
            s.exports += ["default"] if m[1] and m[1] not in ("function", "class", "async") else [n.split()[0] for n in names[1].split(",") if n.strip()] if names else []
        s.imports += _last_string(s.text[m.end() : end]) if not m[1] else []


def read_rust(s: Source, begin: int = 0, end: int | None = None, scope: str = "", only_methods: bool = False) -> None:
    end = len(s.code) if end is None else end
    kinds = {"struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "type": "type_alias", "const": "constant", "static": "constant"}
    inside = lambda name: f"{scope}.{name}" if scope else name
    for m in s.at_depth(_BEGIN + r"((?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s*_+)?)\s+)*(fn|struct|enum|trait|impl|type|const|static|use|mod)\b)\s*(?:mut\s+)?(\w*)", begin, end, s.depth(begin)):
        word, name, body = m[2], m[3], s.block(m.start(1))
        semicolon = min(s.first(";", m.end()) + 1, len(s.code))
        if word == "fn":
            if body:
                s.add(name, "method" if scope else "function", inside(name), m.start(1), body[1])
        elif only_methods:
            continue
        elif word == "use":
            s.imports.append(s.text[m.end(2) : semicolon].rstrip(";").strip())
        elif word == "mod":
            if body:
                read_rust(s, body[0] + 1, body[1] - 1, inside(name))
            else:
                s.imports.append(name)
        elif word == "impl" and body:
            head, level, cut = s.text[m.end(2) : body[0]].strip(), 0, 0
            if head.startswith("<"):
                for cut, c in enumerate(head, 1):
                    level += (c == "<") - (c == ">")
                    if not level:
                        break
            head = re.split(r"\bwhere\b", head[cut:])[0].strip()
            trait, _, kind = (x.strip() for x in re.sub(r"\bfor\b(?!\s*<)", "\0", head).partition("\0"))
            s.add(f"{kind} for {trait}" if kind else trait, "impl", inside(kind or trait), m.start(1), body[1], True)
            read_rust(s, body[0] + 1, body[1] - 1, inside(kind or trait), True)
        elif body or word in ("struct", "type", "const", "static"):
            s.add(name, kinds[word], inside(name), m.start(1), body[1] if body and word not in ("type", "const", "static") else semicolon, word in ("struct", "trait"))
            if word == "trait" and body:
                read_rust(s, body[0] + 1, body[1] - 1, inside(name), True)


def read_python(s: Source, begin: int = 0, end: int | None = None, scope: str = "", decorated: bool = True) -> None:
    """The statements of one block: those as far in as its first one, outside of brackets."""
    end = len(s.code) if end is None else end
    starts = [m for m in re.compile(r"^[ \t]*(?=\S)", re.M).finditer(s.code, begin, end) if s.depth(m.start()) == 0 and m.start() >= begin]
    width = min((len(m[0].expandtabs()) for m in starts), default=0) if not scope else (len(starts[0][0].expandtabs()) if starts else 0)
    rows = [m for m in starts if len(m[0].expandtabs()) <= width]
    above = None
    for m, after in zip(rows, [*(r.start() for r in rows[1:]), end]):
        at, close = m.end(), m.start() + len(s.code[m.start() : after].rstrip())
        if s.code[at] == "@":
            above = at if above is None else above
            continue
        from_, above = (at if above is None else above), None
        if d := re.compile(r"(?:async\s+def|def|class)\s+(\w+)").match(s.code, at):
            name, is_class = d[1], d[0].startswith("class")
            chain = f"{scope}.{name}" if scope else name
            if scope and (is_class or (from_ != at and not decorated)):
                continue
            s.add(name, "class" if is_class else "method" if scope else "function", chain, from_, close, is_class)
            if is_class:
                body = s.first(":", d.end()) + 1
                read_python(s, s.code.find("\n", body, close) + 1 or close, close, chain, from_ == at)
        elif not scope and (d := re.compile(r"from\s+(\.*)\s*([\w.]*)\s+import\b").match(s.code, at)):
            s.imports.append(d[1] + d[2])
        elif not scope and (d := re.compile(r"import\s+([^\n;]+)").match(s.code, at)):
            s.imports += [n.split()[0] for n in d[1].split(",") if n.strip()]


READERS = {"typescript": read_typescript, "python": read_python, "rust": read_rust}


def read_file(text: str | None, language: str | None) -> tuple[list[tuple], list[str], list[str]]:
    if not text or language not in READERS:
        return [], [], []
    s = Source(text, language)
    READERS[language](s)
    return s.symbols, s.imports, s.exports


def outlines(files: DataFrame, key: str, path: str, text: str = "content") -> DataFrame:
    """(key, path, language, symbols, imports, exports) of every file of a known language."""

    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, languages in batches:
            yield pd.DataFrame([read_file(t, k) for t, k in zip(texts, languages)], columns=["symbols", "imports", "exports"])

    known = files.select(key, F.replace(F.col(path), F.lit("\\"), F.lit("/")).alias("path"), language_of(F.col(path)).alias("language"), F.col(text).alias("_text")).where("language IS NOT NULL")
    return known.select(key, "path", "language", F.pandas_udf(read, FOUND)("_text", "language").alias("o")).select(key, "path", "language", "o.*")


def symbols(files: DataFrame, key: str, path: str, text: str = "content") -> DataFrame:
    """(key, path, language, symbol_name, symbol_type, scope_chain, start_line, end_line, is_overview, content): a row for each symbol."""
    return outlines(files, key, path, text).select(key, "path", "language", F.explode("symbols").alias("s")).select(key, "path", "language", "s.*")
