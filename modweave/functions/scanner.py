"""Import and export statements of JavaScript and TypeScript sources, as an Arrow table function.

A source is read as Latin-1, so that one character is one byte and all offsets are byte offsets. Regular expressions
jump from one place of interest to the next; only statements themselves are read token by token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_BLANK = re.compile(r"[ \t\n\r]*")
_GAP = re.compile(r"(?:[ \t\n\r]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?)*")
_NAME = re.compile(r"[0-9A-Za-z_]+")
_COMMENT = re.compile(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?")
_QUOTED = {q: re.compile(rf"{q}(?:\\.|[^\\{q}])*(?:{q}|\\?\Z)", re.S) for q in "'\"`"}
_LITERAL = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n\r])*\]|[^\[/\\\n\r])+/[\w$]*")
_INSIDE = re.compile(r"[{}'\"`/]|(?:import|require)(?![0-9A-Za-z_])")
_TOP = re.compile(r"[{'\"`/]|(?:import|export|require|declare)(?![0-9A-Za-z_])")
_BRACES = re.compile(r"[{}]|'(?:\\.|[^\\'])*'?|\"(?:\\.|[^\\\"])*\"?|`(?:\\.|[^\\`])*`?|" + _COMMENT.pattern, re.S)
_FROM = re.compile(r"from(?![0-9A-Za-z_])|" + _COMMENT.pattern)
_FROM_OR_NEXT = re.compile(r"(?:from|import|export|require)(?![0-9A-Za-z_])|" + _COMMENT.pattern)
_TYPES_ONLY = re.compile(r"\{[ \t\n\r]*(?:type[ \t\n\r][^,}]*(?:,[ \t\n\r]*|(?=\})))*\}")
_LOCAL = re.compile(r"const|function|default|class|async|let|var|enum|interface")
_BEFORE_LITERAL = frozenset("return typeof instanceof in of new delete void do else yield await case".split())


@dataclass
class Keyword:
    name: str
    alias: str = ""
    start: int = 0
    end: int = 0
    position: int = 0
    comma_after: int = 0
    is_type: bool = False


@dataclass
class Import:
    request: str = ""
    kind: str = "mixed"
    start: int = 0
    end: int = 0
    is_dynamic: bool = False
    is_local_export: bool = False
    export: tuple[int, int, int, int, int, int] | None = None  # key start, key end, decl start, brace start, brace end, statement end
    keywords: list[Keyword] | None = field(default=None)


class _Scan:
    def __init__(self, text: str, ignore_types: bool, detailed: bool):
        self.t, self.n, self.ignore_types, self.detailed = text, len(text), ignore_types, detailed
        self.out: list[Import] = []

    # --- small readers --------------------------------------------------------------------------------------------

    def blank(self, i: int) -> int:
        return _BLANK.match(self.t, i).end()

    def gap(self, i: int) -> int:
        return _GAP.match(self.t, i).end()

    def at(self, i: int) -> str:
        return self.t[i] if i < self.n else ""

    def word(self, i: int, w: str) -> bool:
        e = i + len(w)
        return self.t.startswith(w, i) and not _NAME.match(self.t, e)

    def alone(self, i: int) -> bool:
        """No member access and no longer name: what stands before a word."""
        if i == 0:
            return True
        c = self.t[i - 1]
        if c == "." or _NAME.match(c):
            return False
        if c in " \t":
            head = self.t[max(0, i - 200) : i].rstrip(" \t")
            return not head.endswith(".")
        return True

    def quoted(self, i: int) -> int:
        """Past a string with escapes."""
        return _QUOTED[self.t[i]].match(self.t, i).end()

    def string(self, i: int) -> tuple[str, int, int, int]:
        """A module string: up to its quote, escapes or not."""
        end = self.t.find(self.t[i], i + 1)
        return ("", self.n, 0, 0) if end < 0 else (self.t[i + 1 : end], end + 1, i + 1, end)

    def identifier(self, i: int) -> tuple[str, int]:
        m = _NAME.match(self.t, i)
        return (m[0], m.end()) if m else ("", i)

    def call(self, i: int) -> tuple[str, int, int, int]:
        """The string argument of ``(...)``; anything but strings, parentheses and comments in it gives none."""
        i = self.blank(i)
        if self.at(i) != "(":
            return "", i + 1, 0, 0
        depth, i, text, span = 1, i + 1, "", None
        while i < self.n:
            c = self.t[i]
            if c in "'\"":
                end = self.t.find(c, i + 1)
                end = self.n if end < 0 else end
                text += self.t[i + 1 : end]
                span = (i + 1, end) if end < self.n else None
                i = end + 1
            elif c == "(":
                depth, i = depth + 1, i + 1
            elif c == ")":
                depth, i = depth - 1, i + 1
                if not depth:
                    break
            else:
                j = self.gap(i)
                if j == i:
                    return "", i, 0, 0
                i = j
        return (text, min(i, self.n), *span) if span else (text, min(i, self.n), 0, 0)

    def literal_allowed(self, i: int) -> bool:
        """Whether a slash may begin a regular expression, by what stands before it."""
        head = self.t[max(0, i - 200) : i].rstrip(" \t\n\r")
        if not head:
            return True
        if head[-1] in ")]}'\"`":
            return False
        m = re.search(r"[0-9A-Za-z_$]+$", head)
        return m[0] in _BEFORE_LITERAL if m else True

    def slash(self, i: int) -> int:
        """Past a comment, a regular expression or a division sign."""
        if self.t.startswith(("//", "/*"), i):
            return _COMMENT.match(self.t, i).end()
        if self.literal_allowed(i) and (m := _LITERAL.match(self.t, i)):
            return m.end()
        return i + 1

    def body(self, i: int) -> int:
        """Past the block that begins at the next brace."""
        depth = 0
        for m in _BRACES.finditer(self.t, i):
            if m[0] == "{":
                depth += 1
            elif m[0] == "}" and depth:
                depth -= 1
                if not depth:
                    return m.end()
        return self.n

    def names(self, i: int, types: bool, commas: bool) -> tuple[list[Keyword], int]:
        """A list in braces; ``i`` is at its brace."""
        out: list[Keyword] = []
        i += 1
        while i < self.n:
            i = self.gap(i)
            if self.at(i) in ("}", ""):
                return out, i + 1
            start, is_type = i, types
            if self.word(i, "type") and i + 4 < self.n:
                j = self.gap(i + 4)
                if self.at(j) in ("'", '"') and self.at(j) or _NAME.match(self.t, j):
                    is_type, i = True, j
            if self.at(i) in ("'", '"'):
                name, i, _, _ = self.string(i)
                end = i = self.gap(i)
            else:
                name, j = self.identifier(i)
                if not name:
                    i = j + 1
                    continue
                end, i = j, self.gap(j)
            alias = ""
            if self.word(i, "as"):
                alias, i = self.identifier(self.gap(i + 2))
                end = i
            out.append(Keyword(name, alias, start, end, len(out), 0, is_type))
            i = self.gap(i)
            if self.at(i) == ",":
                if commas:
                    out[-1].comma_after = i
                i += 1
        return out, i

    def star(self, i: int, types: bool, position: int, bare: bool) -> tuple[list[Keyword], int]:
        """``* as name``, and where ``bare`` also ``*``."""
        j = self.gap(i + 1)
        if self.word(j, "as"):
            alias, k = self.identifier(self.gap(j + 2))
            return ([Keyword("*", alias, i, k, position, 0, types)] if alias or bare else []), k
        return ([Keyword("*", "", i, i + 1, position, 0, types)] if bare else []), j

    def import_names(self, i: int, types: bool) -> tuple[list[Keyword] | None, int]:
        i = self.gap(i)
        c = self.at(i)
        if not c:
            return [], i
        if c in "\"'(":
            return None, i
        if c == "*":
            return self.star(i, types, 0, False)
        if c == "{":
            out, i = self.names(i, types, False)
            return out, self.gap(i)
        name, j = self.identifier(i)
        if not name:
            return None, i
        out = [Keyword("default", name, i, j, 0, 0, types)]
        i = self.gap(j)
        if self.at(i) == ",":
            i = self.gap(i + 1)
            if self.at(i) == "*":
                more, i = self.star(i, types, 1, False)
                out += more
            elif self.at(i) == "{":
                more, i = self.names(i, types, False)
                for k, kw in enumerate(more):
                    kw.position = k + 1
                out += more
                i = self.gap(i)
        return out, i

    # --- statements -----------------------------------------------------------------------------------------------

    def dynamic(self, i: int, kind: str = "mixed") -> int:
        request, end, a, b = self.call(i)
        if request:
            self.out.append(Import(request, kind, a, b, True))
        return end

    def require(self, i: int) -> int:
        i += 7
        return self.dynamic(i) if self.at(i) == "(" or self.blank(i) > i else i

    def import_(self, i: int) -> int:
        i += 6
        if i >= self.n or self.t[i] not in " \t\n\r{\"'*(":
            return i
        i, kind, types = self.blank(i), "mixed", False
        if self.word(i, "type"):
            kind, types, i = "only_type", True, self.blank(i + 4)
        c = self.at(i)
        if c and c in "\"'":
            request, end, a, b = self.string(i)
            if request:
                self.out.append(Import(request, kind, a, b))
            return end
        if c == "(":
            return self.dynamic(i, kind)
        keywords = None
        begin = i
        if self.detailed:
            keywords, after = self.import_names(i, types)
        if kind == "mixed" and c == "{" and _TYPES_ONLY.match(self.t, i):
            kind = "only_type"
        if keywords is not None:
            begin = self.gap(after)
        for m in _FROM.finditer(self.t, begin):
            if m[0] == "from" and self.alone(m.start()):
                i = self.blank(m.end())
                if self.at(i) in ("'", '"'):
                    request, end, a, b = self.string(i)
                    if request and not (self.ignore_types and kind == "only_type"):
                        self.out.append(Import(request, kind, a, b, keywords=keywords or None))
                    return end
                return i
        # no ``from`` at all: take a string on this line
        i = begin
        while i < self.n and self.t[i] not in ";\n\r":
            if self.t.startswith(("//", "/*"), i):
                i = _COMMENT.match(self.t, i).end()
            elif self.t[i] in "'\"":
                request, i, a, b = self.string(i)
                if request:
                    self.out.append(Import(request, kind, a, b, keywords=keywords or None))
                break
            else:
                i += 1
        return i

    def local_name(self, i: int) -> tuple[Keyword | None, int]:
        """The one name that a declaration exports."""
        i = self.gap(i)
        if self.word(i, "default"):
            return Keyword("default", "", i, i + 7), i + 7
        m = re.compile(r"(async(?![0-9A-Za-z_])(?=(?:" + _GAP.pattern + r")function))?").match(self.t, i)
        j = self.gap(m.end()) if m[0] else i
        for w in ("const", "let", "var", "function", "class", "namespace", "module", "enum", "type", "interface"):
            if self.word(j, w):
                j = self.gap(j + len(w))
                if w == "function" and self.at(j) == "*":
                    j = self.gap(j + 1)
                name, end = self.identifier(j)
                return (Keyword(name, "", j, end, is_type=w in ("type", "interface")), end) if name else (None, j)
        return None, i

    def local(self, kw: Keyword | None, kind: str, key: tuple[int, int], decl: int) -> None:
        if kw:
            self.out.append(Import(kind=kind, is_local_export=True, export=(*key, decl, 0, 0, 0), keywords=[kw]))

    def semicolon(self, i: int) -> int:
        j = i
        while self.at(j) in (" ", "\t"):
            j += 1
        return j + 1 if self.at(j) == ";" else i

    def type_end(self, i: int) -> int:
        """The end of a type declaration: a semicolon or line end outside of all brackets."""
        depth = {"{": 0, "(": 0, "[": 0}
        opens = {"}": "{", ")": "(", "]": "["}
        while i < self.n:
            c = self.t[i]
            if self.t.startswith(("//", "/*"), i):
                i = _COMMENT.match(self.t, i).end()
                continue
            if c in "'\"`":
                i = self.quoted(i)
                continue
            if c in depth:
                depth[c] += 1
            elif c in opens and depth[opens[c]]:
                depth[opens[c]] -= 1
            if not any(depth.values()):
                if c == ";":
                    return i + 1
                if c in "\n\r":
                    return i
            i += 1
        return i

    def export_(self, i: int) -> int:
        key = i
        i += 6
        if i >= self.n or self.t[i] not in " \t\n\r{*":
            return i
        i = self.blank(i)
        span = (key, i)
        star = i if self.at(i) == "*" else -1
        if star >= 0:
            i = self.blank(i + 1)
            if self.t.startswith("as", i):
                i = self.blank(i + 2)
        j = self.gap(i + 7) if self.word(i, "declare") else i
        if self.word(j, "namespace") or self.word(j, "module") and _NAME.match(self.t, self.gap(j + 6)):
            if self.detailed:
                self.local(self.local_name(i)[0], "mixed", span, span[1])
            brace = self.t.find("{", i)
            return self.n if brace < 0 else self.body(brace)
        if _LOCAL.match(self.t, i):
            if self.detailed:
                kw, end = self.local_name(i)
                self.local(kw, "mixed", span, self.gap(end) if kw and kw.name == "default" else span[1])
            return i
        kind, types = "mixed", False
        if self.word(i, "type"):
            kind, types, word = "only_type", True, i
            i = self.blank(i + 4)
            if self.at(i) not in ("{", "*"):
                if self.detailed:
                    end = self.type_end(i)
                    after = self.gap(end)
                    if not (self.word(after, "import") and self.alone(after)):
                        self.local(self.local_name(word)[0], kind, span, span[1])
                    return end
                return i
        keywords, braces = None, (0, 0)
        if self.detailed:
            if star >= 0:
                keywords, _ = self.star(star, types, 0, True)
            elif self.at(i) == "{":
                keywords, after = self.names(i, types, True)
                braces = (i, after)
                j = self.gap(after)
                if not (self.word(j, "from") and self.alone(j)):
                    if not types and keywords:
                        self.out.append(Import(kind=kind, is_local_export=True, export=(*span, span[1], *braces, self.semicolon(after)), keywords=keywords))
                    return after
        if kind == "mixed" and self.at(i) == "{" and _TYPES_ONLY.match(self.t, i):
            kind = "only_type"
        for m in _FROM_OR_NEXT.finditer(self.t, i):
            if m[0][0] == "/" or not self.alone(m.start()):
                continue
            if m[0] != "from":
                return m.start()
            i = self.blank(m.end())
            if self.at(i) in ("'", '"'):
                request, end, a, b = self.string(i)
                if request:
                    export = (*span, span[1], *braces, self.semicolon(end)) if self.detailed else None
                    self.out.append(Import(request, kind, a, b, export=export, keywords=keywords or None))
                return end
            return i
        return self.n

    def declare(self, i: int) -> int:
        """Past the body of an ambient module, global or namespace; else past the word."""
        j = self.blank(i + 7)
        if not any(self.word(j, w) for w in ("module", "global", "namespace")):
            return i + 1
        while j < self.n and self.t[j] != "{":
            j = _COMMENT.match(self.t, j).end() if self.t.startswith(("//", "/*"), j) else j + 1
        return self.body(j) if j < self.n else j

    def run(self) -> list[Import]:
        i, depth = 0, 0
        while True:
            m = (_INSIDE if depth else _TOP).search(self.t, i)
            if not m:
                return self.out
            i, c = m.start(), m[0]
            if c == "{":
                depth, i = depth + 1, i + 1
            elif c == "}":
                depth, i = depth - 1, i + 1
            elif c == "/":
                i = self.slash(i)
            elif c in "'\"`":
                i = self.quoted(i)
            elif c == "declare":
                before = self.t[i - 1 : i]
                i = i + 1 if before and _NAME.match(before) else self.declare(i)
            elif not self.alone(i):
                i += 1
            elif depth and c == "import":
                j = self.blank(i + 6)
                i = self.dynamic(j) if self.at(j) == "(" else j
            elif c == "require":
                i = max(self.require(i), i + 1)
            else:
                i = max(self.import_(i) if c == "import" else self.export_(i), i + 1)


_SCRIPT = re.compile(r"<script(?![A-Za-z0-9:_-])([^>]*)>(.*?)</script>", re.S | re.I)
_MODULE = re.compile(r"(?<![A-Za-z0-9:_-])context\s*=\s*(?:\"module\"|'module'|module(?![^\s>]))", re.I)
_PROP = re.compile(r"(?<![A-Za-z0-9_$])export(?=[ \t\n\r]+let(?![A-Za-z0-9_$]))", re.I)


def mask_sfc(text: str, svelte: bool = False) -> str:
    """A single-file component with all but its scripts blanked, places kept; in Svelte, props are no exports."""
    out, at = [], 0
    blank = lambda s: re.sub(r"[^\n\r]", " ", s)
    for m in _SCRIPT.finditer(text):
        code = m[2] if not svelte or _MODULE.search(m[1]) else _PROP.sub("exporx", m[2])
        out += [blank(text[at : m.start(2)]), code]
        at = m.end(2)
    return "".join([*out, blank(text[at:])])


def scan(content: bytes, path: str = "", ignore_types: bool = False, detailed: bool = False) -> list[Import]:
    """The imports and exports of one source, in order."""
    text = content.decode("latin-1")
    if path.endswith((".vue", ".svelte")):
        text = mask_sfc(text, path.endswith(".svelte"))
    return _Scan(text, ignore_types, detailed).run()


def _utf8(s: str) -> str:
    return s.encode("latin-1").decode("utf-8", "replace")


_KEYWORD = pa.struct([("name", pa.string()), ("alias", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("position", pa.int32()), ("comma_after", pa.int32()), ("is_type", pa.bool_())])
_EXPORT = pa.struct([(c, pa.int32()) for c in ("key_start", "key_end", "decl_start", "brace_start", "brace_end", "stmt_end")])
IMPORTS = (
    "path string, seq int, request string, kind string, is_dynamic boolean, is_local_export boolean, request_start int, request_end int, "
    "export struct<key_start:int,key_end:int,decl_start:int,brace_start:int,brace_end:int,stmt_end:int>, "
    "keywords array<struct<name:string,alias:string,start:int,end:int,position:int,comma_after:int,is_type:boolean>>"
)


def scan_imports(files: DataFrame, detailed: bool = True, ignore_types: bool = False) -> DataFrame:
    """The ``imports`` relation of ``files(path, content)``; each task reads its own files, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(10)]
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                for seq, x in enumerate(scan(content or b"", path or "", ignore_types, detailed)):
                    e = dict(zip([f.name for f in _EXPORT], x.export)) if x.export else None
                    k = [{**vars(w), "name": _utf8(w.name), "alias": _utf8(w.alias)} for w in x.keywords] if x.keywords is not None else None
                    for c, v in zip(cols, (path, seq, _utf8(x.request), x.kind, x.is_dynamic, x.is_local_export, x.start, x.end, e, k)):
                        c.append(v)
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), _EXPORT, pa.list_(_KEYWORD)]
            names = ["path", "seq", "request", "kind", "is_dynamic", "is_local_export", "request_start", "request_end", "export", "keywords"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return files.select("path", "content").mapInArrow(run, IMPORTS)


# --- comments and templates ----------------------------------------------------------------------------------------

_CODE = re.compile(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?|'(?:\\.|[^\\'\n])*'?|\"(?:\\.|[^\\\"\n])*\"?|`(?:\\.|[^\\`])*`?", re.S)
_TEMPLATE = re.compile(r"([\w$.]+)?`(?:\\.|[^\\`])*`?", re.S | re.A)


def strip_comments(code: str) -> str:
    """Without comments; strings and templates stay."""
    return _CODE.sub(lambda m: "" if m[0][0] == "/" else m[0], code)


def strip_templates(code: str) -> str:
    """Without comments and tagged templates; their tags stay.

    A tag is a name right before the template that no other name goes before: ``return f`` isn't one.
    """
    code = strip_comments(code)

    def kept(m: re.Match) -> str:
        before = code[: m.start()].rstrip(" \t\n\r")[-1:] if m[1] else "x"
        return m[0] if before and re.match(r"[\w$]", before, re.A) else m[1]

    return _TEMPLATE.sub(kept, code)


def line_counts(content: bytes) -> tuple[int, int, int]:
    """Lines as they are, without comments, and without tagged templates too; of two line ends in a row one counts."""
    text = content.decode("latin-1")
    return tuple(t.replace("\n\n", "\n").count("\n") for t in (text, strip_comments(text), strip_templates(text)))
