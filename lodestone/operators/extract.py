"""Imports, exports, re-exports, symbols and signatures of JavaScript and TypeScript sources.

A scanner cuts a source into tokens (names, strings, templates, regular expressions, marks; comments fall away), and one walk
over the statements of the top level reads declarations from their first tokens. Sources are parsed in Arrow batches, a file a
row. Reference counts are approximate: uses of a name minus its declarations, without scopes."""

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")
SCHEMA = "imports array<struct<source:string,name:string,kind:string>>, exports array<struct<name:string,kind:string>>, reexports array<struct<source:string,local:string,exported:string>>, symbols array<struct<name:string,is_exported:boolean,reference_count:long>>, signatures array<string>, failed boolean"
MOST = 100

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|\#![^\n]*)
    |(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)
    |(?P<name>[^\W\d][\w$]*|\$[\w$]*|\#[\w$]+)
    |(?P<number>\d[\w.]*)
    |(?P<mark>=>|\.\.\.|\?\?=?|\?\.|[-+*/%&|^!=<>]=+|&&=?|\|\|=?|\+\+|--|.)""",
    re.X | re.S,
)
#: After these a slash begins a regular expression.
_BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await", "default"}
_PATTERN = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int


@dataclass
class Analysis:
    imports: list = field(default_factory=list)
    exports: list = field(default_factory=list)
    reexports: list = field(default_factory=list)
    symbols: list = field(default_factory=list)
    signatures: list = field(default_factory=list)


def _template(text: str, at: int, out: list) -> int:
    """Skips a template literal whose ` is at `at`; tokens of its ${...} parts go to out."""
    i = at + 1
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif text.startswith("${", i):
            i = _scan(text, i + 2, out, "}")
        else:
            i += 1
    return i


def _scan(text: str, at: int, out: list, until: str | None = None) -> int:
    depth = 0
    while at < len(text):
        c = text[at]
        if c == "`":
            out.append(Token("template", "`", at))
            at = _template(text, at, out)
            continue
        if c == "/" and text[at + 1 : at + 2] not in ("/", "*"):
            last = out[-1] if out else None
            operand = last and (last.kind in ("number", "string", "template") or last.text in (")", "]", "}") or last.kind == "name" and last.text not in _BEFORE_PATTERN)
            m = None if operand else _PATTERN.match(text, at)
            if m:
                out.append(Token("pattern", m.group(), at))
                at = m.end()
                continue
        m = _TOKEN.match(text, at)
        kind = m.lastgroup
        if kind != "skip":
            if until:
                if m.group() == "{":
                    depth += 1
                elif m.group() == until:
                    if not depth:
                        return m.end()
                    depth -= 1
            out.append(Token(kind, m.group(), at))
        at = m.end()
    return at


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    _scan(text, 0, out)
    return out


def truncate(text: str, limit: int) -> str:
    """The longest prefix of whole characters in `limit` bytes."""
    return text.encode()[:limit].decode(errors="ignore")


def line_of(text: str, at: int) -> int:
    """0-based line of a character."""
    return text.count("\n", 0, at)


_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_STARTS = {"import", "export", "function", "class", "interface", "type", "enum", "const", "let", "var", "async", "abstract", "declare", "namespace", "module", "if", "for", "while", "return", "switch", "try", "throw"}

#: After these a line goes on with the statement.
_GOES_ON = ("export", "default", "async", "abstract", "declare", "=", "=>", ",", "|", "&", "(", "extends")


def statements(toks: list[Token], text: str) -> list[list[Token]]:
    """The top-level statements: cut at ; outside brackets, after a block that ends one, and before a line that starts one."""
    out, now, depth = [], [], 0
    for i, t in enumerate(toks):
        if not depth and now and t.text in _STARTS and t.kind == "name" and "\n" in text[now[-1].at : t.at] and now[-1].text not in _GOES_ON:
            out.append(now)
            now = []
        now.append(t)
        if t.text in _OPEN and t.kind == "mark":
            depth += 1
        elif t.text in _CLOSE and t.kind == "mark":
            depth = max(0, depth - 1)
            if not depth and t.text == "}":
                words = [x.text for x in now[:4] if x.kind == "name"]
                following = toks[i + 1].text if i + 1 < len(toks) else ""
                if {"function", "class", "interface", "enum", "namespace", "module"} & set(words) and not {"const", "let", "var", "type"} & set(words[:2]) and following not in (".", "("):
                    out.append(now)
                    now = []
        elif t.text == ";" and not depth:
            out.append(now)
            now = []
    return [s for s in [*out, now] if s and s[0].text != ";"]


def _string(t: Token) -> str:
    return t.text[1:-1] if len(t.text) > 1 and t.text[-1] == t.text[0] else t.text[1:]


def _braced(toks: list[Token]):
    """(local, other) names of { a, b as c, type d } up to its end, and the place after it; toks[0] is the {."""
    pairs, now, i = [], [], 1
    while i < len(toks) and toks[i].text != "}":
        if toks[i].text == ",":
            pairs.append(now)
            now = []
        else:
            now.append(toks[i])
        i += 1
    pairs.append(now)
    out = []
    for p in pairs:
        names = [_string(x) if x.kind == "string" else x.text for x in p]
        if len(names) > 1 and names[0] == "type" and names[1] != "as":
            names = names[1:]
        if names:
            out.append((names[0], names[2] if len(names) > 2 and names[1] == "as" else names[0]))
    return out, i + 1


def _import(s: list[Token], out: Analysis, bound: list):
    if len(s) > 1 and (s[1].text == "(" or s[1].text == "." or s[1].kind == "string"):
        return
    i = 1
    if len(s) > 2 and s[1].text == "type" and s[2].text not in ("from", ","):
        i = 2
    source = next((_string(t) for a, t in zip(s, s[1:]) if a.text == "from" and t.kind == "string"), None)
    if source is None:
        return
    while i < len(s) and s[i].text != "from":
        t = s[i]
        if t.text == "*":
            out.imports.append((source, "*", "Namespace"))
            bound.append(s[i + 2].text if len(s) > i + 2 else "*")
            i += 3
        elif t.text == "{":
            pairs, n = _braced(s[i:])
            for name, local in pairs:
                out.imports.append((source, name, "Named"))
                bound.append(local)
            i += n
        elif t.text == ",":
            i += 1
        else:
            out.imports.append((source, t.text, "Default"))
            bound.append(t.text)
            i += 1


def _function_line(text: str, name: str, at: int) -> str:
    lines = text.split("\n")
    here = line_of(text, at)
    for line in lines[max(0, here - 1) : here + 3]:
        if f"function {name}" in line or f"function* {name}" in line or f"function *{name}" in line:
            return truncate(line.split("{")[0].strip(), MOST)
    return f"function {name}(...)"


def _variables(s: list[Token]) -> list[str]:
    """Names declared by const, let or var at s[0]; destructured ones are left out."""
    names, depth, wait = [], 0, True
    for t in s[1:]:
        if t.kind == "mark" and t.text in _OPEN:
            depth += 1
        elif t.kind == "mark" and t.text in _CLOSE:
            depth -= 1
        elif not depth and wait and t.kind == "name":
            names.append(t.text)
        elif not depth and t.text == ",":
            wait = True
            continue
        wait = False
    return names


def _declared(s: list[Token], text: str):
    """(names, kind, signatures) of a declaration, or None."""
    while s and s[0].text in ("declare", "abstract", "async") and len(s) > 1 and s[1].kind == "name":
        s = s[1:]
    if not s:
        return None
    word, name = s[0].text, next((t.text for t in s[1:4] if t.kind == "name"), None)
    if word == "function" and name:
        return [name], "Function", [_function_line(text, name, s[0].at)]
    if word == "class" and name:
        return [name], "Class", [f"class {name}"]
    if word == "interface" and name:
        return [name], "Interface", [f"interface {name}"]
    if word == "const" and len(s) > 2 and s[1].text == "enum":
        return [s[2].text], "Enum", [f"enum {s[2].text}"]
    if word == "enum" and name:
        return [name], "Enum", [f"enum {name}"]
    if word == "type" and name and len(s) > 2 and s[2].text in ("=", "<"):
        return [name], "TypeAlias", [f"type {name}"]
    if word in ("const", "let", "var"):
        names = _variables(s)
        return names, "Variable", [f"{word} {n}" for n in names]
    return None


def analyze(path: str, text: str) -> Analysis:
    """Everything that the index keeps of a source; an unknown ending is an error."""
    if not path.endswith(SUFFIXES):
        raise ValueError(f"not a known kind of source: {path}")
    out, roots, bound, uses = _by_lines(text) or _whole(text)
    exported = {n for n, k in out.exports if k != "Default"}
    counts: dict[str, int] = {}
    for n in uses:
        counts[n] = counts.get(n, 0) + 1
    out.symbols = [(n, n in exported, max(0, counts.get(n, 0) - 1)) for n in dict.fromkeys([*bound, *roots])]
    return out


def _whole(text: str):
    """(analysis without symbols, names declared, names imported, names used) of a text."""
    toks = tokens(text)
    out, roots, bound = Analysis(), [], []
    lines = text.split("\n")
    for s in statements(toks, text):
        word = s[0].text
        if word == "import":
            _import(s, out, bound)
        elif word == "export" and len(s) > 1:
            _export(s, text, out, roots)
        elif (found := _declared(s, text)) is not None:
            names, kind, signs = found
            roots += names
            out.signatures += [truncate(lines[line_of(text, s[0].at)].strip(), MOST)] if kind == "TypeAlias" else signs
    return out, roots, bound, [t.text for i, t in enumerate(toks) if t.kind == "name" and not (i and toks[i - 1].text in (".", "?."))]


#: A line's digits, and characters that the scanner takes for digits too: a line is analysed once for all numbers in it.
_DIGITS, _STAND_INS = re.compile("([0-9]+)"), [chr(c) for c in range(0x1D7CE, 0x1D800)]
_SHAPES: dict = {}
_MOST_SHAPES = 20_000
_PROBE = "const probe = 1;"


def _shape(parts: list[str]):
    """What lines of these parts with any digits between them give, if each is a statement or more by itself whatever plain lines stand around it; else None.

    That is: it starts with a word that starts a statement, ends outside strings, templates and brackets, and not with a mark that goes on."""
    if len(parts) > len(_STAND_INS):
        return None
    line = "".join(p + d for p, d in zip(parts, [*_STAND_INS[: len(parts) - 1], ""], strict=True))
    if len(line.encode()) > MOST or "\\" in line or "/*" in line:
        return None
    toks = tokens(line)
    depth = 0
    for t in toks:
        depth += (t.text in _OPEN) - (t.text in _CLOSE) if t.kind == "mark" else 0
        if depth < 0:
            return None
    if toks and (depth or toks[0].kind != "name" or toks[0].text not in _STARTS or toks[-1].text in _GOES_ON or toks[-1].text in (".", "?.")):
        return None
    if [(t.kind, t.text) for t in tokens(f"{line}\n{_PROBE}")] != [(t.kind, t.text) for t in [*toks, *tokens(_PROBE)]]:
        return None
    try:
        out, roots, bound, uses = _whole(line)
    except (ValueError, AttributeError, IndexError, RecursionError):
        return None
    # signatures of functions look for their line among those around: it must be this one
    functions = [m for s in out.signatures if "function" in s for m in re.findall(r"function\b[* ]*([\w$]+)", s)]
    if any("function" in s and "(...)" in s for s in out.signatures):
        return None
    lists = [out.imports, out.exports, out.reexports, [(x,) for x in out.signatures], [(x,) for x in roots], [(x,) for x in bound], [(x,) for x in uses], [(x,) for x in functions]]
    flat = "\x1f".join(str(x) for rows in lists for r in rows for x in r)
    form = flat.replace("{", "{{").replace("}", "}}")
    for i, c in enumerate(_STAND_INS[: len(parts) - 1]):
        form = form.replace(c, f"{{{i}}}")
    ends, at = [], 0
    for rows in lists:
        at += sum(map(len, rows))
        ends.append(at)
    return form, ends


def _by_lines(text: str):
    """As _whole, for a text each of whose lines stands by itself; else None."""
    if not text.isascii() or "\x1f" in text:
        return None
    out, roots, bound, uses, before = Analysis(), [], [], [], ""
    for line in text.split("\n"):
        if len(line) > MOST:
            return None
        parts = _DIGITS.split(line)
        key = tuple(parts[::2])
        found = _SHAPES.get(key, 0)
        if found == 0:
            if len(_SHAPES) >= _MOST_SHAPES:
                _SHAPES.clear()
            found = _SHAPES[key] = _shape(parts[::2])
        if found is None:
            return None
        form, (a, b, c, d, e, f, g, h) = found
        if h:
            flat = form.format(*parts[1::2]).split("\x1f")
            if a:
                out.imports += zip(flat[0:a:3], flat[1:a:3], flat[2:a:3])
            if b > a:
                out.exports += zip(flat[a:b:2], flat[a + 1 : b : 2])
            if c > b:
                out.reexports += zip(flat[b:c:3], flat[b + 1 : c : 3], flat[b + 2 : c : 3])
            out.signatures += flat[c:d]
            roots += flat[d:e]
            bound += flat[e:f]
            uses += flat[f:g]
            if h > g and "function" in before and any(f"function {n}" in before or f"function* {n}" in before or f"function *{n}" in before for n in flat[g:h]):
                return None
        before = line
    return out, roots, bound, uses


def _export(s: list[Token], text: str, out: Analysis, roots: list):
    second = s[1]
    if second.text == "default":
        out.exports.append(("default", "Default"))
        rest = s[2:]
        while rest and rest[0].text in ("async", "abstract"):
            rest = rest[1:]
        names = [t.text for t in rest[1:3] if t.kind == "name"]
        if rest and rest[0].text == "function":
            name = names[0] if names and rest[1].text != "(" else None
            roots += [name] if name else []
            line = _function_line(text, name, rest[0].at) if name else "function default(...)"
            out.signatures.append(line if line.startswith("export") else f"export {line}" if name else f"export {line}")
        elif rest and rest[0].text == "class":
            name = names[0] if names and names[0] != "extends" else "default"
            roots += [name] if name != "default" else []
            out.signatures.append(f"export default class {name}")
        else:
            out.signatures.append("export default ...")
        return
    typed = second.text == "type" and len(s) > 2 and s[2].text in ("{", "*")
    at = 2 if typed else 1
    source = next((_string(t) for a, t in zip(s, s[1:]) if a.text == "from" and t.kind == "string"), None)
    if s[at].text == "*":
        name = s[at + 2].text if len(s) > at + 2 and s[at + 1].text == "as" else "*"
        if source is not None:
            out.reexports.append((source, "*", name))
            out.signatures.append(f'export * from "{source}"' if name == "*" else f'export * as {name} from "{source}"')
        return
    if s[at].text == "{":
        pairs, _ = _braced(s[at:])
        if source is not None:
            out.reexports += [(source, a, b) for a, b in pairs]
        return
    found = _declared(s[1:], text)
    if found is not None:
        names, kind, signs = found
        roots += names
        out.exports += [(n, kind) for n in names]
        out.signatures += [x if x.startswith("export") else f"export {x}" for x in signs]


def parse_sources(sources: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """sources (path, content, ...) with the columns of SCHEMA; a source that can't be read has failed = true and nulls.

    With only: path and these columns of SCHEMA, so that neither texts nor lists that nobody reads come back from Python."""
    from pyspark.sql import types as T

    sources = sources.select("path", "content") if only else sources
    added = [f for f in T.StructType.fromDDL(SCHEMA).fields if not only or f.name in only]
    kept = [i for i, c in enumerate(sources.columns) if not only or c == "path"]
    schema = T.StructType([*[sources.schema.fields[i] for i in kept], *added])
    at = sources.columns.index("path"), sources.columns.index("content")

    def one(path, text):
        try:
            if text is None:
                raise ValueError("no text")
            return analyze(path, text)
        except (ValueError, AttributeError, IndexError, RecursionError):
            return None

    def column(name, kind, rows):
        import pyarrow as pa

        if name == "failed":
            return pa.array([a is None for a in rows], pa.bool_())
        ends, flat = [0], []
        for a in rows:
            flat += getattr(a, name) if a is not None else ()
            ends.append(len(flat))
        # a null list is one without a start
        starts = pa.array([None if a is None else e for a, e in zip(rows, ends)] + ends[-1:], pa.int32())
        inner = kind.value_type
        if name == "signatures":
            return pa.ListArray.from_arrays(starts, pa.array(flat, inner), type=kind)
        fields = [inner.field(i) for i in range(inner.num_fields)]
        cols = list(zip(*flat)) or [()] * len(fields)
        return pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], fields=fields), type=kind)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            rows = [one(p, t) for p, t in zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], *[column(f.name, arrow.field(f.name).type, rows) for f in added]], schema=arrow)

    return sources.mapInArrow(run, schema)


def symbol_rows(parsed: DataFrame) -> DataFrame:
    """(path, name, kind, is_exported, ref_count): the kind is that of the first export of the name, else Variable."""
    s = parsed.select("path", "exports", F.explode("symbols").alias("s"))
    kind = F.get(F.filter("exports", lambda e: e["name"] == F.col("s.name")), F.lit(0))["kind"]
    return s.select("path", "s.name", F.when(F.col("s.is_exported"), F.coalesce(kind, F.lit("Variable"))).otherwise("Variable").alias("kind"), "s.is_exported", F.col("s.reference_count").alias("ref_count"))


def import_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("imports").alias("i")).select("path", "i.source", "i.name", "i.kind")


def reexport_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("reexports").alias("r")).select("path", "r.source", "r.local", "r.exported")
