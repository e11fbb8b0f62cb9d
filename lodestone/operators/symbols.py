"""Symbols of source files with signatures and children, and their counts."""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 500_000
SYMBOL = "struct<name:string,kind:string,signature:string,line:int,children:array<struct<name:string,kind:string,signature:string,line:int>>>"
_CHILD = pa.struct([("name", pa.string()), ("kind", pa.string()), ("signature", pa.string()), ("line", pa.int32())])
_SYMBOL = pa.struct([("name", pa.string()), ("kind", pa.string()), ("signature", pa.string()), ("line", pa.int32()), ("children", pa.list_(_CHILD))])


def _signature(node) -> str:
    head = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{head} {node.name}({ast.unparse(node.args)}){back}"


def python_symbols(source: str) -> list[dict]:
    """Top-level classes with their methods, and functions; none on a syntax error."""
    try:
        body = ast.parse(source).body
    except (SyntaxError, ValueError):
        return []
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    out = []
    for n in body:
        if isinstance(n, ast.ClassDef):
            bases = f"({', '.join(ast.unparse(b) for b in n.bases)})" if n.bases else ""
            children = [{"name": m.name, "kind": "method" if is_method(m) else "function", "signature": _signature(m), "line": m.lineno} for m in n.body if isinstance(m, functions)]
            out.append({"name": n.name, "kind": "class", "signature": f"class {n.name}{bases}", "line": n.lineno, "children": children})
        elif isinstance(n, functions):
            out.append({"name": n.name, "kind": "function", "signature": _signature(n), "line": n.lineno, "children": []})
    return out


def is_method(node) -> bool:
    """Whether the first parameter is self or cls."""
    args = [*node.args.posonlyargs, *node.args.args]
    return bool(args) and args[0].arg in ("self", "cls")


_TS = re.compile(
    r"^(?P<indent>[ \t]*)(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?"
    r"(?:(?P<kind>class|interface)\s+(?P<name>\w+)|type\s+(?P<type>\w+)[^=\n]*=|(?:async\s+)?function\s*\*?\s*(?P<fn>\w+)|const\s+(?P<arrow>\w+)[^=\n]*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)[^=\n]*=>)",
    re.M,
)
_MEMBER = re.compile(r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?P<name>[A-Za-z_$][\w$]*)\s*(?P<rest>\([^)]*\)[^;{]*[;{]|\??:\s*[^;]+;)", re.M)


def script_symbols(source: str) -> list[dict]:
    """Classes, interfaces, type aliases, functions and arrow constants of TypeScript and JavaScript, with members."""
    found = [m for m in _TS.finditer(source) if not m["indent"]]
    out = []
    for m, following in zip(found, [*found[1:], None], strict=True):
        line = source.count("\n", 0, m.start()) + 1
        text = source[m.start() : source.find("\n", m.end()) if "\n" in source[m.end() :] else len(source)].strip().rstrip("{").strip()
        name, kind = (m["name"], m["kind"]) if m["kind"] else (m["type"], "type") if m["type"] else (m["fn"] or m["arrow"], "function")
        children = []
        if m["kind"]:
            body = source[m.end() : following.start() if following else len(source)]
            for c in _MEMBER.finditer(body):
                if c["name"] in ("if", "for", "while", "switch", "return", "catch"):
                    continue
                call = c["rest"].startswith("(")
                children.append({"name": c["name"], "kind": "method" if call else "property", "signature": c[0].strip().rstrip("{;").strip(), "line": line + source.count("\n", m.end(), m.end() + c.start())})
        out.append({"name": name, "kind": kind, "signature": text, "line": line, "children": children})
    return out


def file_symbols(files: DataFrame) -> DataFrame:
    """rel_path, language, symbols of files with symbols, of a supported language, up to MAX_BYTES; files: rel_path, language, content."""

    def run(batches):
        for b in batches:
            rows = []
            for path, language, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = python_symbols(source) if language == "python" else script_symbols(source)
                if found:
                    rows.append((path, language, found))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(_SYMBOL))], ["rel_path", "language", "symbols"])

    chosen = files.where(F.col("language").isin("python", "typescript", "javascript") & (F.octet_length("content") <= MAX_BYTES))
    return chosen.select("rel_path", "language", "content").mapInArrow(run, f"rel_path string, language string, symbols array<{SYMBOL}>")


def kind_counts(symbols: Column) -> dict[str, Column]:
    """classes (with interfaces), functions, types, and the methods of classes and interfaces."""
    of = lambda *kinds: F.filter(symbols, lambda s: s["kind"].isin(*kinds))
    methods = F.aggregate(of("class", "interface"), F.lit(0), lambda n, s: n + F.size(s["children"]))
    return {"classes": F.size(of("class", "interface")), "functions": F.size(of("function")), "types": F.size(of("type")), "methods": methods}


#: Patterns that read symbols from HTML: headings, links, scripts.
HTML_SYMBOLS = {"headings": r"<h[1-6][^>]*>([^<]*)</h[1-6]>", "links": r'<a\s[^>]*href="([^"]*)"', "scripts": r"<(script)[ >]"}


def html_symbols(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds headings, links (as arrays) and the number of scripts."""
    text = F.coalesce(F.col(html), F.lit(""))
    found = {k: F.regexp_extract_all(text, F.lit(rx), F.lit(1)) for k, rx in HTML_SYMBOLS.items()}
    return pages.withColumns({"headings": found["headings"], "links": found["links"], "scripts": F.size(found["scripts"])})
