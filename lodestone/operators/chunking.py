"""Chunks: sliding windows, Python definitions, regex definitions for other languages, dispatch."""

from __future__ import annotations

import ast
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Window sizes of the function and of the configuration.
FUNCTION_WINDOW, CONFIG_WINDOW = (80, 10), (100, 5)
MAX_FILE_LINES = 10_000
#: Methods longer than this many lines are chunks of their own.
METHOD_LINES = 5
#: Definitions of other languages by the start of their line (own subset; parsers are not available).
DEFINITIONS = {
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(class|interface|type|function)\s+(\w+)",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(class|function)\s+(\w+)",
    "go": r"^(func|type)\s+(?:\([^)]*\)\s*)?(\w+)",
    "rust": r"^\s*(?:pub\s+)?(fn|struct|enum|trait|impl)\s+(\w+)",
    "shell": r"^\s*(function)\s+(\w+)",
}


def usable(files: DataFrame, copies: Column | None = None) -> DataFrame:
    """Files that are neither blank nor longer than MAX_FILE_LINES; files: file_path, content.

    copies: how often (once at least) the content stands in the file, a newline after each
    copy; null says it is the file. Such files are judged by the one copy and never built.
    """
    content, lines = F.col("content"), X.line_count(F.col("content"))
    if copies is not None:
        lines = F.when(copies.isNull(), lines).otherwise(X.line_count(F.concat(content, F.lit("\n"))).cast("long") * copies)
    return files.where((F.ltrim(content, F.lit(" \n\t\r")) != "") & (lines <= MAX_FILE_LINES))


def windows(files: DataFrame, max_lines: int = CONFIG_WINDOW[0], overlap: int = CONFIG_WINDOW[1], key: str = "file_path") -> DataFrame:
    """key, line_start, line_end, symbol_name, symbol_type, content of every window.

    Up to max_lines: one __file__ chunk. Else windows every max_lines - overlap lines; window
    i exists if i = 0 or the one before ends before the file does. An empty file is one
    chunk with lines 1 to 0.
    """
    split = files.withColumn("__lines", X.lines(F.col("content"))).withColumn("__n", F.size("__lines"))
    starts = F.when(F.col("__n") <= max_lines, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.col("__n") - overlap - 1, F.lit(0)), F.lit(max_lines - overlap)))
    each = split.withColumn("__start", F.explode(starts)).withColumn("__end", F.least(F.col("__start") + max_lines, F.col("__n")))
    whole = F.col("__n") <= max_lines
    start, end = (F.col("__start") + 1).alias("line_start"), F.col("__end").alias("line_end")
    name = F.when(whole, "__file__").otherwise(F.concat(F.lit("lines_"), (F.col("__start") + 1).cast("string"), F.lit("_"), F.col("__end").cast("string")))
    body = F.when(whole, F.col("content")).otherwise(F.array_join(F.slice("__lines", F.col("__start") + 1, max_lines), "\n"))
    kept = [c for c in files.columns if c not in ("content",)]
    return each.select(*kept, start, end, name.alias("symbol_name"), F.when(whole, "module").otherwise("fragment").alias("symbol_type"), body.alias("content"))


def window_chunk_id(path, line_start, whole):
    """Chunk ids of windows are made from __window_<zero-based start>__, those of whole files from __file__."""
    symbol = F.when(whole, F.lit("__file__")).otherwise(F.concat(F.lit("__window_"), (line_start - 1).cast("string"), F.lit("__")))
    return X.chunk_id(path, line_start, symbol)


def python_definitions(source: str) -> list[tuple] | None:
    """(name, type, parent, first line, last line) of top-level classes, their longer methods and functions; None on a syntax error."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    out = []
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            out.append((node.name, "class", None, node.lineno, node.end_lineno))
            out += [(m.name, "method", node.name, m.lineno, m.end_lineno) for m in node.body if isinstance(m, functions) and m.end_lineno - m.lineno > METHOD_LINES]
        elif isinstance(node, functions):
            out.append((node.name, "function", None, node.lineno, node.end_lineno))
    return out


def python_imports(source: str) -> list[str]:
    """Modules of all imports anywhere, in walk order, repeats kept; none on a syntax error."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            out.append(node.module)
    return out


PYTHON_SCHEMA = "file_path string, symbol_name string, symbol_type string, parent_class string, line_start int, line_end int, imports array<string>, content string, valid boolean"


def python_chunks(files: DataFrame) -> DataFrame:
    """Chunks of Python files; a file without definitions is one __module__ chunk; valid is false on a syntax error (one row)."""

    def run(batches):
        for b in batches:
            rows = []
            for path, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = (source or "").splitlines()
                found = python_definitions(source or "")
                imports = python_imports(source or "")
                if not found:
                    rows.append((path, "__module__", "module", None, 1, len(lines), imports, source, found is not None))
                else:
                    rows += [(path, name, kind, parent, a, z, imports, "\n".join(lines[a - 1 : z]), True) for name, kind, parent, a, z in found]
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.list_(pa.string()), pa.string(), pa.bool_()]
            names = ["file_path", "symbol_name", "symbol_type", "parent_class", "line_start", "line_end", "imports", "content", "valid"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return files.select("file_path", "content").mapInArrow(run, PYTHON_SCHEMA)


#: Names of definition kinds where a language's keyword is another.
KINDS = {"func": "function", "fn": "function"}


def definition_spans(lines: list[str], pattern: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, first line, last line) of the lines that begin a definition.

    A definition ends where the braces opened since its first line are closed again; one
    that opens none before the next begins ends before that, the last one with the file.
    """
    rx = re.compile(pattern, re.ASCII)
    starts = [(i, m) for i, line in enumerate(lines) if (m := rx.match(line))]
    depth = list(accumulate((line.count("{") - line.count("}") for line in lines), initial=0))
    out = []
    nexts = [i for i, _ in starts[1:]] + [len(lines)] * bool(starts)
    for (i, m), following in zip(starts, nexts, strict=True):
        opened = next((j for j in range(i, following) if depth[j + 1] > depth[i] or "{" in lines[j]), None)
        closed = next((j for j in range(opened, len(lines)) if depth[j + 1] <= depth[i]), None) if opened is not None else None
        out.append((KINDS.get(m[1], m[1]), m[2], i + 1, (closed if closed is not None else following - 1) + 1))
    return out


def regex_definitions(files: DataFrame) -> DataFrame:
    """file_path, symbol_name, symbol_type, line_start, line_end, content of the definitions of each file (file_path, language, content)."""

    def run(batches):
        for b in batches:
            rows = []
            for path, language, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = (text or "").split("\n")
                lines = lines[:-1] if lines[-1] == "" else lines
                rows += [(path, name, kind, a, z, "\n".join(lines[a - 1 : z]).strip()) for kind, name, a, z in definition_spans(lines, DEFINITIONS[language])]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [b.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file_path", "symbol_name", "symbol_type", "line_start", "line_end", "content"])

    chosen = files.where(F.col("language").isin(*DEFINITIONS))
    kind = dict(files.dtypes)["file_path"]
    return chosen.select("file_path", "language", "content").mapInArrow(run, f"file_path {kind}, symbol_name string, symbol_type string, line_start int, line_end int, content string")


def chunk_files(files: DataFrame, max_lines: int = CONFIG_WINDOW[0], overlap: int = CONFIG_WINDOW[1]) -> DataFrame:
    """Dispatch: definitions where a language has a pattern and the file holds any, Python files by their syntax tree (windows of 80/10 on an error), all others by windows.

    definition marks the chunks that take the document text of definitions.
    """
    good = usable(files).withColumn("language", X.language(F.col("file_path")))
    python = python_chunks(good.where("language = 'python'"))
    parsed = python.where("valid").select("file_path", "line_start", "line_end", "symbol_name", "symbol_type", "content", "parent_class", "imports")
    broken = windows(python.where("NOT valid").select("file_path", "content"), *FUNCTION_WINDOW)
    defined = regex_definitions(good).withColumn("definition", F.lit(True))
    other = windows(good.where("language <> 'python'").join(defined.select("file_path").distinct(), "file_path", "left_anti").select("file_path", "content"), max_lines, overlap)
    chunks = parsed.unionByName(broken, allowMissingColumns=True).unionByName(defined, allowMissingColumns=True).unionByName(other, allowMissingColumns=True)
    return chunks.withColumn("language", X.language(F.col("file_path"))).withColumn("definition", F.coalesce("definition", F.lit(False)))


def documents(chunks: DataFrame) -> DataFrame:
    """Adds the embedding text of each chunk."""
    col = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string")
    text = lambda definitions: X.document_text(col("file_path"), col("content"), col("language"), col("service"), col("symbol_name"), col("symbol_type"), col("parent_class"), definitions)
    return chunks.withColumn("document", F.when(F.col("definition"), text(True)).otherwise(text(False)) if "definition" in chunks.columns else text(False))


def line_counts(chunks: DataFrame, key: str = "file_path") -> DataFrame:
    """Lines of each file as the sum of its chunks' spans; nested chunks count twice."""
    return chunks.groupBy(key).agg(F.sum(F.col("line_end") - F.col("line_start") + 1).alias("line_count"))
