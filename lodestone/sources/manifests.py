"""Manifest parsers: compose YAML, pyproject TOML, proto definitions."""

from __future__ import annotations

import re
import tomllib
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as K
from ..functions import paths as P

#: Names of compose files in order of preference, and folders whose manifests do not count.
COMPOSE_NAMES = ("compose.yml", "docker-compose.yml", "docker-compose.yaml")
TOML_SKIPPED = (".venv", "venv", "node_modules", ".git", "__pycache__", "dist", "build")
PROTO_SKIPPED = (".venv", "venv", "node_modules", ".git")
#: Patterns of proto definitions.
SERVICE, RPC, PACKAGE = re.compile(r"service\s+(\w+)\s*\{"), re.compile(r"rpc\s+(\w+)\s*\("), re.compile(r"package\s+([\w.]+)\s*;")


def _outside(folders: tuple[str, ...]):
    return ~F.arrays_overlap(P.parts(F.col("file_path")), F.array(*(F.lit(f) for f in folders)))


def compose_file(files: DataFrame) -> DataFrame:
    """The compose file that counts: the first existing name at the root of the tree."""
    order = F.array_position(F.array(*(F.lit(n) for n in COMPOSE_NAMES)), F.col("file_path"))
    return files.withColumn("__order", order).where("__order > 0").orderBy("__order").limit(1).drop("__order")


def _listed(value) -> list[str]:
    return [str(v) for v in value] if isinstance(value, list) else []


def compose_services(files: DataFrame) -> DataFrame:
    """name, image, restart, build, depends_on, ports, profiles of each service; unreadable files give none. files: file_path, content."""

    def run(batches):
        import yaml

        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                try:
                    data = yaml.safe_load(text or "") or {}
                except (yaml.YAMLError, ValueError):
                    continue
                declared = data.get("services") if isinstance(data, dict) else None
                for name, c in (declared if isinstance(declared, dict) else {}).items():
                    if not isinstance(c, dict):
                        continue
                    needs = c.get("depends_on")
                    needs = needs if isinstance(needs, (dict, list)) else []
                    restart = c.get("restart") if isinstance(c.get("restart"), str) else None
                    rows.append((str(name), str(c.get("image") or ""), restart, bool(c.get("build")), [str(d) for d in needs], _listed(c.get("ports")), _listed(c.get("profiles"))))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string()] * 3 + [pa.bool_()] + [pa.list_(pa.string())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["name", "image", "restart", "build", "depends_on", "ports", "profiles"])

    rows = files.select("content").mapInArrow(run, "name string, image string, restart string, build boolean, depends_on array<string>, ports array<string>, profiles array<string>")
    return rows.withColumns({"node_type": K.compose_class(F.col("name"), F.col("image"), F.col("restart")), "data_store_type": K.data_store_type(F.col("name"), F.col("image"))})


def compose_edges(services: DataFrame) -> DataFrame:
    """source, target, edge_type of the dependencies; a target is a data store by its name or, if it is declared, by its image."""
    each = services.select(F.col("name").alias("source"), F.explode("depends_on").alias("target"))
    images = services.select(F.col("name").alias("target"), F.col("image").alias("__image"))
    return each.join(images, "target", "left").select("source", "target", K.edge_type(K.is_data_store(F.col("target"), F.col("__image"))).alias("edge_type"))


def _table(data: dict, *names: str) -> dict:
    """The table under the names; an empty one where something else stands there."""
    for name in names:
        data = data.get(name) if isinstance(data, dict) else None
    return data if isinstance(data, dict) else {}


def components(files: DataFrame) -> DataFrame:
    """component, component_type, path, package_name, description, requirements, path_sources of each pyproject.toml with a name; values of another type than expected count as missing, names become text."""

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    data = tomllib.loads(text or "")
                except tomllib.TOMLDecodeError:
                    continue
                project = _table(data, "project")
                if not project.get("name"):
                    continue
                sources, needs = _table(data, "tool", "uv", "sources"), project.get("dependencies")
                listed = [d for d in needs if isinstance(d, str)] if isinstance(needs, list) else []
                rows.append((path, str(project["name"]), str(project.get("description", "")), listed, [n for n, s in sources.items() if isinstance(s, dict) and "path" in s]))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string()] * 3 + [pa.list_(pa.string())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file_path", "package_name", "description", "requirements", "path_sources"])

    chosen = files.where(F.element_at(P.parts(F.col("file_path")), -1) == "pyproject.toml").where(_outside(TOML_SKIPPED))
    rows = chosen.select("file_path", "content").mapInArrow(run, "file_path string, package_name string, description string, requirements array<string>, path_sources array<string>")
    folder = F.regexp_replace("file_path", r"/?pyproject\.toml$", "")
    return rows.select(P.component_name(folder).alias("component"), P.component_type(F.col("file_path")).alias("component_type"), folder.alias("path"), "package_name", "description", "requirements", "path_sources")


def closing(text: str, start: int) -> int:
    """Where the block that is open at start ends: past its closing brace, or the end of the text."""
    steps = ((m.end(), 1 if m[0] == "{" else -1) for m in re.compile("[{}]").finditer(text, start))
    depths = accumulate(steps, lambda known, step: (step[0], known[1] + step[1]), initial=(start, 1))
    return next((at for at, depth in depths if depth == 0), len(text))


def proto_services(files: DataFrame) -> DataFrame:
    """service, package, file_path, owning_service, rpcs, seq of every service definition; bodies end where braces balance."""

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                package = PACKAGE.search(text)
                for m in SERVICE.finditer(text):
                    rows.append((m[1], package[1] if package else "", path, RPC.findall(text, m.end(), closing(text, m.end()))))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.string()] * 3 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["service", "package", "file_path", "rpcs"])

    chosen = files.where(F.endswith("file_path", F.lit(".proto"))).where(_outside(PROTO_SKIPPED))
    rows = chosen.select("file_path", "content").mapInArrow(run, "service string, package string, file_path string, rpcs array<string>")
    order = Window.partitionBy("service").orderBy("file_path")
    return rows.withColumn("owning_service", P.service(F.col("file_path"), "proto")).withColumn("seq", F.row_number().over(order))
