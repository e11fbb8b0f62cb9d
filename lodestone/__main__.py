"""Command line: python -m lodestone COMMAND [TEXT] [--repo NAME | --root TREE --store INDEX].

init TREE registers a tree and list shows the registered ones; without --root the tree
is found by --repo, by the working folder, or is the first registered one.
"""

from __future__ import annotations

import argparse

from . import config as C
from .api import Repository
from .session import get_session
from .sources import sinks

COMMANDS = ("init", "list", "setup", "index", "search", "context", "scope", "generate-map", "generate-architecture", "summarize-context", "build-graph", "delete-all", "refresh", "status")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("text", nargs="?", default="", help="query or task description; for refresh, paths separated by commas")
    p.add_argument("--repo", default=None)
    p.add_argument("--root", default=None)
    p.add_argument("--store", default=None)
    p.add_argument("--limit", type=int, default=None)
    p.add_argument("--service", default=None)
    p.add_argument("--language", default=None)
    p.add_argument("--full", action="store_true")
    a = p.parse_args(args)
    if a.command == "init":
        print(C.init(a.text or ".", a.repo))
        return 0
    if a.command == "list":
        for c in C.listed():
            print(c.name, c.path)
        return 0
    if a.root and a.store:
        known = C.RepoConfig(a.repo or a.root, a.root)
    elif not (known := C.resolve(a.repo)):
        print("No such repository; register one with init.")
        return 1
    spark = get_session()
    store = a.store or known.store(C.base_dir())
    repo = Repository(spark, known.path, store, known.chunk_max_lines, known.chunk_overlap_lines, tuple(known.extra_skip_patterns))
    if a.command in ("setup", "index"):
        print(repo.index(a.full))
    if a.command == "search":
        print(sinks.search_report(repo.search(a.text, a.limit or 10, a.service, a.language)))
    if a.command == "context":
        print(repo.context(a.text, a.limit or 3))
    if a.command == "scope":
        print(sinks.scope_report(repo.scope(a.text, a.limit or 20)))
    if a.command in ("setup", "build-graph"):
        found = repo.build_graph()
        print(f"{found['nodes']} nodes, {found['edges']} edges")
    if a.command in ("setup", "generate-map"):
        print(repo.repo_map())
    if a.command in ("setup", "generate-architecture"):
        print(repo.architecture())
    if a.command == "summarize-context":
        print(repo.summarize_context())
    if a.command == "delete-all":
        repo.delete_all()
    if a.command == "refresh":
        changed = spark.createDataFrame([(x,) for x in a.text.split(",") if x], "file_path string")
        for r in repo.refresh(changed).orderBy("file_path").collect():
            print(r["action"], r["file_path"])
        print(repo.index())
    if a.command == "status":
        print(repo.status().first().asDict(recursive=True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
