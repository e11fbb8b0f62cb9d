"""Registered repositories: one folder each with a config.toml, found by name, path, working folder or order."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

#: Defaults of a repository's configuration.
BRANCH, MAX_LINES, OVERLAP = "develop", 100, 5


def slug(name: str) -> str:
    """Slashes, backslashes and spaces become dashes; empty becomes unnamed."""
    return name.translate(str.maketrans("/\\ ", "---")) or "unnamed"


@dataclass(frozen=True)
class RepoConfig:
    name: str
    path: str
    remote_url: str = ""
    branch: str = BRANCH
    chunk_max_lines: int = MAX_LINES
    chunk_overlap_lines: int = OVERLAP
    extra_skip_patterns: list[str] = field(default_factory=list)

    def store(self, base: Path) -> str:
        return str(base / "repos" / slug(self.name) / "store")


def base_dir() -> Path:
    return Path(os.environ.get("LODESTONE_HOME", Path.home() / ".lodestone"))


def _value(v) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(_value, v)) + "]"
    return str(v) if isinstance(v, int) else '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'


def save(config: RepoConfig, base: Path | None = None) -> Path:
    folder = (base or base_dir()) / "repos" / slug(config.name)
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / "config.toml"
    path.write_text("".join(f"{k} = {_value(v)}\n" for k, v in asdict(config).items()))
    return path


def load(path: Path) -> RepoConfig:
    known = RepoConfig.__dataclass_fields__
    return RepoConfig(**{k: v for k, v in tomllib.loads(path.read_text()).items() if k in known})


def listed(base: Path | None = None) -> list[RepoConfig]:
    """All registered repositories by name."""
    return [load(p) for p in sorted(((base or base_dir()) / "repos").glob("*/config.toml"))]


def resolve(wanted: str | None = None, base: Path | None = None, cwd: str | None = None) -> RepoConfig | None:
    """By name, then by path; without a wish the one that holds the working folder, then the first; else None."""
    known = listed(base)
    if wanted:
        by_name = [c for c in known if slug(c.name) == slug(wanted)]
        return next(iter(by_name + [c for c in known if c.path == str(Path(wanted).resolve())]), None)
    here = Path(cwd or os.getcwd()).resolve()
    return next(iter([c for c in known if here.is_relative_to(c.path)] + known), None)


def init(path: str, name: str | None = None, base: Path | None = None) -> RepoConfig:
    """Registers a tree; the remote and branch are read from its git folder if it has one."""
    root = Path(path).resolve()
    git = root / ".git"
    remote, branch = "", BRANCH
    if (git / "config").exists():
        urls = [line.split("=", 1)[1].strip() for line in (git / "config").read_text().splitlines() if line.strip().startswith("url")]
        remote = urls[0] if urls else ""
    if (git / "HEAD").exists():
        head = (git / "HEAD").read_text().strip()
        branch = head.removeprefix("ref: refs/heads/") if head.startswith("ref: ") else BRANCH
    config = RepoConfig(name or root.name, str(root), remote, branch)
    save(config, base)
    return config
