"""Rules on paths: services, components, tests, low value, entry points, groups, locations, agents."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directory markers of the path -> service rules. They differ on purpose.
SERVICE_MARKERS = {
    "chunker": ("services", "libraries", "mcp_servers", "agents"),
    "scope": ("services", "libs", "mcp-servers", "packages", "apps"),
    "component": ("services", "libraries", "mcp_servers", "agents"),
    "proto": ("services", "mcp_servers", "agents"),
}
#: Prefixes of component types.
COMPONENT_TYPES = {"services/": "service", "libraries/": "library", "mcp_servers/": "mcp_server", "agents/": "agent"}
#: What marks a test file.
TEST_DIRS = ("tests", "test", "__tests__", "spec", "specs", "fixtures")
#: What marks vendored, generated or configuration files.
VENDORED_DIRS = ("vendor", "vendored", "third_party", "third-party", "thirdparty", "external", "extern", "deps", "node_modules", "bower_components", "wwwroot", "repos")
SKIPPED_SUFFIXES = (".d.ts", ".min.js", ".min.ts", ".generated.ts", ".generated.py")
SKIPPED_NAMES = (
    "package.json", "package-lock.json", "tsconfig.json", "jest.config.ts", "jest.config.js", "webpack.config.js", "vite.config.ts", "vite.config.js",
    "setup.py", "setup.cfg", "conftest.py", "__init__.py", "versioneer.py", "_version.py",
)
MIGRATIONS = r"migrations?/\d|alembic/versions/"
#: File names that are entry points, the first match counts.
ENTRY_POINTS = (
    (r"main\.py", 8.0), (r"app\.py", 8.0), (r"server\.py", 8.0), (r"cli\.py", 8.0), (r"config\.py", 6.0), (r"settings\.py", 6.0),
    (r"index\.(ts|tsx|js|jsx)", 3.0), (r"App\.(ts|tsx|js|jsx)", 8.0), (r"server\.(ts|js)", 8.0), (r"routes?\.py", 4.0), (r"views?\.py", 4.0),
    (r"api\.py", 4.0), (r"urls\.py", 4.0), (r"handlers?\.py", 4.0), (r"middleware\.py", 3.0), (r"models\.py", 3.0), (r"tasks?\.py", 3.0), (r"router\.(ts|js)", 4.0),
)
#: Containers whose children are groups of their own.
CONTAINERS = ("services", "mcp_servers", "libraries", "packages", "apps", "modules", "agents")
#: Substrings that class a location, in order.
LOCATIONS = (
    ("library", ("lib/", "library/", "libraries/", "packages/", "pkg/")),
    ("utility", ("util", "helper", "common", "shared", "core")),
    ("service", ("service", "services/", "srv/")),
)
#: Bonus of a service's best file by substring, in order.
SERVICE_FILE_BONUS = (("main.py", 100.0), ("server.py", 90.0), ("__init__.py", 80.0), ("config.py", 70.0))
#: Default skip patterns of a scan.
SKIP_PATTERNS = (
    ".git", ".venv", "venv", "__pycache__", "node_modules", ".pytest_cache", ".ruff_cache", "dist", "build", ".next", "coverage", ".cache", ".DS_Store",
    "*.pyc", "*.pyo", "*.egg-info", "target", ".tox", ".venv-test", "*.lock", "*.min.js", "*.min.css", "*.map", "coverage-reports", ".nyc_output", ".terraform", "*.tar.gz", "*.zip",
)


def parts(path: Column) -> Column:
    return F.split(F.translate(path, "\\", "/"), "/")


def after_marker(path: Column, markers: tuple[str, ...]) -> Column:
    """The path part after the leftmost marker that has one; empty if there is none."""
    return F.regexp_extract(F.translate(path, "\\", "/"), "(?:^|/)(?:" + "|".join(map(re.escape, markers)) + ")/([^/]+)", 1)


def service(path: Column, rule: str = "scope") -> Column:
    """Service of a path by one of the rules; the proto rule falls back to the first part."""
    found = after_marker(path, SERVICE_MARKERS[rule])
    if rule == "proto":
        return F.when(found != "", found).otherwise(F.element_at(parts(path), 1))
    return found


def component_name(directory: Column) -> Column:
    """Component of a manifest's directory: libraries/python/X is X, else the part after the marker, else the first part."""
    nested = F.regexp_extract(directory, "(?:^|/)libraries/python/([^/]+)", 1)
    first = after_marker(directory, SERVICE_MARKERS["component"])
    own = F.regexp_extract(directory, "(?:^|/)(services|libraries|mcp_servers|agents)/", 1)
    return F.when((own == "libraries") & (first == "python") & (nested != ""), nested).when(first != "", first).otherwise(F.element_at(parts(directory), 1))


def component_type(path: Column) -> Column:
    out = F
    for prefix, kind in COMPONENT_TYPES.items():
        out = out.when(F.startswith(path, F.lit(prefix)), F.lit(kind))
    return out.otherwise("unknown")


def skipped(path: Column, patterns: tuple[str, ...] = SKIP_PATTERNS) -> Column:
    """Whether any part of the path matches any shell pattern."""
    rx = "|".join(f"(?:{fnmatch.translate(p).removeprefix('(?s:').removesuffix(')\\z').removesuffix(')\\Z')})" for p in patterns)
    return F.exists(parts(path), lambda p: F.rlike(p, F.lit(f"^(?s:{rx})$")))


def is_test(path: Column) -> Column:
    name = F.element_at(parts(path), -1)
    by_dir = F.arrays_overlap(parts(path), F.array(*(F.lit(d) for d in TEST_DIRS)))
    return by_dir | F.rlike(name, F.lit(r"^test_|_test\.py$|\.(test|spec)\.(ts|tsx|js|jsx)$|^conftest"))


def is_low_value(path: Column) -> Column:
    p = parts(path)
    name = F.element_at(p, -1)
    dirs = F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.lower)
    vendored = F.arrays_overlap(dirs, F.array(*(F.lit(d) for d in VENDORED_DIRS)))
    suffix = F.rlike(name, F.lit("(" + "|".join(map(re.escape, SKIPPED_SUFFIXES)) + ")$"))
    return vendored | suffix | name.isin(*SKIPPED_NAMES) | F.rlike(path, F.lit(MIGRATIONS))


def entry_boost(path: Column) -> Column:
    out = F
    for pattern, boost in ENTRY_POINTS:
        out = out.when(F.rlike(path, F.lit(f"(^|/){pattern}$")), F.lit(boost))
    return out.otherwise(0.0)


def service_file_bonus(path: Column) -> Column:
    """Substring tests, so domain.py has the bonus of main.py."""
    out = F
    for needle, bonus in SERVICE_FILE_BONUS:
        out = out.when(F.contains(path, F.lit(needle)), F.lit(bonus))
    return out.otherwise(0.0)


def group_key(path: Column) -> Column:
    """First two parts inside a container, else the first part, else __root__."""
    p = parts(path)
    return (
        F.when((F.size(p) > 2) & F.lower(F.element_at(p, 1)).isin(*CONTAINERS), F.concat_ws("/", F.slice(p, 1, 2)))
        .when(F.size(p) > 1, F.element_at(p, 1))
        .otherwise("__root__")
    )


def location_class(path: Column) -> Column:
    out = F
    for kind, needles in LOCATIONS:
        test = F.lit(False)
        for n in needles:
            test |= F.contains(F.lower(path), F.lit(n))
        out = out.when(test, F.lit(kind))
    return out.otherwise("inline")


def url_path(url: Column) -> Column:
    """A URL's host and path without scheme and query, as a relative path."""
    return F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), r"[?#].*$", "")
