"""Configuration: defaults, files, detection, overrides.  JSON or a dict only; no code is run."""

from __future__ import annotations

import copy
import json
import os

SEARCHED = ("weftline.config.json", ".weftlinerc.json", ".weftlinerc")
MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml")
SKIPPED = {"build", "coverage", "dist", "docs", "node_modules", "target", "test", "tests", "vendor", "venv"}
SOURCE_EXTENSIONS = (".cjs", ".go", ".java", ".js", ".jsx", ".mjs", ".py", ".rs", ".ts", ".tsx")
SOURCE_GLOB = "**/*.{ts,tsx,js,jsx,mjs,cjs,py,go,rs,java}"

DEFAULTS: dict = {
    "root_dir": ".",
    "include": ["docs/**/*.md", "README.md"],
    "exclude": [f"**/{d}/**" for d in ("node_modules", "vendor", "dist", "build")],
    "manifest_files": None,
    "source_patterns": None,
    "urls": {"enabled": True, "timeout_ms": 10_000, "concurrency": 5, "skip_domains": ["localhost", "127.0.0.1", "example.com"], "cache_seconds": 3600, "max_cache": 5000},
    # snippets have no rule of their own: they run unless one switches them off
    "rules": {
        "file-path": {"enabled": True, "severity": "error", "skip_illustrative": True, "illustrative_patterns": []},
        "external-url": {"enabled": True, "severity": "warning"},
        "version": {"enabled": True, "severity": "warning"},
        "directory-structure": {"enabled": True, "severity": "warning", "skip_illustrative": True, "illustrative_patterns": []},
        "code-pattern": {"enabled": True, "severity": "warning"},
        "dependency": {"enabled": True, "severity": "info"},
    },
    "reporters": ["console"],
    "output_path": None,
    "graph": {"enabled": True},
    "scoring": {"enabled": False, "weights": {}, "thresholds": {}},
    "semantic": {"enabled": False, "similarity_threshold": 0.3},
    "cache": {"enabled": True, "dir": ".weftline-cache", "max_age_ms": 86_400_000},
    "incremental": {"enabled": False},
    "change_window_days": 7,
    "clear_cache": False,
    "verbose": False,
}


def define(config: dict) -> dict:
    """The configuration itself; for files that name what they define."""
    return config


def merge(base: dict, over: dict) -> dict:
    """Deep merge: dicts by key, lists and nulls replaced; neither argument is changed."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def detect_manifests(root: str) -> list[str]:
    return [f for f in MANIFESTS if os.path.isfile(os.path.join(root, f))]


def _has_sources(path: str, depth: int = 1) -> bool:
    try:
        entries = sorted(os.scandir(path), key=lambda e: e.name)
    except OSError:
        return False
    if any(e.is_file() and e.name.lower().endswith(SOURCE_EXTENSIONS) for e in entries):
        return True
    return depth > 0 and any(e.is_dir() and e.name[0] != "." and e.name != "node_modules" and _has_sources(e.path, depth - 1) for e in entries)


def detect_sources(root: str) -> list[str]:
    """A glob for each top directory with sources, its src where that has some; all sources for want of one."""
    out = []
    for e in sorted(os.scandir(root), key=lambda e: e.name) if os.path.isdir(root) else []:
        if e.is_dir() and e.name[0] != "." and e.name not in SKIPPED and _has_sources(e.path):
            out.append(f"{e.name}/src/{SOURCE_GLOB}" if _has_sources(os.path.join(e.path, "src")) else f"{e.name}/{SOURCE_GLOB}")
    return out or [SOURCE_GLOB]


def complete(config: dict) -> dict:
    """With what was left open found in the project."""
    config["root_dir"] = os.path.abspath(config.get("root_dir") or ".")
    if not config.get("manifest_files"):
        config["manifest_files"] = detect_manifests(config["root_dir"])
    if not config.get("source_patterns"):
        config["source_patterns"] = detect_sources(config["root_dir"])
    return config


def load(path: str | None = None, root: str = ".") -> dict:
    """The file named, or the first found in root, over the defaults; a missing file gives the defaults."""
    found = path or next((p for n in SEARCHED if os.path.isfile(p := os.path.join(root, n))), None)
    own: dict = {}
    if found and os.path.isfile(found):
        with open(found, encoding="utf-8") as f:
            own = json.load(f)
        if not isinstance(own, dict):
            raise ValueError(f"{found} holds no object")
    return complete(merge(merge(DEFAULTS, {"root_dir": root}), own))


def override(config: dict, options: dict) -> dict:
    """Command-line options over a configuration.

    `only` switches the rules that the configuration has, so those without one run on.
    """
    out = copy.deepcopy(config)
    if options.get("reporter"):
        out["reporters"] = [options["reporter"]]
    if options.get("output"):
        out["output_path"] = options["output"]
    if options.get("skip_urls"):
        out["urls"]["enabled"] = False
    if options.get("only"):
        kept = options["only"].split(",")
        for name, rule in out["rules"].items():
            rule["enabled"] = name in kept
    for option, key in (("files", "include"), ("manifest", "manifest_files"), ("source", "source_patterns")):
        if options.get(option):
            out[key] = options[option].split(",")
    if options.get("no_cache"):
        out["cache"]["enabled"] = False
    for option, key in (("score", "scoring"), ("incremental", "incremental"), ("vector_search", "semantic")):
        if options.get(option):
            out[key]["enabled"] = True
    for key in ("verbose", "clear_cache"):
        out[key] = bool(options.get(key)) or out[key]
    return out


def cache_dir(config: dict) -> str:
    """The cache folder; it must lie within the root."""
    root = os.path.abspath(config["root_dir"])
    path = os.path.abspath(os.path.join(root, config["cache"]["dir"]))
    if path == root or not path.startswith(root + os.sep):
        raise ValueError(f"the cache folder {path} lies outside {root}")
    return path
