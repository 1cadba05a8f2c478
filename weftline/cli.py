"""Command line: python -m weftline.cli [options]; exit code 1 if there are errors."""

from __future__ import annotations

import argparse
import sys
import traceback

from . import config as settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("weftline", description="Checks documentation against the code it describes")
    p.add_argument("-c", "--config", help="configuration file (JSON)")
    p.add_argument("-r", "--reporter", choices=["console", "json", "markdown", "enhanced"])
    p.add_argument("-o", "--output", help="file for the report")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--root", default=".", help="the project")
    p.add_argument("--only", help="types of reference to check, by comma")
    p.add_argument("--skip-urls", action="store_true")
    p.add_argument("--files", help="globs of documents, by comma")
    p.add_argument("--manifest", help="manifest files, by comma")
    p.add_argument("--source", help="globs of source files, by comma")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--clear-cache", action="store_true")
    p.add_argument("--score", action="store_true", help="score the documents")
    p.add_argument("--incremental", action="store_true", help="check new and changed documents only")
    p.add_argument("--vector-search", action="store_true", help="compare sections with comments; needs a model")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    options = vars(parser().parse_args(argv))
    try:
        config = settings.override(settings.load(options["config"], options["root"]), options)
        if options["files"] or options["manifest"] or options["source"]:
            config = settings.complete(config)
        from .plans.check import run
        from .session import session

        check = run(spark or session(), config)
        for name, text in check.report().items():
            if name == "console" or not config.get("output_path"):
                print(text)
        check.close()
        return int(check.summary["errors"] > 0)
    except Exception as e:
        print("Error:", e, file=sys.stderr)
        if options["verbose"]:
            traceback.print_exc()
        return 1


if __name__ == "__main__":
    sys.exit(main())
