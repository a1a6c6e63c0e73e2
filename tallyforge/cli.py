"""Command line: analyze, dashboard, profile, quality, clean and report."""

from __future__ import annotations

import argparse
import json
import sys

from tallyforge.errors import AnalyticsError
from tallyforge.plans import analysis


def main(argv: list[str] | None = None) -> int:
    """0, or 1 for errors of this library; others are raised."""
    top = argparse.ArgumentParser(prog="tallyforge")
    sub = top.add_subparsers(dest="command", required=True)
    outputs = {"analyze": None, "dashboard": "analysis/dashboard.html", "profile": None, "quality": None, "clean": "cleaned_data.parquet", "report": "analysis"}
    for name, output in outputs.items():
        p = sub.add_parser(name)
        p.add_argument("path")
        if output:
            p.add_argument("-o", "--output", default=output)
    a = top.parse_args(argv)
    try:
        if a.command in ("profile", "quality"):
            from tallyforge.sources.writers import plain

            get = analysis.profile if a.command == "profile" else analysis.quality_check
            print(json.dumps(plain(get(a.path)), indent=2))
        elif a.command == "clean":
            from tallyforge.sources.writers import write_table

            print(f"written: {write_table(analysis.clean_file(a.path), a.output, single_file=True)}")
        else:
            result = analysis.analyze(a.path, verbose=a.command != "dashboard")
            if a.command == "dashboard":
                print(f"written: {result.dashboard(a.output)}")
            elif a.command == "report":
                for name, path in result.report(a.output).items():
                    print(f"{name}: {path}")
        return 0
    except AnalyticsError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
