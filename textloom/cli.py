"""Command line: run a configuration and write the report bundle."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime


def main(args: list[str] | None = None) -> int:
    """0 when the run is written, 2 with a message on stderr for any error."""
    parser = argparse.ArgumentParser(prog="textloom")
    parser.add_argument("--config", required=True)
    parser.add_argument("--output", default=None)
    parser.add_argument("--quiet", action="store_true")
    asked = parser.parse_args(args)
    output = asked.output or datetime.now().strftime("outputs/run_%Y%m%d_%H%M%S")
    try:
        from pyspark.sql import SparkSession

        from textloom.config import load_config, normalize_config
        from textloom.plans.engine import check_documents
        from textloom.plans.report import write_bundle
        from textloom.sources.files import read_documents, validate

        config = normalize_config(load_config(asked.config))
        for path in [f for g in config.groups for f in g.files] + list(config.exclude_files):
            validate(path)
        spark = SparkSession.builder.appName("textloom").getOrCreate()
        say = (lambda _: None) if asked.quiet else (lambda m: print(m, file=sys.stderr))
        result = check_documents(read_documents(spark, config.groups, config.exclude_files, config.options), config, say)
        print(json.dumps(write_bundle(result, output), ensure_ascii=False))
        return 0
    except Exception as e:
        print(f"错误: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
