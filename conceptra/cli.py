"""python -m conceptra validate|materialize|query MODEL"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .lang.errors import ModelError
from .lang.model import Model
from .lang.parser import parse_expression


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("conceptra").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="conceptra", description="Models of concepts on Spark.")
    parser.add_argument("--base", help="folder of the sources' relative paths (the model's folder)")
    parser.add_argument("--associativity", choices=("right", "left"), default="right")
    parser.add_argument("--sql", action="store_true", help="print Spark SQL instead of rows, or the statements instead of materialising")
    parser.add_argument("--explain", action="store_true", help="print the plan of a query instead of rows")
    parser.add_argument("--rows", type=int, default=20, help="rows to print")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("validate").add_argument("model")
    write = commands.add_parser("materialize")
    write.add_argument("model")
    write.add_argument("mode", nargs="?", choices=("full", "incremental"), default="full")
    write.add_argument("value", nargs="?", help="value of the incremental condition")
    ask = commands.add_parser("query")
    ask.add_argument("model")
    ask.add_argument("text", nargs="?", help="the query; without it, one a line from the standard input")
    args = parser.parse_args(argv)
    try:
        model = Model.parse(Path(args.model).read_text(), associativity=args.associativity)
        names = model.validate()
        if args.command == "validate":
            print(f"{len(names)} concepts")
            return 0
        from .engine import Engine

        engine = Engine(_session(), model, base=args.base or str(Path(args.model).resolve().parent))
        if args.command == "materialize":
            value = parse_expression(args.value, args.associativity) if args.value is not None else None
            if args.sql:
                print(";\n".join(engine.script(value, full=args.mode == "full")) + ";")
                return 0
            for table in engine.materialize(value, full=args.mode == "full"):
                print(table)
            return 0
        for line in [args.text] if args.text else sys.stdin:
            if not line.strip():
                continue
            try:
                if args.sql:
                    print(engine.sql(line))
                elif args.explain:
                    print(engine.explain(line))
                else:
                    engine.query(line).show(args.rows, truncate=False)
            except ModelError as e:
                print(f"{type(e).__name__}: {e}", file=sys.stderr)
                if args.text:
                    return 1
    except ModelError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0
