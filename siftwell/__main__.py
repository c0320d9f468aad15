"""Command line: python -m siftwell COMMAND --database FOLDER ..."""

from __future__ import annotations

import argparse
import sys

from . import texts
from .engine import Engine
from .functions.text import RequestError
from .operators import calibration
from .session import session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftwell")
    top.add_argument("--master", help="cluster to run on; that of the environment if none is given")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for x in positional:
            p.add_argument(x)
        p.add_argument("-d", "--database", required=True, help="folder of the index")
        return p

    command("index", "path").add_argument("-f", "--force", action="store_true", help="index all files anew")
    watch = command("watch", "path")
    watch.add_argument("--checkpoint", required=True)
    watch.add_argument("--once", action="store_true", help="take what has changed and end")
    command("stats")
    find = command("search", "query")
    find.add_argument("-l", "--limit", type=int, default=10)
    find.add_argument("--min-score", type=float)
    find.add_argument("--file-type")
    find.add_argument("--symbol-kind")
    command("refs", "symbol").add_argument("-l", "--limit", type=int)
    command("deps", "path")
    command("explain", "symbol")
    learn = command("calibrate")
    learn.add_argument("-l", "--language")
    learn.add_argument("--dry-run", action="store_true")
    learn.add_argument("--min-samples", type=int, default=100)
    return top


def run(args: argparse.Namespace, engine: Engine) -> str:
    if args.command == "index":
        return ", ".join(f"{k} {n}" for k, n in engine.index(args.path, args.force).items())
    if args.command == "watch":
        engine.watch(args.path, args.checkpoint, args.once).awaitTermination()
        return texts.stats(engine)
    if args.command == "stats":
        return texts.stats(engine)
    if args.command == "search":
        out = texts.search(engine, args.query, args.limit, args.min_score, args.file_type, args.symbol_kind)
        if engine.provider:
            engine.observe(args.query, args.limit)
            engine.flush_observations()
        return out
    if args.command == "refs":
        return texts.find_refs(engine, args.symbol, args.limit)
    if args.command == "deps":
        return texts.dependencies(engine, args.path)
    if args.command == "explain":
        return texts.explain(engine, args.symbol)
    return calibration.summary(engine.calibrate(args.language, args.min_samples, args.dry_run))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(run(args, Engine(session(master=args.master), args.database)))
    except RequestError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
