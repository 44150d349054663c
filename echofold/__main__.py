"""Command line: compress, decompress, info and test of files, each file a stream.

    python -m echofold compress IN [OUT] [--method m4] [--layout index] [--checksum xxh3]
        [--block-size 8m] [--min-match N] [--seed-size N] [--target-chunk N] [--max-distance N]
        [--overlay-min-match N] [--overlay-distance N] [--force]
    python -m echofold decompress IN [OUT] [--output-limit N] [--force]
    python -m echofold info|test IN
    python -m echofold --version

IN and OUT are files of this machine, or - for standard input and output. Without OUT, the
archive of IN is IN with the suffix .echo, and a file of that suffix is read to the name
without it. OUT appears only when it is complete, replaces a file only with --force and is
never IN itself. The exit code is that of the error's kind.
"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile

from . import __version__
from .functions.config import CHECKSUMS, LAYOUTS, MOST_POSITION, MatchConfig, Overlay, parse_size
from .functions.errors import EngineError


SUFFIX = ".echo"


def _target(a: argparse.Namespace) -> str:
    """Where the output goes; checked before anything is read."""
    target = a.target
    if target is None and a.source != "-":
        target = a.source + SUFFIX if a.command == "compress" else a.source.removesuffix(SUFFIX) if a.source.endswith(SUFFIX) else None
    if not target:
        raise EngineError("InvalidConfiguration", "an output is needed where the input's name does not give one")
    if target == "-" and a.force:
        raise EngineError("InvalidConfiguration", "--force is for files")
    if "-" not in (a.source, target) and os.path.exists(target) and os.path.exists(a.source) and os.path.samefile(a.source, target):
        raise EngineError("OutputIo", f"{target} is the input")
    if target != "-" and os.path.isdir(target):
        raise EngineError("OutputIo", f"{target} is a folder")
    if target != "-" and os.path.lexists(target) and not a.force:
        raise EngineError("OutputIo", f"{target} exists")
    return target


def _publish(path: str, data: bytes, force: bool) -> None:
    """Whole or not at all; without ``force`` the link fails if the name has been taken meanwhile."""
    if path == "-":
        sys.stdout.buffer.write(data)
        sys.stdout.buffer.flush()
        return
    try:
        with tempfile.NamedTemporaryFile(dir=os.path.dirname(os.path.abspath(path)), delete=False) as f:
            f.write(data)
        try:
            if force:
                os.replace(f.name, path)
            else:
                os.link(f.name, path)
        finally:
            if os.path.lexists(f.name):
                os.unlink(f.name)
    except OSError as e:
        raise EngineError("OutputIo", str(e)) from e


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="echofold", description=__doc__.splitlines()[0])
    parser.add_argument("-V", "--version", action="version", version=f"echofold {__version__}")
    commands = parser.add_subparsers(dest="command", required=True)
    size = {"type": parse_size, "default": None}
    c = commands.add_parser("compress")
    c.add_argument("source")
    c.add_argument("target", nargs="?")
    c.add_argument("--method", default="m3")
    c.add_argument("--layout", default="index", choices=LAYOUTS)
    c.add_argument("--checksum", default="xxh3", choices=CHECKSUMS)
    c.add_argument("--block-size", type=parse_size, default=parse_size("8m"))
    for name in ("min-match", "seed-size", "target-chunk", "max-distance", "overlay-min-match", "overlay-distance"):
        c.add_argument(f"--{name}", **size)
    c.add_argument("--force", action="store_true")
    d = commands.add_parser("decompress")
    d.add_argument("source")
    d.add_argument("target", nargs="?")
    d.add_argument("--output-limit", type=parse_size, default=MOST_POSITION)
    d.add_argument("--force", action="store_true")
    for name in ("info", "test"):
        commands.add_parser(name).add_argument("source")
    return parser


def run(arguments: list[str], spark=None) -> int:
    from pyspark.sql import SparkSession

    from . import engine
    from .sources import streams

    try:
        a = _parser().parse_args(arguments)
        cfg = None
        if a.command == "compress":
            overlay = Overlay(*(v for v in (a.overlay_min_match, a.overlay_distance) if v)) if a.overlay_min_match else None
            cfg = MatchConfig(a.method, a.layout, a.checksum, a.block_size, a.min_match, a.seed_size, a.target_chunk, a.max_distance, overlay)
        try:
            target = _target(a) if a.command in ("compress", "decompress") else ""
            if a.source == "-":
                data = sys.stdin.buffer.read()
            else:
                with open(a.source, "rb") as f:
                    data = f.read()
        except OSError as e:
            raise EngineError("InputIo", str(e)) from e
        spark = spark or SparkSession.builder.getOrCreate()
        rows = spark.createDataFrame([(0, bytearray(data))], "id long, archive binary")
        if cfg:
            _publish(target, bytes(engine.compress(streams(rows, "id", "archive"), cfg).first()["archive"]), a.force)
            return 0
        archived = rows.withColumnRenamed("id", "stream_id")
        if a.command == "decompress":
            r = engine.decompress(archived, output_limit=a.output_limit).first()
        else:
            r = engine.inspect(archived).first()
        if r["status"] != "ok":
            raise EngineError(r["status"], a.source)
        if a.command == "decompress":
            _publish(target, bytes(r["payload"]), a.force)
        elif a.command == "info":
            print("\n".join(f"{k}: {v}" for k, v in r.asDict().items() if k != "stream_id"))
        return 0
    except EngineError as e:
        print(f"{e.message_id}: {e}", file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
