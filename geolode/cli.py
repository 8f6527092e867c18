"""Commands; each prints one JSON document, and an error's envelope with a non-zero exit."""

from __future__ import annotations

import argparse
import json
import sys

from geolode.errors import EngineError, from_spark
from geolode.limits import Limits, ResourceLimits
from geolode.plans import model as m


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _ref(name: str) -> m.ObjectRef:
    parts = name.split(".")
    if not 1 <= len(parts) <= 3 or not all(parts):
        raise EngineError("invalid_configuration", "a table is named by one to three parts")
    return m.ObjectRef(parts[-1], *([None] * (3 - len(parts)) + parts[:-1]))


def _engine(args):
    from geolode.engine import Engine

    spark = _session()
    tables = {}
    for item in args.table or []:
        name, _, path = item.partition("=")
        tables[name] = spark.read.parquet(path)
    return Engine(spark, tables, args.profile)


def _validate(args) -> dict:
    from geolode.plans import plan

    with open(args.file, "rb") as f:
        valid = plan.parse(f.read())
    return {"valid": True, "fingerprint": valid.fingerprint, "operation": valid.plan.operation.id}


def _inspect(args) -> dict:
    from geolode.sources.tables import inspect_ipc

    return inspect_ipc(args.file)


def _probe(args) -> dict:
    return _engine(args).capabilities()


def _describe(args) -> dict:
    return _engine(args).inspect(m.Operation("database.describe_object", _ref(args.name)))["document"]


def _read(args):
    order = tuple(m.FieldOrder(c.removesuffix(":desc"), "desc" if c.endswith(":desc") else "asc") for c in args.order_by or [])
    return m.Read(_ref(args.name), order_by=order, row_limit=args.max_rows)


def _stream(args):
    from geolode.cancel import Token
    from geolode.limits import Budget

    engine = _engine(args)
    budget = Budget(ResourceLimits(rows=args.max_rows, output_bytes=args.max_output_bytes, duration_s=args.timeout_ms / 1000))
    return engine.stream(engine.read(_read(args)), budget, Token(timeout_s=args.timeout_ms / 1000))


def _summary(args) -> dict:
    stream = _stream(args)
    for _ in stream:
        pass
    return {"rows": stream.metrics.rows, "batches": stream.metrics.batches, "bytes": stream.metrics.bytes, "fields": stream.schema.names}


def _ipc(args) -> dict:
    from geolode.sources.tables import write_ipc

    return write_ipc(_stream(args), args.out, args.max_output_bytes)


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise EngineError("invalid_configuration", message)


def main(argv: list[str] | None = None) -> int:
    parser = _Parser(prog="geolode")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run, takes in (("validate-plan", _validate, ("file",)), ("inspect-dataset", _inspect, ("file",)), ("database-probe", _probe, ()), ("describe", _describe, ("name",)), ("read-summary", _summary, ("name",)), ("read-ipc", _ipc, ("name", "out"))):
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        for t in takes:
            c.add_argument(t)
        c.add_argument("--table", action="append", help="NAME=PATH of a Parquet table")
        c.add_argument("--profile", default="open")
        c.add_argument("--max-rows", type=int)
        c.add_argument("--max-output-bytes", type=int)
        c.add_argument("--timeout-ms", type=int, default=Limits().timeout_ms)
        c.add_argument("--order-by", action="append")
    try:
        args = parser.parse_args(argv)
        print(json.dumps({"ok": True, "result": args.run(args)}, default=str))
        return 0
    except EngineError as e:
        error = e
    except OSError as e:
        error = EngineError("io", type(e).__name__)
    except Exception as e:
        error = from_spark(e, "read")
    print(json.dumps({"ok": False, "protocol_version": 1, "error": error.document()}))
    return 1


if __name__ == "__main__":
    sys.exit(main())
