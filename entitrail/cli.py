"""The command line: ``mark``, ``mark-batch``, ``validate`` and ``labels``.

Results go to standard output or a file, messages to standard error. Any error ends with status 2 before a file is
written.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from .config import MatchingConfig
from .operators.export import labeling_config
from .plans.marking import Marking, mark, mark_batch
from .sources.batch import read_batch, with_texts
from .sources.catalog import catalog_frame, parse_catalog
from .sources.files import distinct_paths, read_utf8, write_utf8_atomic

log = logging.getLogger("entitrail")
FORMATS = ("predictions", "occurrences", "annotations")


def _session(progress: bool | None) -> SparkSession:
    shown = sys.stderr.isatty() if progress is None else progress
    spark = SparkSession.builder.appName("entitrail").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", str(shown).lower()).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _json(frame: DataFrame, column: str, key: str) -> list:
    return [json.loads(r[column]) for r in frame.orderBy(key).select(column).collect()]


def _payloads(marking: Marking, form: str, evidence: bool) -> tuple[list, list]:
    reports = _json(marking.evidence(), "report", marking.key) if evidence or form == "occurrences" else []
    if form == "occurrences":
        return reports, reports
    return _json(marking.annotations() if form == "annotations" else marking.predictions(), "task", marking.key), reports


def _put(value: object, path: str | None, pretty: bool) -> None:
    text = json.dumps(value, ensure_ascii=False, indent=2 if pretty else None)
    if path:
        write_utf8_atomic(path, text)
    else:
        print(text)


def _config(args: argparse.Namespace) -> MatchingConfig:
    return MatchingConfig(max_errors=args.max_errors, fuzzy_enabled=not args.disable_fuzzy)


def _mark(args: argparse.Namespace) -> None:
    distinct_paths([x for x in (args.objects, args.text) if x], [x for x in (args.output, args.evidence_output) if x])
    catalog = parse_catalog(read_utf8(args.objects))
    if args.text:
        text = read_utf8(args.text)
    elif sys.stdin.isatty():
        raise ValueError("give --text or a text on standard input")
    else:
        text = sys.stdin.buffer.read().decode("utf-8")
    if not text:
        raise ValueError("the text must not be empty")
    spark = _session(args.progress)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    payload, reports = _payloads(mark(docs, catalog_frame(spark, [("catalog", catalog)]), _config(args)), args.format, bool(args.evidence_output))
    if args.evidence_output:
        _put(reports[0], args.evidence_output, args.pretty)
    _put(payload[0] if args.format == "occurrences" else payload, args.output, args.pretty)


def _mark_batch(args: argparse.Namespace) -> None:
    distinct_paths(args.csv, [x for x in (args.output, args.evidence_output) if x])
    spark = _session(args.progress)
    rows = with_texts(read_batch(spark, args.csv), args.txts_dir)
    marking = mark_batch(rows, _config(args))
    payload, reports = _payloads(marking, args.format, bool(args.evidence_output))
    skipped = rows.where("text is null").select("source_csv", "row_number", "text_file").collect()
    for r in skipped:
        log.warning("%s: row %d: skipped, no text file %s", r.source_csv, r.row_number, r.text_file)
    if args.evidence_output:
        _put(reports, args.evidence_output, args.pretty)
    _put(payload, args.output, args.pretty)
    log.info("marked %d rows, skipped %d", len(payload), len(skipped))


def _validate(args: argparse.Namespace) -> None:
    parse_catalog(read_utf8(args.objects))
    print("The catalog is valid.")


def _labels(args: argparse.Namespace) -> None:
    if args.output:
        write_utf8_atomic(args.output, labeling_config())
    else:
        print(labeling_config(), end="")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="entitrail", description="Find mentions of known entities in texts.")
    commands = top.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--output")
    shared.add_argument("--evidence-output")
    shared.add_argument("--format", choices=FORMATS, default=FORMATS[0])
    shared.add_argument("--max-errors", type=int, default=1)
    shared.add_argument("--disable-fuzzy", action="store_true")
    shared.add_argument("--pretty", action="store_true")
    shared.add_argument("--progress", action=argparse.BooleanOptionalAction, default=None, help="a progress bar on standard error; by default if that is a terminal")
    shared.add_argument("-v", "--verbose", action="count", default=0)
    one = commands.add_parser("mark", parents=[shared], help="mark one text with one catalog")
    one.add_argument("--objects", required=True)
    one.add_argument("--text")
    one.set_defaults(run=_mark)
    many = commands.add_parser("mark-batch", parents=[shared], help="mark the texts that CSV rows name, each with its own catalog")
    many.add_argument("csv", nargs="+")
    many.add_argument("--txts-dir")
    many.set_defaults(run=_mark_batch)
    check = commands.add_parser("validate", help="check a catalog")
    check.add_argument("--objects", required=True)
    check.set_defaults(run=_validate)
    config = commands.add_parser("labels", help="the labelling configuration of an annotation tool")
    config.add_argument("--output")
    config.set_defaults(run=_labels)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=[logging.WARNING, logging.INFO, logging.DEBUG][min(2, getattr(args, "verbose", 0))])
    try:
        args.run(args)
    except Exception as e:  # whatever stops a worker arrives wrapped by Spark
        print(f"Error: {str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
