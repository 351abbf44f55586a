"""Commands over a store: logs (ingest, logs, summary, dfg, variants, rules, tie-breaks, otlp, otlp-verify, compare) and agents' runs (trace-*)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks, dfg, filters, reports, reviews, rules, spans, variants
from .operators.eventlog import EventLog
from .policy import Policy
from .schema import MESSAGES, RUNS, SPANS
from .session import session
from .sources import csv, jsonl, otlp, store, tables, viz, xes


def _show(df: DataFrame, limit: int = 1000) -> None:
    for row in df.limit(limit).collect():
        print(json.dumps(row.asDict(recursive=True), default=str))


def _source(spark: SparkSession, path: str, case_attributes: str | None, helpdesk: bool) -> tuple[DataFrame, DataFrame | None]:
    """Raw events and case attributes of a file, by its suffix."""
    if ".xes" in path:
        return xes.read(spark, path)
    attrs = csv.read_case_attributes(spark, case_attributes) if case_attributes else None
    return csv.read_events(spark, path, csv.HELPDESK if helpdesk else None), attrs


def _load(spark: SparkSession, args: argparse.Namespace, log_id: str) -> EventLog:
    log = store.load(spark, args.store, log_id)
    if args.flow:
        log = filters.by_flow(log, *args.flow)
    return log if args.coverage is None else filters.by_variant_coverage(log, args.coverage)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="procspark", description=__doc__)
    p.add_argument("--store", required=True)
    p.add_argument("--policy")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, filtered: bool = True, **kw) -> argparse.ArgumentParser:
        c = sub.add_parser(name, **kw)
        if filtered:
            c.add_argument("log")
            c.add_argument("--flow", action="append")
            c.add_argument("--coverage", type=float)
        return c

    c = command("ingest", False)
    c.add_argument("path")
    c.add_argument("--log-id", required=True)
    c.add_argument("--case-attributes")
    c.add_argument("--helpdesk", action="store_true")
    c.add_argument("--sensitivity", action="store_true")
    command("logs", False)
    command("summary")
    c = command("dfg")
    c.add_argument("--annotate", choices=["count", "time"], default="count")
    c.add_argument("--keep-fraction", type=float)
    c.add_argument("--top", type=int, default=10)
    c.add_argument("--dot")
    c.add_argument("--svg")
    c = command("variants")
    c.add_argument("--top", type=int, default=20)
    c = command("rules")
    c.add_argument("--rule", action="append")
    c.add_argument("--out")
    c = command("tie-breaks")
    c.add_argument("--out")
    c = command("otlp")
    c.add_argument("--out", required=True)
    c.add_argument("--batch-spans", type=int, default=512)
    c.add_argument("--from-xes")
    c.add_argument("--max-cases", type=int)
    c = command("tables")
    c.add_argument("--from-xes", required=True)
    c.add_argument("--out", required=True)
    c = command("otlp-verify")
    c.add_argument("--against", required=True)
    c = command("sample")
    c.add_argument("--cases", type=int, required=True)
    c.add_argument("--floor", type=int, default=0)
    c.add_argument("--as-log", required=True)
    c = command("compare")
    c.add_argument("other")
    for name in ("trace-list", "trace-show", "trace-export", "trace-patterns"):
        c = command(name, False)
        c.add_argument("--agents", required=True, help="a folder with runs.jsonl, spans.jsonl and messages.jsonl")
        c.add_argument("--write", action="append", default=[], metavar="TOOL=ACTIVITY", help="a tool that writes, and its activity")
        if name == "trace-list":
            c.add_argument("--sort", choices=["arrival", "retries", "multi-item", "refusals", "violations"], default="retries")
            c.add_argument("--limit", type=int, default=30)
        elif name == "trace-show":
            c.add_argument("run", help="the beginning of a run's id")
        elif name == "trace-export":
            c.add_argument("--out", required=True)
        else:
            c.add_argument("--patterns", required=True)
    c = command("trace-annotate", False)
    c.add_argument("run")
    c.add_argument("note")
    c.add_argument("--author", default="human")
    c.add_argument("--pattern")
    return p


def _traces(spark: SparkSession, args: argparse.Namespace, policy: Policy) -> int:
    """Commands on agents' runs; notes are kept in the store."""
    notes = f"{args.store}/notes"
    if args.command == "trace-annotate":
        print(reviews.annotate(spark, notes, args.run, args.note, args.author, args.pattern))
        return 0
    runs, rows, said = (jsonl.read(spark, f"{args.agents}/{n}.jsonl", kind) for n, kind in (("runs", RUNS), ("spans", SPANS), ("messages", MESSAGES)))
    tools = dict(w.split("=", 1) for w in args.write)
    got = reviews.records(runs, rows, said, list(tools), reports.findings_by_run(rows, runs, tools, policy))
    if args.command == "trace-list":
        top = spans.review(got.withColumn("flags", reviews.flags()), args.sort)
        _show(top.select("run_id", "scenario_id", "role", "tool_calls", "flags", "rules"), args.limit)
    elif args.command == "trace-show":
        one = got.where(F.col("run_id").startswith(args.run)).orderBy("run_id").limit(1).collect()
        if not one:
            print(f"no run begins with {args.run!r}", file=sys.stderr)
            return 1
        print(json.dumps(one[0].asDict(recursive=True), default=str, indent=1))
        _show(reviews.read_notes(spark, notes).where(F.col("run_id") == one[0].run_id).orderBy("noted_at", "note_id"))
    elif args.command == "trace-export":
        jsonl.write(got, args.out)
    else:
        _show(reviews.pattern_report(got, reviews.read_notes(spark, notes), reviews.load_patterns(args.patterns)).orderBy("pattern"))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or session()
    policy = Policy.load(args.policy) if args.policy else Policy()
    if args.command == "ingest":
        raw, attrs = _source(spark, args.path, args.case_attributes, args.helpdesk)
        store.save(EventLog.build(raw, policy.activity_rank, attrs, log_id=args.log_id, source=args.path), args.store)
        if args.sensitivity:
            _show(variants.order_sensitivity(raw, policy.activity_rank))
        return 0
    if args.command == "tables":
        print(json.dumps(tables.convert(spark, args.from_xes, args.out), indent=1, sort_keys=True))
        return 0
    if args.command.startswith("trace-"):
        return _traces(spark, args, policy)
    if args.command == "logs":
        _show(store.logs(spark, args.store))
        return 0
    if args.command == "otlp" and args.from_xes:
        raw, attrs = xes.read(spark, args.from_xes, max_cases=args.max_cases)
        log = EventLog.build(raw, policy.activity_rank, attrs, log_id=args.log, source=args.from_xes)
    else:
        log = _load(spark, args, args.log)
    if args.command == "summary":
        _show(log.summary())
        _show(variants.summary(log))
    elif args.command == "dfg":
        graph = dfg.build(log)
        graph = graph if args.keep_fraction is None else graph.filter_edges(keep_fraction=args.keep_fraction)
        for path, draw in ((args.dot, viz.dot), (args.svg, viz.svg)):
            if path:
                with open(path, "w") as f:
                    f.write(draw(graph))
        _show(graph.bottlenecks(args.top) if args.annotate == "time" else graph.top_edges(args.top))
    elif args.command == "variants":
        _show(variants.variant_table(log).orderBy("variant_rank").limit(args.top))
        _show(variants.coverage_curve(log))
    elif args.command == "rules":
        got = rules.evaluate(log, policy, args.rule)
        _show(rules.report(got))
        if args.out:
            rules.flat(got.violations, None).write.csv(args.out, header=True, mode="overwrite")
    elif args.command == "tie-breaks":
        tied = log.tie_broken_cases().orderBy("case_id")
        tied.write.csv(args.out, header=True, mode="overwrite") if args.out else _show(tied)
    elif args.command == "otlp":
        if args.max_cases is not None and not args.from_xes:
            log = log.keep(log.cases.orderBy("case_id").limit(args.max_cases), max_cases=str(args.max_cases))
        otlp.write(log, args.out, batch_spans=args.batch_spans)
        facts = otlp.manifest(log, otlp.Header.of(log), spark.read.text(args.out))
        print(otlp.disclosure(facts))
    elif args.command == "otlp-verify":
        wrong = otlp.verify(spark, args.against, log).collect()
        for r in wrong:
            print(f"{r.problem}: {r.n}")
        return int(any(r.n for r in wrong))
    elif args.command == "sample":
        drawn = checks.stratified_sample(log, args.cases, args.floor)
        store.save(EventLog(drawn.events, drawn.cases, args.as_log, log.source, log.license, log.attribution), args.store)
    elif args.command == "compare":
        other = _load(spark, args, args.other)
        said = dfg.alphabet_overlap(log, other).first().warning
        if said:
            print(f"warning: {said}", file=sys.stderr)
        _show(dfg.diff(dfg.build(log), dfg.build(other)).orderBy(F.abs("share_delta").desc(), "src", "dst"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
