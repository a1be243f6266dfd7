"""Command line: parse, debug-layout, categorise, report, triage, chart, migrate-rules."""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.config.errors import BalanceContinuityError, CoercionError, EngineError, InputError, ProfileError
from tillweave.config.profile import find_profile
from tillweave.config.rules import chain, read_rules, to_yaml
from tillweave.config.strategies import BALANCE_CHECKS
from tillweave.functions.columns import flag_text, in_range, parse_money
from tillweave.operators import categorise as K
from tillweave.operators import flows, integrity, reports
from tillweave.operators.ledger import normalise
from tillweave.operators.netting import net_transfers, unmatched
from tillweave.render import page, svg
from tillweave.session import build_session, written
from tillweave.sources import csv_files, layout, notebook_rules
from tillweave.triage import Group, RulesFile, ask


def _spark() -> SparkSession:
    active = SparkSession.getActiveSession()
    return active or build_session("tillweave-cli", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})


def parse(args: argparse.Namespace) -> str:
    spark, profile = _spark(), find_profile(args.profile)
    frames = []
    for path in args.files:
        if profile.source == "csv":
            raw = csv_files.read_export(spark, path, profile)
        else:
            words = csv_files.read_words(spark, path)
            layout.check_layout(words, profile)
            raw = layout.raw_rows(words, profile)
        frames.append(integrity.coerce(raw, profile))
    rows = written(csv_files.union_in_order(frames), "parsed")
    if bad := rows.filter("_bad").count():
        raise CoercionError(f"{bad} row(s) hold a date or amount that can't be read")
    rows = rows.drop("_bad")
    if BALANCE_CHECKS[profile.check_balance]():
        first = integrity.balance_violations(rows).orderBy("ord").select("source_file", "row", "page").first()
        if first:
            raise BalanceContinuityError(f"balance does not follow in {first.source_file}, row {first.row}" + (f", page {first.page}" if first.page else ""))
    kept = integrity.dedupe(rows)
    for w in integrity.period_warnings(integrity.source_periods(kept)).orderBy("start").collect():
        print(f"warning: {w.kind} between {w.previous_file} (to {w.previous_end}) and {w.source_file} (from {w.start})", file=sys.stderr)
    csv_files.write_rows(csv_files.ledger_text(kept), args.output, ["ord"])
    return f"wrote {kept.count()} transactions to {args.output}"


def debug_layout(args: argparse.Namespace) -> str:
    spark, profile = _spark(), find_profile(args.profile)
    if profile.source != "pdf":
        raise ProfileError("debug-layout needs a profile of pages")
    for name, df in layout.debug_layout(csv_files.read_words(spark, args.file), profile, args.page, args.max_rows).items():
        print(f"{name}:")
        for r in df.collect():
            print("  ", r.asDict())
    return "done"


def _text_frame(path: str, *required: str) -> DataFrame:
    return csv_files.read_text_frame(_spark(), path, required)


def _amounts(text: DataFrame) -> DataFrame:
    """text with the amounts as numbers in _amount; the cells stay as they are."""
    typed = text.withColumn("_amount", parse_money(F.col("amount"), ""))
    if bad := typed.filter(F.col("_amount").isNull()).agg(F.count("*").alias("n"), F.min("ord").alias("first")).first():
        if bad.n:
            raise InputError(f"column amount: {bad.n} cell(s) can't be read, the first in row {bad.first}")
    return typed


def categorise(args: argparse.Namespace) -> tuple[str, int]:
    rules = chain(read_rules(args.rules))
    text = _amounts(_text_frame(args.input, *csv_files.CATEGORISE_COLUMNS))
    names = [c for c in text.columns if c not in ("ord", "_amount", "category", "subcategory", "is_transfer")]
    rows = written(K.categorise(text, rules), "categorised")
    csv_files.write_rows(rows.select(*names, "category", "subcategory", flag_text(F.col("is_transfer")).alias("is_transfer"), "ord"), args.output, ["ord"])
    sums = K.gate(rows.withColumn("amount", F.col("_amount")), args.tolerance).first()
    said = f"categorised {sums.rows - sums.uncategorised} of {sums.rows} row(s); {sums.uncategorised} uncategorised; wrote {args.output}"
    return said if sums.passes else f"{said}\nerror: uncategorised amounts exceed the tolerance over {sums.uncategorised} row(s)", 0 if sums.passes else 1


def report(args: argparse.Namespace) -> str:
    text = _amounts(_text_frame(args.input, "category", *csv_files.CATEGORISE_COLUMNS))
    open_ = text.filter(F.col("category") == "")
    csv_files.write_rows(open_.drop("_amount"), args.output, [F.desc(F.abs(parse_money(F.col("amount"), ""))), "ord"])
    out = args.agg_output or str(Path(args.output).with_name(f"{Path(args.output).stem}_by_description{Path(args.output).suffix}")) + "/" * args.output.endswith("/")
    by = reports.by_description(open_.withColumn("amount", F.col("_amount")))
    # Ties come in the order of the row report: by the largest single row, then by place.
    largest = open_.groupBy("description").agg(F.max(F.abs("_amount")).alias("_largest"))
    ordered = by.join(largest, "description")
    order = [F.desc(F.abs("total_amount")), F.desc("_largest"), "first_ord"]
    shown = ordered.withColumnRenamed("amount", "total_amount").withColumnRenamed("rows", "count").orderBy(*order).select("description", "total_amount", "count")
    csv_files.write_rows(shown, out)
    return f"wrote {open_.count()} uncategorised row(s) to {args.output} and {by.count()} distinct description(s) to {out}"


def triage(args: argparse.Namespace) -> str:
    path = Path(args.rules)
    personal = read_rules(path) if path.exists() else []
    text = _amounts(_text_frame(args.input, *csv_files.CATEGORISE_COLUMNS))
    rows = written(text.withColumn("amount", F.col("_amount")), "triage")
    before = K.uncategorised(K.categorise(rows, chain(personal))).count()
    groups = reports.triage_groups(K.categorise(rows, chain(personal))).join(reports.description_account(rows), "description")
    listed = [Group(g.description, g.rows, g.amount, g.account) for g in groups.orderBy(F.desc(F.abs("amount")), "first_ord").toLocalIterator()]
    if not listed:
        return "no uncategorised transactions found; nothing to triage"
    menu = sorted({r.category for r in chain(personal)})
    accepted, skipped = ask(listed, menu, RulesFile(path), sys.stdin, sys.stdout, personal.append)
    after = K.uncategorised(K.categorise(rows, chain(personal))).count()
    return f"\ntriage complete: {accepted} rule(s) accepted, {skipped} skipped; uncategorised before={before} after={after}"


SAVING = "saving"


def _savings_figure(rows: DataFrame) -> str:
    series = {"cumulative savings": [(r.date, r.cumulative) for r in reports.savings_cumulative(rows, SAVING).collect()]}
    for r in reports.balance_trajectory(rows).orderBy("account", "date").toLocalIterator():
        series.setdefault(f"balance {r.account}", []).append((r.date, r.balance))
    return svg.lines(series)


def _monthly_figure(rows: DataFrame) -> str:
    return svg.stacked_bars([(r.month, r.category, r.amount) for r in reports.month_totals(rows).collect()])


def _flow_figure(netted: DataFrame, min_share: str, currency: str | None) -> str:
    links = written(flows.all_links(netted, min_share), "links")
    return svg.flows([r.asDict() for r in links.collect()], [r.asDict() for r in flows.node_places(links).collect()], currency)


def _date(text: str, name: str) -> dt.date:
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError:
        raise InputError(f"{name} must be a date like 2024-01-31") from None


def chart(args: argparse.Namespace) -> str:
    first, last = _date(args.date_from, "--from"), _date(args.date_to, "--to")
    if first > last:
        raise InputError("--from must not be after --to")
    text = _text_frame(args.input, *csv_files.CHART_COLUMNS)
    frame = written(normalise(csv_files.typed_ledger(text)), "typed")
    inside = frame.filter(in_range(str(first), str(last)))
    netted = written(net_transfers(inside, args.window_days), "netted")
    total, kept = frame.count(), netted.count()
    if args.what == "overview" and not kept:
        raise InputError(f"no rows in range ({total} row(s) read)")
    out = Path(args.out_dir)
    out.mkdir(parents=True, exist_ok=True)
    alone = unmatched(netted)
    left = out / "unmatched_transfers.csv"
    original = [c for c in text.columns if c != "ord"]
    csv_files.write_single_csv(alone.withColumn("is_transfer", flag_text(F.col("is_transfer"))).select(*original, "ord"), str(left), ["ord"])
    files = [left]
    if args.what == "overview":
        body = page.overview(_overview(frame, netted, alone, first, last, args.min_share))
    else:
        figure = {"sankey": lambda: _flow_figure(netted, args.min_share, None), "monthly": lambda: _monthly_figure(netted), "savings": lambda: _savings_figure(netted)}[args.what]()
        body = page.document(args.what, figure)
    if args.what == "monthly":
        files.insert(0, out / "monthly_delta.csv")
        csv_files.write_single_csv(reports.month_delta(netted), str(files[0]), ["month", "category"])
    files.insert(0, out / f"{args.what}.html")
    files[0].write_text(body, encoding="utf-8")
    counts = reports.run_counts(netted, F.lit(True)).first()
    return f"read {total} row(s); {kept} in range; {counts.uncategorised} uncategorised; {alone.count()} unmatched transfer(s); wrote {', '.join(map(str, files))}"


def _overview(frame: DataFrame, netted: DataFrame, alone: DataFrame, first: dt.date, last: dt.date, min_share: str) -> dict:
    tiles = reports.stat_tiles(netted).first().asDict()
    listed = lambda df: [r.asDict() for r in df.collect()]
    return {
        "first": first,
        "last": last,
        "made": dt.datetime.now(),
        "tiles": tiles,
        "accounts": [r.account for r in netted.select("account").distinct().orderBy("account").collect()],
        "flows": _flow_figure(netted, min_share, tiles["currency"]),
        "categories": listed(reports.top_categories(netted)),
        "merchants": listed(reports.top_merchants(netted)),
        "movers": listed(reports.top_movers(frame, str(first), str(last)).orderBy("direction", "rank")),
        "covered": reports.prior_coverage(frame, str(first), str(last)).first().covered,
        "monthly": _monthly_figure(netted) if page.months_touched(first, last) > 1 else None,
        "savings": _savings_figure(netted),
        "notables": listed(reports.notables(netted)),
        "health": reports.health(netted).first().asDict(),
        "unmatched": alone.count(),
        "coverage": listed(reports.account_coverage(netted).orderBy("account")),
    }


def migrate_rules(args: argparse.Namespace) -> str:
    out = Path(args.output)
    if out.exists() and not args.force:
        raise InputError(f"{out.name} exists; --force overwrites it")
    rules = notebook_rules.migrate(_spark(), args.notebook)
    out.write_text(to_yaml(rules), encoding="utf-8")
    read_rules(out)
    per = {a: sum(r.account == a for r in rules) for a in notebook_rules.TARGETS.values()}
    return f"wrote {len(rules)} rule(s) ({', '.join(f'{a} {n}' for a, n in per.items())}; {sum(r.transfer for r in rules)} transfers) to {out}"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tillweave")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, **options) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flag, spec in options.items():
            p.add_argument("--" + flag.replace("_", "-"), **spec)
        return p

    need = {"required": True}
    command("parse", parse, profile=need, output=need).add_argument("files", nargs="+")
    command("debug-layout", debug_layout, profile=need, page={"type": int}, max_rows={"type": int, "default": 5}).add_argument("file")
    command("categorise", categorise, rules=need, **{"in": need | {"dest": "input"}, "out": need | {"dest": "output"}}, tolerance={"default": "0"})
    command("report", report, **{"in": need | {"dest": "input"}, "out": need | {"dest": "output"}}, agg_out={"dest": "agg_output"})
    command("triage", triage, **{"in": need | {"dest": "input"}}, rules=need)
    what = command("chart", chart, **{"in": need | {"dest": "input"}, "from": need | {"dest": "date_from"}, "to": need | {"dest": "date_to"}, "out": need | {"dest": "out_dir"}}, window_days={"type": int, "default": 3}, min_share={"default": flows.MIN_SHARE})
    what.add_argument("what", choices=("sankey", "monthly", "savings", "overview"))
    command("migrate-rules", migrate_rules, out=need | {"dest": "output"}, force={"action": "store_true"}).add_argument("notebook")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        said = args.run(args)
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    text, code = said if isinstance(said, tuple) else (said, 0)
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
