"""python -m rinsework.cli clean FILE -o OUT | clean-document PATH -o FOLDER | profile FILE | serve

Exit codes: 0 done, 1 the input is missing or can't be read, 2 the cleaning would lose too much."""

from __future__ import annotations

import argparse
import hmac
import json
import os
import sys
from pathlib import Path

from rinsework.session import get_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rinsework", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("clean", help="clean a table")
    c.add_argument("dataset")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--delta-dir", "--store", dest="store", default=None, help="folder of the version store")
    c.add_argument("--report-dir", default=None)
    c.add_argument("--auto-approve", action="store_true", help="run steps that need a review too, and commit a blocked result")
    c.add_argument("--columns", default=None, help="only these, separated by commas")
    c.add_argument("--no-resolve-nulls", action="store_true")
    c.add_argument("--compat", action="store_true", help="run all steps; measure the loss before invalid rows go")
    d = sub.add_parser("clean-document", help="extract and clean the entities of documents")
    d.add_argument("path")
    d.add_argument("-o", "--output", required=True)
    d.add_argument("--approve-all", action="store_true", help="all but the risky")
    f = sub.add_parser("profile", help="print a table's profile")
    f.add_argument("dataset")
    s = sub.add_parser("serve", help="HTTP service; needs RINSEWORK_SECRET and RINSEWORK_USERS (a JSON file: user to [password, role])")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8000)
    s.add_argument("--store", required=True)
    return p


def clean(args: argparse.Namespace) -> int:
    from rinsework.operators import checks
    from rinsework.plans import provenance
    from rinsework.plans.flow import Blocked, clean_table
    from rinsework.sources.formats import load, save
    from rinsework.sources.versions import VersionStore

    if "://" not in args.dataset and not os.path.exists(args.dataset):
        print(f"no such file: {args.dataset}", file=sys.stderr)
        return 1
    spark = get_session()
    data = load(spark, args.dataset)
    columns = [c.strip() for c in args.columns.split(",")] if args.columns else None
    store = VersionStore(spark, args.store) if args.store else None
    try:
        found, done = clean_table(data.df, store, columns, args.auto_approve, not args.no_resolve_nulls, compat=args.compat)
    except Blocked as e:
        print(f"blocked: {'; '.join(e.report.reasons)}", file=sys.stderr)
        return 2
    save(done.df, args.output)
    report = {"rows_in": found.profile.meta["rows"], "rows_out": done.df.count(), "quality_score": found.score, "steps": [s.as_dict() for s in done.steps], "review": [s.as_dict() for s in found.plan.review], "nulls": vars(done.nulls), "validation": vars(done.validation), "loss": {**vars(done.loss), "utility": vars(done.loss.utility)}}
    if args.report_dir:
        folder = Path(args.report_dir)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "report.json").write_text(json.dumps(report, indent=2, default=str))
        checks.export_suite(checks.checks_of(done.steps, done.df.columns, columns), str(folder / "suite.json"))
        key = os.environ.get("RINSEWORK_SECRET", "").encode()
        record = done.manifest or provenance.manifest(provenance.content_hash(data.df), provenance.content_hash(done.df), report["steps"], report["loss"])
        provenance.write(provenance.sign(record, key) if key else record, str(folder / "provenance.json"), str(folder / "provenance.html"))
    print(json.dumps({k: report[k] for k in ("rows_in", "rows_out", "quality_score")}))
    return 0


def clean_document(args: argparse.Namespace) -> int:
    from rinsework.exports import export_all
    from rinsework.operators.governance import Approvals
    from rinsework.plans.flow import clean_documents
    from rinsework.sources.documents import read_documents, rejected, texts

    if "://" not in args.path and not os.path.exists(args.path):
        print(f"no such file: {args.path}", file=sys.stderr)
        return 1
    spark = get_session()
    left = rejected(spark, args.path).orderBy("path").collect()  # names of files, not documents
    for r in left:
        print(f"left out ({r.reason}, {r.length} bytes): {r.path}", file=sys.stderr)
    docs = read_documents(spark, args.path).persist()
    done = clean_documents(spark, texts(docs), docs, Approvals(all_but_high_risk=args.approve_all))
    export_all(done, args.output)
    print(json.dumps({**done.validation, "left_out": len(left)} if isinstance(done.validation, dict) else done.validation, default=str))
    return 0


def profile(args: argparse.Namespace) -> int:
    from rinsework.operators.profile import profile as measure
    from rinsework.sources.formats import load

    if "://" not in args.dataset and not os.path.exists(args.dataset):
        print(f"no such file: {args.dataset}", file=sys.stderr)
        return 1
    print(measure(load(get_session(), args.dataset).df).to_json())
    return 0


def run_service(args: argparse.Namespace) -> int:
    from rinsework.service import Service, serve

    users = json.loads(Path(os.environ["RINSEWORK_USERS"]).read_text())
    fits = lambda u, p: u in users and hmac.compare_digest(str(users[u][0]).encode(), p.encode())
    service = Service(get_session(), args.store, os.environ["RINSEWORK_SECRET"].encode(), lambda u, p: users[u][1] if fits(u, p) else None)
    serve(service, args.host, args.port).serve_forever()
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return {"clean": clean, "clean-document": clean_document, "profile": profile, "serve": run_service}[args.command](args)


if __name__ == "__main__":
    sys.exit(main())
