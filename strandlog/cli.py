"""Command line: record, verify, inspect, list, extract, repair, capabilities, watermark keygen / issue / detect.

Exit codes: 0 done, 1 error, 2 usage, 3 not verified, 4 nothing detected.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from . import engine, model
from .errors import EngineError
from .operators import identity, watermark


def _spark() -> SparkSession:
    return SparkSession.builder.appName("strandlog").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _print(row: dict) -> None:
    print(json.dumps(row, separators=(",", ":"), ensure_ascii=False))


def _code(text: str) -> int:
    value = int(text, 8) if text.startswith("0") and text.isdigit() and len(text) > 1 else int(text, 0)
    if not 0 <= value <= 0xFFFF:
        raise argparse.ArgumentTypeError("a code has 16 bits")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlog")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("capabilities")
    r = c.add_parser("record")
    r.add_argument("--archive", required=True)
    r.add_argument("--feed", action="append", required=True, metavar="LABEL=URI")
    for name in ("verify", "inspect"):
        c.add_parser(name).add_argument("archive")
    ls = c.add_parser("list")
    ls.add_argument("what", choices=["feeds"])
    ls.add_argument("archive")
    x = c.add_parser("extract")
    x.add_argument("archive")
    x.add_argument("--feed", required=True)
    x.add_argument("--output", required=True)
    x.add_argument("--fidelity", default="source-exact")
    rp = c.add_parser("repair")
    rp.add_argument("archive")
    rp.add_argument("--output", required=True)
    w = c.add_parser("watermark").add_subparsers(dest="action", required=True)
    k = w.add_parser("keygen")
    k.add_argument("--private-key", required=True)
    k.add_argument("--public-key", required=True)
    i = w.add_parser("issue")
    for name in ("--input", "--output", "--statement", "--private-key", "--feed-uuid", "--issuer", "--key-id"):
        i.add_argument(name, required=True)
    i.add_argument("--code", type=_code, required=True)
    for name in ("--issued-at", "--not-before", "--expires-at"):
        i.add_argument(name, type=int, required=True)
    i.add_argument("--band", choices=["W1", "W2"], default="W1")
    for name in ("detect", "watch"):
        d = w.add_parser(name)
        d.add_argument("input")
        d.add_argument("--statement")
        d.add_argument("--public-key")
        d.add_argument("--at", type=int)
    return p


def _issue(a: argparse.Namespace) -> int:
    s = identity.Statement(a.feed_uuid, a.code, a.issued_at, a.not_before, a.expires_at, a.issuer, a.key_id)
    with open(a.input, "rb") as f:
        wav, cose, frames = engine.watermark_issue(f.read(), s, a.private_key, a.band)
    identity.create_file(a.output, wav)
    try:
        identity.create_file(a.statement, cose)
    except EngineError:
        os.unlink(a.output)
        raise
    _print({"output": a.output, "statement": a.statement, "band": a.band, "code": a.code, "frames_embedded": frames})
    return 0


def _detect(a: argparse.Namespace) -> int:
    if (a.statement is None) != (a.public_key is None):
        print("strandlog: --statement and --public-key must be supplied together", file=sys.stderr)
        return 2
    with open(a.input, "rb") as f:
        found = watermark.detect(watermark.read_wav(f.read()))
    state, statement, problem = "absent", None, None
    if a.statement:
        with open(a.statement, "rb") as f:
            try:
                state, statement = identity.verify(f.read(64 << 20), a.public_key, int(time.time()) if a.at is None else a.at)
            except EngineError as e:
                state, problem = "malformed", e.message
    for o in found:
        hops = sum(x["band"] == o["band"] and x["code"] == o["code"] for x in found)
        bound = state == "valid" and statement.acoustic_code == o["code"]
        row = {"state": "signature_bound_candidate" if bound and hops >= 3 else "candidate"} | {c: o[c] for c in ("band", "code", "confidence", "start_frame", "end_frame")}
        row |= {"confirmation_hops": hops, "detection_statistic": "goertzel_bin_dominance", "waveform_spike": False, "authoritative": False, "replay_check": "unavailable_in_stateless_reference_detector", "statement_state": state}
        if statement:
            row["claimed_feed_uuid"] = statement.feed_uuid
        if bound:
            row["issuer"] = statement.issuer
        if problem:
            row["statement_error"] = problem
        _print(row)
    return 0 if found else 4


def run(a: argparse.Namespace) -> int:
    if a.command == "capabilities":
        _print(model.capabilities())
    elif a.command == "record":
        pairs = [f.partition("=") for f in a.feed]
        if not all(label and uri for label, _, uri in pairs):
            print("strandlog: --feed must be LABEL=URI", file=sys.stderr)
            return 2
        _print(engine.record([engine.Feed(uri, label) for label, _, uri in pairs], a.archive))
    elif a.command in ("verify", "inspect"):
        from .sources.archive import open_archive

        open_archive(a.archive)
        row = getattr(engine, a.command)(_spark(), [a.archive]).first().asDict()
        ok = row["ok"]
        shown = {k: v for k, v in row.items() if k not in ("archive_id", "error_code") and not (k == "feeds" and not ok)}
        _print(shown)
        return 0 if ok else 3
    elif a.command == "list":
        for row in engine.list_feeds(_spark(), a.archive).collect():
            _print(row.asDict())
    elif a.command == "extract":
        data = engine.extract_feed(_spark(), a.archive, a.feed, a.output, a.fidelity)
        _print({"output": a.output, "bytes": len(data), "fidelity": a.fidelity})
    elif a.command == "repair":
        _print(engine.repair(_spark(), a.archive, a.output))
    elif a.action == "keygen":
        identity.generate_key_pair(a.private_key, a.public_key)
        _print({"private_key": a.private_key, "public_key": a.public_key})
    elif a.action == "issue":
        return _issue(a)
    else:
        return _detect(a)
    return 0


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        return run(a)
    except EngineError as e:
        print(f"strandlog: {e.code}: {e.message}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
