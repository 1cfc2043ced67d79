"""Command-line verbs over a store: put, get, del, cas, scan, status. A `-` operand of cas means absent."""

from __future__ import annotations

import argparse
import sys

from logweave.api import Store
from logweave.session import session

SCAN_LIMIT = 1000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logweave", description=__doc__)
    p.add_argument("path", help="the store's folder; created by the first write")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, operands in {"put": ["key", "value"], "del": ["key"], "cas": ["key", "expect", "new"], "status": []}.items():
        v = verbs.add_parser(verb)
        for o in operands:
            v.add_argument(o)
    get = verbs.add_parser("get")
    get.add_argument("key")
    get.add_argument("--snapshot", type=int)
    scan = verbs.add_parser("scan")
    scan.add_argument("start")
    scan.add_argument("end", nargs="?")
    scan.add_argument("--limit", type=int, default=SCAN_LIMIT)
    scan.add_argument("--snapshot", type=int)
    return p


def absent(text: str) -> str | None:
    return None if text == "-" else text


def run(store: Store, a: argparse.Namespace) -> tuple[int, list[str]]:
    """Exit code and lines: 1 for a key that isn't there and for a lost swap."""
    if a.verb == "put":
        return 0, [f"ok {store.put(a.key, a.value)}"]
    if a.verb == "del":
        return 0, [f"ok {store.delete(a.key)}"]
    if a.verb == "get":
        value = store.get(a.key, a.snapshot)
        return (1, ["(not found)"]) if value is None else (0, [value.decode(errors="replace")])
    if a.verb == "cas":
        done, seen = store.cas(a.key, absent(a.expect), absent(a.new))
        return (0, ["ok"]) if done else (1, [f"failed, actual: {'(absent)' if seen is None else seen.decode(errors='replace')}"])
    if a.verb == "scan":
        rows = store.scan(a.start, a.end, a.limit, a.snapshot).collect()  # the limit bounds what is shown
        return 0, [f"{bytes(r['key']).decode(errors='replace')}\t{bytes(r['value']).decode(errors='replace')}" for r in rows]
    return 0, [f"last_seq {store.seq()}"]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session("logweave-cli")
    spark.sparkContext.setLogLevel("ERROR")
    code, lines = run(Store.open_or_create(spark, a.path), a)
    print("\n".join(lines))
    return code


if __name__ == "__main__":
    sys.exit(main())
