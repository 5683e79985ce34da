"""Writes the query index: every registered key, whether it has a DuckDB oracle, and the
first paragraph of its docstring.

    python tools/query_index.py > QUERIES.md
"""

from __future__ import annotations

import inspect
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chartq.plans.registry import DOCS, ORACLE, QUERIES, load_all  # noqa: E402


def main() -> None:
    load_all()
    print("# Registered queries\n")
    print(f"{len(QUERIES)} queries, {sum(k in ORACLE for k in QUERIES)} with a DuckDB oracle. "
          "Each takes `(spark, sf_dir)` and reads the driver tables under `sf_dir`.\n")
    print("| key | module | oracle | what it computes |")
    print("|---|---|---|---|")
    for k, fn in QUERIES.items():
        doc = DOCS.get(k) or inspect.getdoc(fn) or ""
        first = " ".join(doc.split("\n\n")[0].split())
        mod = fn.__module__.rsplit(".", 1)[-1]
        print(f"| `{k}` | {mod} | {'SQL' if k in ORACLE else 'rows'} | {first.replace('|', '/')} |")


if __name__ == "__main__":
    main()
