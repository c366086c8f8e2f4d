"""Count scans, exchanges and reuse in the final plans of bound queries: plans.py [-d DIR] name ..."""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rampwise.bindings import catalog  # noqa: E402
from rampwise.session import local_session  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("-v", action="store_true", help="print the plan")
    ap.add_argument("names", nargs="+")
    args = ap.parse_args()
    spark = local_session("plans")
    for name in args.names:
        df = catalog.QUERIES[name](spark, args.d)
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
        final = text.split("+- == Initial Plan ==")[0]
        count = lambda p: len(re.findall(p, final))
        print(f"{name}: scans {count('FileScan')}, exchanges {count(r'Exchange hash|Exchange single|Exchange range|Exchange Round')}, "
              f"broadcasts {count('BroadcastExchange')}, reused {count('ReusedExchange|Reused')}, windows {count(r'Window \[')}, "
              f"merge joins {count('SortMergeJoin')}, loops {count('NestedLoop|Cartesian')}")
        if args.v:
            print(final)


if __name__ == "__main__":
    main()
