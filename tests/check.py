"""python -m tests.check [sf] [query ...]: run queries, time them, compare with the oracle."""

from __future__ import annotations

import sys
import time

from folioscope.session import build_session
from tests.oracle import connect, differences

import __spark_entry__ as entry


def main() -> None:
    sf = f"/root/testdata/{sys.argv[1]}" if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session(master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        started = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracle:
                found = differences(df, con, oracle[name])
                note = "ok" if not found else "DIFF " + " | ".join(found)
            else:
                note = f"rows {df.count()} (no oracle)"
        except Exception as e:  # report and go on to the next query
            note = "ERROR " + str(e)[:600]
        bad += note.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - started:6.1f}s {note}"[:1500], flush=True)
    print("failing:", bad)


if __name__ == "__main__":
    main()
