"""Run selected (or all) registered queries against their oracles.
usage: python tests/run_compare.py [sf_dir] [key ...]"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from compare import compare, duck  # noqa: E402
from quarry.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
keys = sys.argv[2:]
spark = local_session(8)
Q, O = E.queries(), E.oracle_sql()
con = duck(sf)
bad = 0
for k in (keys or sorted(Q)):
    t = time.time()
    try:
        df = Q[k](spark, sf)
        if k in O:
            probs, n = compare(df, con, O[k])
        else:
            probs, n = ["(no oracle)"], df.count()
    except Exception as e:  # noqa: BLE001
        probs, n = [f"ERROR {type(e).__name__}: {str(e)[:600]}"], -1
    ok = not probs or probs == ["(no oracle)"]
    bad += not ok
    print(f"{'OK ' if ok else 'BAD'} {k:28s} rows={n:<7d} {time.time()-t:6.1f}s {'; '.join(probs)}", flush=True)
print("failures:", bad)
