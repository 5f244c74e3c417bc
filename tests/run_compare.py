"""Compare every registered query with its DuckDB twin: python tests/run_compare.py [sf_dir] [names...]"""
import os, sys, time
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as E
from compare import compare
from vigil.session import get_session

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = get_session("local[8]", shuffle_partitions=8)
spark.sparkContext.setLogLevel("ERROR")
Q, O = E.queries(), E.oracle_sql()
bad = 0
for name in (names or sorted(Q)):
    t = time.time()
    try:
        if name in O:
            ok, msg = compare(Q[name](spark, sf), sf, O[name])
        else:
            n = Q[name](spark, sf).count()
            ok, msg = True, f"{n} rows (no oracle)"
    except Exception as e:  # report and go on
        ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
    bad += not ok
    print(f"{'OK ' if ok else 'BAD'} {name:28s} {time.time()-t:6.1f}s {msg}", flush=True)
print("failures:", bad)
