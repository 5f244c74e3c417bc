"""Compare each registered query's Spark schema with its DuckDB twin's column types:
python tests/check_schemas.py [sf_dir]"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from vigil import catalog  # noqa: E402
from vigil.session import get_session  # noqa: E402
from vigil.sources.fixtures import DRIVER_TABLES  # noqa: E402

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
                 "timestamp_ntz": "TIMESTAMP", "binary": "BLOB", "date": "DATE",
                 "timestamp": "TIMESTAMP WITH TIME ZONE", "smallint": "SMALLINT"}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in DRIVER_TABLES:
        path = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    bad = 0
    for key in sorted(catalog.ORACLE):
        sp = {f.name: f.dataType.simpleString() for f in catalog.QUERIES[key](spark, sf).schema.fields}
        dk = {r[0]: r[1] for r in con.execute("describe " + catalog.ORACLE[key]).fetchall()}
        diffs = [(c, sp.get(c), dk.get(c)) for c in sorted(set(sp) | set(dk))
                 if SPARK_TO_DUCK.get(sp.get(c), sp.get(c)) != dk.get(c)]
        if diffs:
            bad += 1
            print(key, diffs)
    print("keys with type differences:", bad)


if __name__ == "__main__":
    main()
