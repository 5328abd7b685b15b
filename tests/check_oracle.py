"""Run queries against the oracle: python tests/check_oracle.py SF_DIR [name-prefix ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from creatorlens.session import build_session, drop_scratch  # noqa: E402
from tests.compare import connect, diff  # noqa: E402


def main(sf_dir: str, prefixes: list[str]) -> int:
    spark = build_session(
        "oracle-check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                res = diff(df, con, sql[name])
            else:
                n = len(df.collect())
                res = None if n else "no rows"
        except Exception as e:  # report and go on
            res = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += res is not None
        kind = "oracle" if name in sql else "rows"
        print(f"{'ok  ' if res is None else 'FAIL'} {name:26s} {kind:6s} {time.time() - t:6.2f}s {res or ''}", flush=True)
    drop_scratch(spark)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
