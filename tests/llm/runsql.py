"""Compare the operators' queries with their SQL: `python tests/llm/runsql.py SF NAME…`."""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    import __spark_entry__ as entry
    from quire.session import build_session

    folder = f"/root/testdata/{sys.argv[1]}"
    spark = build_session("llm", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:]:
        start = time.time()
        if name in sqls:
            print(name, *compare(spark, connect(folder), folder, name, queries[name], sqls[name]))
        else:
            df = queries[name](spark, folder)
            print(name, df.count(), df.columns)
            df.show(8, 120)
        print(name, round(time.time() - start, 1), "s", flush=True)
