"""Times the headline masking queries: one JSON line with seconds by query, the best of two runs after a warm-up."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")

from hushframe import Masker, queries  # noqa: E402

HEADLINE = ["rule_full", "rule_id", "rule_email", "rule_phone", "mask_events_default", "nested_orders", "json_props", "json_build", "url_http", "headers_map", "container_documents", "mask_to_json", "log_lines", "log_records", "text_secrets", "text_tokens", "masked_join_agg"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    made = queries.queries()
    runs = {name: (lambda f=made[name]: f(spark, folder)) for name in HEADLINE}
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    runs["documents_text"] = lambda: documents.select(Masker().mask_text(F.col("text")).alias("v"))
    runs["documents_inspect"] = lambda: documents.select(Masker().inspect(F.col("text"))["value"].alias("v"))
    one = lambda c: F.array(c)
    headers = F.create_map(F.lit("Set-Cookie"), one(F.col("c_name")), F.lit("Authorization"), F.array(F.col("c_name"), F.col("c_mktsegment")), F.lit("Accept"), one(F.concat(F.lit("password="), F.col("c_name"))), F.lit("Host"), one(F.col("c_mktsegment")))
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    runs["headers_default"] = lambda: customers.select(Masker().mask_headers(headers).alias("v"))  # documents inside values, too
    seconds = {}
    for name, f in runs.items():
        best = None
        for _ in range(3):
            began = time.time()
            f().write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began) if _ else None
        seconds[name] = round(best, 3)
    chars = documents.agg(F.sum(F.length("text"))).first()[0]
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    rates = {"documents_text_mb_s": round(chars / 1e6 / seconds["documents_text"], 1), "documents_inspect_mb_s": round(chars / 1e6 / seconds["documents_inspect"], 1), "json_rows_s": round(rows / seconds["json_props"]), "log_lines_s": round(rows / seconds["log_lines"])}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1], "cpus": int(cpus), "rates": rates}))


if __name__ == "__main__":
    main()
