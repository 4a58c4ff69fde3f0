
import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SIZE = 200 << 20


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 2)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench-loads").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from loomlog.operators import lines, profile, rules
    from loomlog.plans import renderings as R
    from loomlog.sources.scans import read_lines, read_ndjson

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = events.agg(F.sum(F.length(F.to_json(F.struct("*"))) + 1)).first()[0]
    many = events.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(-(-SIZE // one))))).repartition(8)  # the table over and over
    many.withColumn("event_id", F.col("event_id") + F.col("copy") * 1_000_000).drop("copy").select(F.to_json(F.struct("*"))).write.text(f"{base}/ndjson")
    many.select(R.line_text("iso-bracket")).write.text(f"{base}/lines")
    size = lambda p: sum(os.path.getsize(f"{base}/{p}/{f}") for f in os.listdir(f"{base}/{p}") if f.endswith(".txt"))
    drain(read_lines(spark, f"{base}/lines"))  # warm-up
    schema = read_ndjson(spark, f"{base}/ndjson", sampling_ratio=0.01).schema
    out = {"ndjson_mb": size("ndjson") >> 20, "lines_mb": size("lines") >> 20}
    out["ndjson_all_rows_inferred_s"] = timed(lambda: drain(read_ndjson(spark, f"{base}/ndjson")))
    out["ndjson_sampled_s"] = timed(lambda: drain(read_ndjson(spark, f"{base}/ndjson", sampling_ratio=0.02)))
    out["ndjson_schema_given_s"] = timed(lambda: drain(read_ndjson(spark, f"{base}/ndjson", schema)))
    took = timed(lambda: drain(lines.parse_records(read_lines(spark, f"{base}/lines"), rules.LINE_RULES[0])))
    out["parse_lines_mb_s"] = round(out["lines_mb"] / took, 1)
    wide = events.select(*[(F.col("user_id") + i).cast("string").alias(f"f{i}") for i in range(200)])
    out["profile_200_fields_s"] = timed(lambda: drain(profile.profile(wide)))
    out["profile_200_fields_one_job_each_s"] = round(10 * timed(lambda: [drain(profile.profile(wide, [f"f{i}"])) for i in range(20)]), 1)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
