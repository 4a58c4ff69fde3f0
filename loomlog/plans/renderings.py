"""Log formats rendered from tables, inside Spark: lines, blocks, XML rows, nested records, file heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators.ordered import with_parts
from loomlog.operators.rules import LineRule

# Fixed values of the renderings.
LEVELS = ("INF", "WRN", "ERR")
COMPONENTS = ("CS", "DB", "NET", "UI")
MTIME = "2026-03-24 10:00:00"
YEAR_MTIME = "2024-01-15 12:00:00"
SYSLOG = LineRule("syslog", r"^(?P<ts>[A-Z][a-z]{2} [ 0-9]\d \d{2}:\d{2}:\d{2}) (?P<host>\S+) (?P<proc>\w+): (?P<message>.*)$", "Jan _2 15:04:05", 40, ts_use_mtime_year=True)
LINES_PER_PART = 2_000
EVENTS_PER_TASK = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: Column, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


def _at(pattern: str) -> Column:
    return F.date_format("ts", pattern)


def message() -> Column:
    return F.concat_ws(" ", "event_type", F.lit("value"), F.col("value").cast("string"))


def line_text(rule: str) -> Column:
    key, user = F.col("event_id"), F.col("user_id").cast("string")
    if rule == "iso-bracket":
        return F.concat(_at("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" ["), pick(key, LEVELS), F.lit("] ["), pick(key, COMPONENTS), F.lit("] [PID:"), user, F.lit("] "), message())
    if rule == "dashdate-level":
        return F.concat(_at("dd-MM-yyyy HH:mm:ss.SSS"), F.lit(" "), pick(key, LEVELS), F.lit("    "), message())
    if rule == "dotdate-pidtid":
        return F.concat(F.lit("app."), pick(key, COMPONENTS), F.lit(": "), _at("dd.MM.yy HH:mm:ss:SSS"), F.lit(" "), user, F.lit("/"), (key % 1000).cast("string"), F.lit(" "), message())
    if rule == "time-pidtid":
        return F.concat(_at("HH:mm:ss.SSSSSS"), F.lit(" "), user, F.lit("/"), (key % 1000).cast("string"), F.lit(" "), pick(key, LEVELS), F.lit("   "), message())
    if rule == "time-dotdate":
        return F.concat(_at("HH:mm:ss.SSS dd.MM.yyyy"), F.lit(": "), message())
    day = F.lpad(_at("d"), 2, " ")
    return F.concat(_at("MMM"), F.lit(" "), day, _at(" HH:mm:ss"), F.lit(" web1 "), F.col("event_type"), F.lit(": "), message())


def event_lines(spark: SparkSession, sf_dir: str, rule: str, mtime: str = MTIME, files: int = 4) -> DataFrame:
    """file, part, seq (event_id), mtime, value: every event as a line of one of a few files."""
    rows = table(spark, sf_dir, "events")
    lines = rows.select(F.concat(F.lit("app"), F.col("event_id") % files).alias("file"), F.col("event_id").alias("seq"), F.lit(mtime).cast("timestamp").alias("mtime"), line_text(rule).alias("value"))
    return with_parts(lines, LINES_PER_PART)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header line for each document, its text's lines after it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit("2024-01-01 00:00:00.000 [INF] [DOC] [PID:"), F.col("doc_id").cast("string"), F.lit("] doc "), F.col("doc_id").cast("string"))
    lines = docs.select("doc_id", F.posexplode(F.concat(F.array(head), F.split("text", "\n"))).alias("pos", "value"))
    # parts of a hundred documents; seq orders the lines of each
    return lines.select(F.concat(F.lit("docs"), F.col("doc_id") % 8).alias("file"), F.floor(F.col("doc_id") / 100).cast("long").alias("part"), (F.col("doc_id") * 10_000_000 + F.col("pos")).alias("seq"), "value")


def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each turn; lines of its text after the first one begin with a blank."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.split(F.coalesce("text", F.lit("")), "\n").alias("t"))
    stamp = F.date_format(F.timestamp_add("MINUTE", F.col("conv_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.array(F.lit("-" * 40), F.concat(F.lit("Conv: "), F.col("conv_id").cast("string")), F.concat(F.lit("Turn: "), F.col("turn").cast("string")), F.concat(F.lit("Role: "), "role"), F.concat(F.lit("Timestamp: "), stamp), F.concat(F.lit("Text: "), F.get("t", F.lit(0))))
    body = F.transform(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda x: F.concat(F.lit(" "), x))
    lines = turns.select("conv_id", "turn", F.posexplode(F.concat(head, body)).alias("pos", "value"))
    return lines.select(F.concat(F.lit("talk"), F.col("conv_id") % 4).alias("file"), F.floor(F.col("conv_id") / 200).cast("long").alias("part"), ((F.col("conv_id") * 10_000 + F.col("turn")) * 100_000 + F.col("pos")).alias("seq"), "value")


def event_xml() -> Column:
    key = F.col("event_id")
    tags = F.array_join(F.transform(F.sequence(F.lit(1), (key % 3 + 1).cast("int")), lambda i: F.concat(F.lit("<Tag>t"), i.cast("string"), F.lit("</Tag>"))), "")
    return F.concat(
        F.lit('<Event type="'), "event_type", F.lit('" time="'), _at("yyyy-MM-dd HH:mm:ss"), F.lit('Z"><Id>'), key.cast("string"), F.lit("</Id><User>"), F.col("user_id").cast("string"),
        F.lit('</User><Value unit="x"> '), F.col("value").cast("string"), F.lit(" </Value><Detail>&lt;b&gt; &amp; more</Detail><Info>"), tags, F.lit("</Info></Event>"),
    )


def xml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(event_xml().alias("xml"))


def xml_heads(spark: SparkSession, sf_dir: str, per_file: int = 200) -> DataFrame:
    """file, head: documents of ``per_file`` events each."""
    events = table(spark, sf_dir, "events").withColumn("file", F.floor(F.col("event_id") / per_file).cast("long"))
    dealt = events.repartition(1 + events.count() // EVENTS_PER_TASK, "file")  # what a task sorts stays the same however many there are
    files = dealt.select("file", "event_id", event_xml().alias("xml")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("event_id", "xml"))).alias("x"))
    return files.select("file", F.concat(F.lit('<?xml version="1.0"?><Log><Head/>'), F.array_join(F.transform("x", lambda e: e["xml"]), ""), F.lit("</Log>")).alias("head"))


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded event records; every eleventh has no time of its own."""
    seconds = F.when(F.col("event_id") % 11 != 0, F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1_000_000)
    system = F.struct(F.struct(F.col("event_id").alias("Value")).alias("EventID"), F.struct(seconds.alias("SystemTime")).alias("TimeCreated"), F.lit("Security").alias("Channel"))
    data = F.struct(F.col("user_id").alias("User"), F.slice(F.array(F.col("event_type"), *map(F.lit, "vwxyz")), 1, (F.col("event_id") % 6 + 1).cast("int")).alias("Tags"), F.col("value").alias("Amount"))
    return table(spark, sf_dir, "events").select(F.struct(system.alias("System"), data.alias("EventData")).alias("Event"), F.lit(MTIME).cast("timestamp").alias("mtime"))


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``props`` as a struct."""
    return table(spark, sf_dir, "events").withColumn("props", F.from_json("props", "k long"))


def file_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, head: one file a document, in one of eight kinds by doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    kind = F.col("doc_id") % 8
    quoted = F.to_json(F.struct("doc_id", F.col("t").alias("text")))
    iso = F.concat(F.lit("2024-01-01 00:00:00.000 [INF] [DOC] [PID:"), F.col("doc_id").cast("string"), F.lit("] "), "t")
    body = F.when(kind.isin(1, 2), F.concat(quoted, F.lit("\n"))).when(kind == 3, F.concat(F.lit("<Log>"), "t", F.lit("</Log>"))).when(kind == 4, F.concat(F.lit("-" * 40 + "\nText: "), "t")).when(kind == 5, iso).when(kind == 6, F.concat(F.lit("PAR1"), "t")).otherwise(F.col("t"))
    ext = F.when(kind == 0, ".ndjson").when(kind == 2, ".json").otherwise(".log")
    return docs.select(F.concat(F.lit("/land/d"), F.col("doc_id").cast("string"), ext).alias("path"), F.encode(body, "UTF-8").alias("head"))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, line, value: iso-bracket lines of which some have impossible dates, are blank, or are prose."""
    key = F.col("event_id")
    text = line_text("iso-bracket")
    value = F.when(key % 23 == 0, F.lit("  ")).when(key % 29 == 0, F.concat(F.lit("  at "), "event_type")).when(key % 17 == 0, F.concat(F.lit("2024-13-45"), F.substring(text, F.lit(11), F.length(text)))).otherwise(text)
    return table(spark, sf_dir, "events").select(F.concat(F.lit("app"), key % 4).alias("source"), key.alias("line"), value.alias("value"))


def shape_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, line, value: one source a line format."""
    key = F.col("event_id")
    names = ("iso-bracket", "dashdate-level", "dotdate-pidtid", "time-pidtid", "time-dotdate", "syslog")
    value = F.coalesce(*[F.when(key % 6 == i, line_text(n)) for i, n in enumerate(names)])
    return table(spark, sf_dir, "events").select(pick(key, names).alias("source"), key.alias("line"), value.alias("value"))


def zoned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, part, seq, mtime, source, line, value: iso timestamps that end in Z, +02:00 or +0200, one source each."""
    key = F.col("event_id")
    local = F.date_format(F.timestamp_add("HOUR", F.lit(2), F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    stamp = F.when(key % 3 == 0, F.concat(_at("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))).when(key % 3 == 1, F.concat(local, F.lit("+02:00"))).otherwise(F.concat(local, F.lit("+0200")))
    source = pick(key, ("utc", "colon", "plain"))
    lines = table(spark, sf_dir, "events").select(source.alias("file"), key.alias("seq"), F.lit(MTIME).cast("timestamp").alias("mtime"), source.alias("source"), key.alias("line"), F.concat(stamp, F.lit(" "), pick(key, LEVELS), F.lit(" "), message()).alias("value"))
    return with_parts(lines, LINES_PER_PART)
