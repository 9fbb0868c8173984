"""Annotation tables made from the star-schema tables: as DataFrames and as DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annomill.functions.numeric import hash_bucket
from annomill.session import stored

#: Element types in the order of their indices, and those that carry text.
TYPES = ["btn", "input", "text", "heading", "para", "img", "icon", "menu", "avatar", "check", "radio", "switch", "divider", "card", "appbar", "bottomnav", "fab", "listmark"]
TEXT_TYPES = ["btn", "input", "text", "heading", "check", "radio", "switch"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """A frame per order; each three orders of a customer in a row are a sketch."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf, "orders").withColumn("place", F.row_number().over(order) - 1).withColumn("ord", F.col("place") % 3)
    return orders.select((F.col("o_custkey") + 10_000_000_000 * F.floor(F.col("place") / 3)).alias("sketch_id"), F.col("o_orderkey").alias("frame_id"), "ord", (500.0 * F.col("ord")).alias("fx"), F.lit(0.0).alias("fy"), F.lit(360.0).alias("fw"), F.lit(760.0).alias("fh"))


def elements_gold(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf, "lineitem").withColumn("k", F.row_number().over(order) - 1)
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("l_partkey") % 18).cast("int") + 1)
    e = frames(spark, sf).join(lines, F.col("frame_id") == F.col("l_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    return e.select(
        "sketch_id", "frame_id", "fx", (F.col("l_orderkey") * 100_000 + F.col("k")).alias("element_id"), kind.alias("type"),
        (F.col("fx") + 10 + 170 * (F.col("k") % 2)).alias("x"), (10.0 + 100 * F.floor(F.col("k") / 2)).alias("y"),
        (100.0 + F.col("l_partkey") % 50).alias("w"), (40.0 + F.col("l_suppkey") % 40).alias("h"), F.when(kind.isin(TEXT_TYPES), F.col("p_name")).alias("text"),
    )


def elements_pred(spark: SparkSession, sf: str, gold: DataFrame | None = None) -> DataFrame:
    """Gold with misses, confusions and shifts, and one false positive in some frames."""
    g = elements_gold(spark, sf) if gold is None else gold
    b = lambda p, c="element_id": hash_bucket(F.concat(F.lit(p), F.col(c).cast("string")))
    index = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type"))
    kept = g.filter(b("m:") >= 8).withColumn("type", F.when(b("c:") < 8, F.element_at(F.array(*map(F.lit, TYPES)), (index % 18 + 1).cast("int"))).otherwise(F.col("type")))
    kept = kept.withColumns({k: F.col(k) + b(f"{k}:") % 7 - 3 for k in "xywh"}).select("sketch_id", "frame_id", "element_id", "type", "x", "y", "w", "h", "text")
    false = frames(spark, sf).filter(b("f:", "frame_id") < 20).select("sketch_id", "frame_id", (F.col("frame_id") * 100_000 + 99_999).alias("element_id"), F.lit("text").alias("type"), (F.col("fx") + 10).alias("x"), F.lit(710.0).alias("y"), F.lit(40.0).alias("w"), F.lit(30.0).alias("h"), F.lit(None).cast("string").alias("text"))
    return kept.unionByName(false)


def elements_both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Gold and predicted elements for queries that read them several times: each is made once and read from files."""
    gold = stored(elements_gold(spark, sf), "gold")
    return gold, stored(elements_pred(spark, sf, gold), "pred")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """A stroke per user and day, its points in time order."""
    e = table(spark, sf, "events")
    by = Window.partitionBy("user_id")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    e = e.select(F.col("user_id").alias("sketch_id"), day.alias("stroke_id"), F.col("value").alias("x"), (F.col("event_id") % 760).cast("double").alias("y"), (F.unix_millis(F.col("ts").cast("timestamp")) - F.min(F.unix_millis(F.col("ts").cast("timestamp"))).over(by)).alias("t"), "ts")
    return e.withColumn("seq", F.row_number().over(Window.partitionBy("sketch_id", "stroke_id").orderBy("ts"))).drop("ts")


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.create_map(*(F.lit(x) for p in (("signup", "launch"), ("click", "start"), ("view", "end"), ("error", "fail"), ("purchase", "info")) for x in p)), F.col("event_type"))
    return table(spark, sf, "events").select(F.col("user_id").alias("device"), "ts", F.coalesce(kind, F.lit("info")).alias("kind"), F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")).alias("step"))


def stage_times(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("stage"), F.col("value").alias("ms"), (hash_bucket(F.concat(F.lit("b:"), F.col("event_id").cast("string"))) < 10).alias("fell_back"))


_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
_TEXT = "(" + ", ".join(f"'{t}'" for t in TEXT_TYPES) + ")"


def bucket_sql(s: str) -> str:
    return f"(('0x' || substr(sha1({s}), 1, 8))::BIGINT % 100)"


VIEWS = {
    "frames": "SELECT o_custkey + 10000000000 * (place // 3) AS sketch_id, o_orderkey AS frame_id, place % 3 AS ord, 500.0::DOUBLE * (place % 3) AS fx, 0.0::DOUBLE AS fy, 360.0::DOUBLE AS fw, 760.0::DOUBLE AS fh FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders)",
    "elements_gold": f"""SELECT sketch_id, frame_id, fx, l_orderkey * 100000 + k AS element_id, ({_LIST})[(l_partkey % 18 + 1)::INT] AS type, fx + 10 + 170 * (k % 2) AS x, (10 + 100 * (k // 2))::DOUBLE AS y,
        (100 + l_partkey % 50)::DOUBLE AS w, (40 + l_suppkey % 40)::DOUBLE AS h, CASE WHEN ({_LIST})[(l_partkey % 18 + 1)::INT] IN {_TEXT} THEN p_name END AS text
        FROM frames JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS k FROM lineitem)) l ON frame_id = l_orderkey LEFT JOIN part ON l_partkey = p_partkey""",
    "elements_pred": f"""SELECT sketch_id, frame_id, element_id, CASE WHEN {bucket_sql("'c:' || element_id")} < 8 THEN ({_LIST})[(list_position({_LIST}, type) % 18 + 1)::INT] ELSE type END AS type,
        {", ".join(f"{k} + {bucket_sql(f"'{k}:' || element_id")} % 7 - 3 AS {k}" for k in "xywh")}, text FROM elements_gold WHERE {bucket_sql("'m:' || element_id")} >= 8
        UNION ALL SELECT sketch_id, frame_id, frame_id * 100000 + 99999, 'text', fx + 10, 710, 40, 30, NULL FROM frames WHERE {bucket_sql("'f:' || frame_id")} < 20""",
    "points": """SELECT user_id AS sketch_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS stroke_id, value AS x, (event_id % 760)::DOUBLE AS y, epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS t,
        row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts) AS seq FROM events""",
    "run_log": "SELECT user_id AS device, ts, CASE event_type WHEN 'signup' THEN 'launch' WHEN 'click' THEN 'start' WHEN 'view' THEN 'end' WHEN 'error' THEN 'fail' ELSE 'info' END AS kind, 's' || (event_id % 5) AS step FROM events",
    "stage_times": f"SELECT event_id, event_type AS stage, value AS ms, {bucket_sql("'b:' || event_id")} < 10 AS fell_back FROM events",
}
NEEDS = {"elements_gold": ["frames"], "elements_pred": ["frames", "elements_gold"]}


def with_views(body: str, *names: str) -> str:
    """The query with the tables it needs in front."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}" if head else body
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}" if head else body
    return f"WITH {head} {body}" if head else body
