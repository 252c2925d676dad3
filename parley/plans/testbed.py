"""The star-schema tables read as catalogs, dialogues, pools and session results, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


#: Bytes of a table that may be one row group, which one task reads, though its rows are work for all cores.
SPREAD = range(4 << 20, 64 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one small enough to be a single task's is dealt out to all cores, larger ones have tasks enough."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.repartition(spark.sparkContext.defaultParallelism) if size in SPREAD else rows


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products; the price is twice the size, absent for every fifth size."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as ord",
        "cast(p_partkey as string) as parent_asin",
        "p_name as title",
        "array(p_type, concat('size ', p_size)) as features",
        "map('Brand', p_brand, 'Finish', p_type) as details",
        "array(concat(p_name, ' by ', p_brand)) as description",
        "array('Clothing, Shoes & Jewelry', p_type, p_brand) as categories",
        "p_brand as store",
        "cast(null as double) as average_rating",
        "cast(null as bigint) as rating_number",
        "case when p_size % 5 > 0 then cast(p_size * 2 as string) end as price_text",
        "case when p_size % 5 > 0 then cast(p_size * 2 as double) end as price",
    )


MESSAGE = "concat('I''m looking for a ', p_name, ' of ', p_type, case p_size % 4 when 0 then concat(' under $', p_size) when 1 then concat(' size ', p_size) when 2 then ' in leather or xx-large' else '' end)"
SQL_MESSAGE = "concat('I''m looking for a ', p_name, ' of ', p_type, case p_size % 4 when 0 then concat(' under $', p_size) when 1 then concat(' size ', p_size) when 2 then ' in leather or xx-large' else '' end)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, text: a customer's message for each part."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{MESSAGE} as text")


TURN = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)"


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, turn, text: an order's lines as the turns of a dialogue about their parts."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as session_id", f"{TURN} as turn", "l_partkey as p_partkey")
    return lines.join(messages(spark, sf_dir), "p_partkey").select("session_id", "turn", "text")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id (a brand), id, rank by falling price, values and slots of each part."""
    parts = table(spark, sf_dir, "part").selectExpr("p_brand as query_id", "p_partkey as id", "row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank", f"{MESSAGE} as text", "cast(p_size as double) * 2 as price")
    text = F.col("text")
    return parts.select("query_id", "id", "rank", X.material(text).alias("material"), X.color(text).alias("color"), X.size(text).alias("size"), X.price_bucket(F.col("price")).alias("budget")).withColumn("values", F.array_compact(F.array("material", "color", "budget")))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as session results."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as sample_id",
        "o_orderpriority as scenario_type",
        "o_orderkey % 13 < 5 as hit",
        "case when o_orderkey % 13 < 5 then 1 + o_orderkey % 10 end as first_hit_turn",
        "case when o_orderkey % 13 < 5 then 1.0D / (1 + o_custkey % 10) else 0.0D end as reciprocal_rank",
        "o_orderkey % 13 < 5 or o_orderkey % 3 = 0 as recall_hit",
        "o_custkey % 100 - 5 as prompt_tokens",
        "o_orderkey % 7 - 1 as completion_tokens",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as labelled sessions, each after the part of its own key."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "cast(s_suppkey as string) as sample_id",
        "element_at(array('buying', 'browsing', 'intent_override', 'boundary'), cast(s_suppkey % 4 as int) + 1) as scenario_type",
        "named_struct('parent_asin', cast(s_suppkey as string)) as ground_truth",
        "named_struct('preference_tags', array('comfort')) as user_profile",
        "cast(null as struct<target_category:string,hard_constraints:array<string>,soft_preferences:array<string>>) as intent_card",
        "cast(null as struct<scenario_type:string,override:struct<turn:int,old_value:string,new_value:string,message:string>>) as behavior",
    )
