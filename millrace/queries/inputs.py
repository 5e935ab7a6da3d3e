"""Inputs of the operators, derived from whole tables of a scale factor."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.tags import default_tags
from millrace.operators.chat import Client, conversation_requests
from millrace.shared import shared_folder

MONEY = "decimal(18,2)"

#: Limits small enough that some requests of the test tables exceed them.
TIGHT_TIERS = {"default": None, "tier-1": 1, "tier-2": 2, "tier-3": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_database(spark: SparkSession) -> str:
    """A database of its own for one run of a query, kept in the shared folder."""
    folder = shared_folder(spark)
    name = f"millrace_{folder.rsplit('/', 1)[1]}"
    spark.sql(f"CREATE DATABASE `{name}` LOCATION '{folder}'")
    return name


def source_table(spark: SparkSession, sf_dir: str, database: str, name: str) -> None:
    """Register a given table in a database without copying it."""
    spark.catalog.createTable(
        f"`{database}`.`{name}`", path=f"{sf_dir}/{name}.parquet", source="parquet"
    )


def to_ledger(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Orders as spend of their customer's market segment."""
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("c_mktsegment").alias("application"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        default_tags("c_mktsegment").alias("tags"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_ledger(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def segment_budgets(customer: DataFrame) -> DataFrame:
    """A budget per market segment: seven times its balances, with a subscriber per region.

    A segment has at most five subscribers, and BUILDING has none.
    """
    subscriber = F.when(
        F.col("c_mktsegment") != "BUILDING",
        F.concat(F.lit("region-"), F.col("c_nationkey") % 5, F.lit("@example.com")),
    )
    return customer.groupBy(F.col("c_mktsegment").alias("application")).agg(
        F.floor(F.sum(F.abs("c_acctbal").cast(MONEY)) * 7).alias("monthly_limit"),
        F.collect_set(subscriber).alias("subscribers"),
    )


def customer_budgets(customer: DataFrame) -> DataFrame:
    """A budget per customer, the whole dollars of the balance; some are below 30."""
    return customer.select(
        F.col("c_name").alias("application"),
        F.floor(F.abs("c_acctbal").cast(MONEY)).cast("bigint").alias("monthly_limit"),
    )


def to_requests(events: DataFrame, api_key: str = "user_id") -> DataFrame:
    """Events as requests, each user on one of four tiers."""
    plan = F.col("user_id") % 4
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col(api_key).alias("api_key"),
        F.when(plan == 0, "default")
        .otherwise(F.concat(F.lit("tier-"), plan.cast("string")))
        .alias("tier"),
        "ts",
    )


def first_puts(pages: DataFrame) -> DataFrame:
    """Every page stored under its URL."""
    return pages.select(
        F.col("url").alias("key"),
        F.lit(1).alias("seq"),
        F.encode("html", "UTF-8").alias("content"),
    )


def second_puts(pages: DataFrame) -> DataFrame:
    """New content for the secure pages."""
    return pages.filter(F.col("url").startswith("https:")).select(
        F.col("url").alias("key"),
        F.lit(2).alias("seq"),
        F.encode(F.concat("html", F.lit("<!-- again -->")), "UTF-8").alias("content"),
    )


def deletes(pages: DataFrame) -> DataFrame:
    """The URLs with a fragment are deleted."""
    return pages.filter(F.col("url").contains("#")).select(
        F.col("url").alias("key"), F.lit(3).alias("seq")
    )


def third_puts(pages: DataFrame) -> DataFrame:
    """The secure ones among the deleted are stored again."""
    return pages.filter(F.col("url").startswith("https:") & F.col("url").contains("#")).select(
        F.col("url").alias("key"),
        F.lit(4).alias("seq"),
        F.encode(F.concat("html", F.lit("<!-- back -->")), "UTF-8").alias("content"),
    )


def object_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of all of these operations, the first of them recorded twice."""
    pages = table(spark, sf_dir, "pages")
    put = F.lit("put").alias("op")
    delete = [F.lit("delete").alias("op"), F.lit(None).cast("binary").alias("content")]
    first = first_puts(pages).select("*", put)
    return (
        first.unionByName(first)
        .unionByName(second_puts(pages).select("*", put))
        .unionByName(deletes(pages).select("*", *delete))
        .unionByName(third_puts(pages).select("*", put))
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part, customer and supplier names and document sources, as given and with hyphens."""
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    hyphenated = part.select(F.replace("name", F.lit(" "), F.lit("-")))
    customer = table(spark, sf_dir, "customer").select("c_name")
    lower = customer.select(F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")))
    supplier = table(spark, sf_dir, "supplier").select("s_name")
    source = table(spark, sf_dir, "documents").select("source")
    return part.union(hyphenated).union(customer).union(lower).union(supplier).union(source)


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    return conversation_requests(messages)


def offline_client() -> Callable[[], Client]:
    """A client without a service: answers a user, rejects an assistant, fails on a system role."""

    def connect() -> Client:
        def answer(body: str) -> tuple[int, str]:
            messages = json.loads(body)["messages"]
            if any(message["role"] == "system" for message in messages):
                raise TimeoutError("no answer")
            if messages[-1]["role"] != "user":
                return 422, '{"error":"last message is not from the user"}'
            chars = sum(len(message["content"]) for message in messages)
            return 200, f'{{"messages":{len(messages)},"characters":{chars}}}'

        return answer

    return connect
