"""Messages and tables from outside: JSON values, Kafka, JDBC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import policy_text, timekeys

# fixed values: message schemas and topic settings
USAGE_SCHEMA = "eventId string, subId bigint, familyId bigint, bytes bigint, appId string, occurredAt timestamp"
POLICY = "struct<policyId:bigint,policyType:string,encoded:string,expireEpoch:bigint>"
CONTROL_SCHEMA = (
    "type string, eventId string, familyId bigint, subId bigint, members array<bigint>, mode string, priorities array<struct<subId:bigint,priority:bigint>>, newLimit bigint, planLimit bigint, "
    f"policy {POLICY}, subIds array<bigint>, policies array<struct<policyId:bigint,policyType:string,encoded:string,expireEpoch:bigint,subIds:array<bigint>>>, appIds array<bigint>, "
    "receiverSubId bigint, giverSubId bigint, giftId string, giftLimitBytes bigint, giftAmountBytes bigint, yyyyMM string, yyyyMMDD string"
)
MAX_POLL = 1000
#: Encoding doubles the backslashes before a quote, so no string of Spark's (2^31 bytes at most) holds a message wrapped more often.
MOST_WRAPS = 32


def usage(values: DataFrame, column: str = "value") -> DataFrame:
    """Usage events from JSON text; app ids come as text or numbers, times with a zone or in UTC."""
    e = F.from_json(F.col(column).cast("string"), USAGE_SCHEMA, {"timeZone": "UTC"})
    rows = values.select(*[c for c in values.columns if c != column], e.alias("e"))
    return rows.select(
        *[c for c in rows.columns if c != "e"], F.col("e.eventId").alias("event_id"), F.col("e.subId").alias("sub_id"), F.coalesce("e.familyId", F.lit(0)).cast("bigint").alias("family_id"), "e.bytes",
        F.col("e.appId").try_cast("bigint").alias("app_id"), timekeys.utc(F.col("e.occurredAt")).alias("occurred_at"),
    )


def encoded_usage() -> Column:
    """The message of a usage event, as JSON text."""
    names = {"event_id": "eventId", "sub_id": "subId", "family_id": "familyId", "bytes": "bytes"}
    body = F.struct(*[F.col(a).alias(b) for a, b in names.items()], F.col("app_id").cast("string").alias("appId"), F.col("occurred_at").alias("occurredAt"))
    return F.to_json(body, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})


def encode_usage(events: DataFrame, key: str = "family_id") -> DataFrame:
    """(key, value) for a message sink. The key is the family, so that a family's events stay in order; pass event_id for the old way."""
    return events.select(F.col(key).cast("string").alias("key"), encoded_usage().alias("value"))


def control(values: DataFrame, levels: int = MOST_WRAPS, column: str = "value") -> DataFrame:
    """Change events, unwrapped up to `levels` times: by default as often as any message can be wrapped."""
    e = F.from_json(policy_text.unwrapped(F.col(column).cast("string"), levels), CONTROL_SCHEMA)
    rows = values.select(*[c for c in values.columns if c != column], e.alias("e"))
    return rows.select(*[c for c in rows.columns if c != "e"], "e.*").withColumnsRenamed({"type": "kind", "eventId": "event_id"})


REQUIRED = {
    "FAMILY_CREATE": ("familyId", "members"), "FAMILY_MEMBER_ADDED": ("familyId", "subId"), "FAMILY_MEMBER_REMOVED": ("familyId", "subId"), "FAMILY_MODE_CHANGED": ("familyId", "mode"),
    "FAMILY_SUB_LIMIT_CHANGED": ("familyId", "subId", "newLimit"), "POLICY_CHANGED": ("policy", "subIds"), "POLICY_DEACTIVATE": ("policies",), "POLICY_DELETED": ("policies",), "PLAN_CHANGED": ("subId", "planLimit"),
    "SUBSCRIPTION_LOCKED": ("subId",), "SUBSCRIPTION_UNLOCKED": ("subId",), "POLICY_SNAPSHOT": ("subId", "policies"), "APP_BLOCK_LIST_UPDATED": ("subId",),
    "GIFT_RECEIVED": ("receiverSubId", "giverSubId", "giftId", "giftLimitBytes", "giftAmountBytes", "yyyyMM", "yyyyMMDD"),
}


def refused(events: DataFrame) -> Column:
    """Why a change event can't be applied, or null: an unknown kind, no id, or a field that its kind needs."""
    reason = F.when(F.col("event_id").isNull(), F.lit("NO_EVENT_ID")).when(F.col("kind").isNull() | ~F.col("kind").isin(*REQUIRED), F.lit("UNKNOWN_TYPE"))
    for kind, fields in REQUIRED.items():
        missing = F.lit(False)
        for f in fields:
            missing = missing | F.col(f).isNull()
        reason = reason.when((F.col("kind") == kind) & missing, F.lit("MISSING_FIELD"))
    return reason


def kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A stream of a topic; needs the Kafka package on the session's class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    for key, value in ({"startingOffsets": "earliest", "maxOffsetsPerTrigger": str(MAX_POLL * 100)} | options).items():
        reader = reader.option(key, value)
    return reader.load()


def jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table or query of a relational database; partition = (column, lower, upper, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", query)
    if partition:
        for key, value in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition, strict=True):
            reader = reader.option(key, str(value))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()
