"""Domain tables derived from the test tables, so that each operator has input with an answer in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.quota import DAILY_PLAN_LIMIT, MEMBER_LIMIT

AS_OF = "2024-01-17 23:30:00"
NEXT_MORNING = "2024-01-18 06:30:00"
#: A moment of working hours, when policies of days and hours hold.
FRIDAY = "2024-01-19 09:30:00"
REPEAT_OFFSET = 10**9
MOVED = "2024-01-09 00:00:00"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def raw_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage messages in order of arrival, invalid and repeated ones among them. One subscriber in seven joins the next family on MOVED."""
    sub = F.col("user_id") + 1
    moved = F.when((sub % 7 == 3) & (F.col("ts").cast("timestamp_ntz") >= F.lit(MOVED).cast("timestamp_ntz")), F.lit(1)).otherwise(F.lit(0))
    family = F.when(sub % 11 == 0, F.lit(0)).otherwise(F.floor((sub - 1) / 5) + 1 + moved).cast("bigint")
    amount = F.when(F.col("event_id") % 499 == 0, F.lit(0)).when(F.col("event_id") % 997 == 1, F.lit(-5)).otherwise(F.floor(F.col("value") * 16384)).cast("bigint")
    app = F.when(F.col("event_id") % 101 == 0, F.lit(None)).otherwise(F.get_json_object("props", "$.k").cast("bigint") % 19 + 1).cast("bigint")
    days = F.make_dt_interval((sub % 3 * 15).cast("int"))
    base = _events(spark, sf_dir).select(
        F.concat(F.lit("evt-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("event_id"), sub.alias("sub_id"), family.alias("family_id"), amount.alias("bytes"), app.alias("app_id"),
        (F.col("ts").cast("timestamp_ntz") + days).alias("occurred_at"), F.col("event_id").alias("arrival_seq"),
    )
    again = base.where(F.col("arrival_seq") % 53 == 0).withColumn("arrival_seq", F.col("arrival_seq") + REPEAT_OFFSET)
    return base.unionByName(again)


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = F.col("user_id") + 1
    family = F.when(sub % 11 == 0, F.lit(0)).otherwise(F.floor((sub - 1) / 5) + 1).cast("bigint")
    return _events(spark, sf_dir).select(sub.alias("sub_id"), family.alias("family_id")).distinct()


def plan(spark: SparkSession) -> DataFrame:
    amounts = {1: -1, 2: 10_000_000, 3: 20_000_000, 4: 40_000_000, 5: DAILY_PLAN_LIMIT}
    return spark.createDataFrame([(k, v, False) for k, v in amounts.items()], "plan_id bigint, plan_data_amount bigint, is_deleted boolean")


def subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscribers(spark, sf_dir).select("sub_id", (F.col("sub_id") % 5 + 1).alias("plan_id"), F.lit(False).alias("is_deleted"), (F.col("sub_id") % 17 == 3).alias("is_locked"))


def family_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.element_at(F.array(F.lit(-1), F.lit(0), F.lit(3_000_000), F.lit(8_000_000)), (F.col("sub_id") % 4 + 1).cast("int")).cast("bigint")
    priority = F.when(F.col("family_id") % 2 == 0, F.col("sub_id") * 7 % 5).otherwise(F.lit(-1)).cast("int")
    return subscribers(spark, sf_dir).where("family_id > 0").select("family_id", "sub_id", priority.alias("priority"), limit.alias("data_limit"))


def family(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = family_sub(spark, sf_dir).groupBy("family_id").agg((F.count(F.lit(1)) * MEMBER_LIMIT).cast("bigint").alias("family_data_amount"))
    return members.withColumn("is_deleted", F.lit(False))


def gift(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("sub_id") % 3).cast("int")))).alias("score")
    rows = subscribers(spark, sf_dir).where("sub_id % 3 > 0").select("sub_id", n).select("sub_id", "score", F.explode(F.array(*[F.lit(m) for m in ("202401", "202402", "202403")])).alias("yyyymm"))
    return rows.select("sub_id", (F.col("sub_id") * 10 + 3 - F.col("score")).cast("string").alias("gift_id"), "yyyymm", (F.col("score") * 2_000_000).cast("bigint").alias("gift_limit"), "score")


def block_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two end times for each blocked subscriber with an even id, one past the moment of asking; only the earlier one for odd ids."""
    epoch = 1705501800  # AS_OF in UTC seconds
    ends = F.explode(F.array(F.lit(epoch - 3600), F.when(F.col("sub_id") % 2 == 0, F.lit(epoch + 3600)))).alias("expire_epoch")
    return subscribers(spark, sf_dir).where("sub_id % 13 = 5").select("sub_id", ends).where("expire_epoch is not null").withColumn("expire_epoch", F.col("expire_epoch").cast("bigint"))


def block_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscribers(spark, sf_dir).where("sub_id % 7 = 2").select("sub_id", F.lit(3).cast("bigint").alias("app_id"))


def block_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.element_at(F.array(F.lit("1,3,5|09:00|14:00"), F.lit("2,4,6,7,3|23:00|07:00"), F.lit("|09:00|10:00")), (F.col("sub_id") % 19).cast("int"))
    return subscribers(spark, sf_dir).where("sub_id % 19 in (1, 2, 3)").select("sub_id", rule.alias("encoded"))


def policies(spark: SparkSession) -> DataFrame:
    """Snapshots in each spelling that occurs; live, deleted and inactive ones."""
    rows = [
        (1, "SCHEDULED", '{"days_csv":"MON, tue,,5","start_hhmm":"09:00","end_hhmm":"18:00"}', True, False),
        (2, "", '{"policyType":"scheduled","data":{"days":["SAT","SUN"],"startTime":"22:00","endTime":"06:00"}}', True, False),
        (3, None, '{"policy_type":"SCHEDULED","days":["Wed","x"],"startTime":"10:00","endTime":"10:00"}', True, False),
        (4, "ONCE", '{"expire_epoch":"1705500000"}', True, False),
        (5, "once", '{"data":{"endTime":"2024.01.20T10:00"}}', True, False),
        (6, "ONCE", '{"endTime":"2024-01-20T10:00:30"}', True, False),
        (7, "ONCE", '{"endTime":"tomorrow"}', True, False),
        (8, "ONCE", '{"expire_epoch":"1705500000"}', False, False),
        (9, "SCHEDULED", '{"days_csv":"1,2","start_hhmm":"01:00","end_hhmm":"02:00"}', True, True),
        (10, "ONCE", None, True, False),
    ]
    return spark.createDataFrame(rows, "block_policy_id bigint, policy_type string, policy_snapshot string, is_active boolean, is_deleted boolean")


def policy_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscribers(spark, sf_dir).select("sub_id", (F.col("sub_id") % 10 + 1).alias("block_policy_id"), (F.col("sub_id") % 6 != 0).alias("is_active"))


def blocked_service_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscribers(spark, sf_dir).select("sub_id", (F.col("sub_id") % 8 + 1).alias("blocked_service_id"), (F.col("sub_id") % 3 != 1).alias("is_active"))


def app_blocked_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The apps that events stand for, some of them deleted."""
    app = (F.col("event_id") % 20 + 1).alias("app_blocked_service_id")
    return _events(spark, sf_dir).select(app).distinct().withColumn("is_deleted", F.col("app_blocked_service_id").isin(1, 5))


def present_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gifts from one subscriber to the next, in both forms: of a month, and as rows with a creation time."""
    e = _events(spark, sf_dir).where("event_id % 25 = 0")
    return e.select(
        F.col("event_id").alias("present_data_id"), (F.col("user_id") + 1).alias("target_sub_id"), ((F.col("user_id") + 3) % 15 + 1).alias("provide_sub_id"),
        (F.floor(F.abs("value")) * 1000 + 1000).cast("bigint").alias("data_amount"), F.col("ts").cast("timestamp_ntz").alias("created_time"),
    )


CONTROL_KINDS = (
    "FAMILY_MEMBER_ADDED", "FAMILY_MEMBER_REMOVED", "FAMILY_MODE_CHANGED", "FAMILY_SUB_LIMIT_CHANGED", "POLICY_CHANGED", "POLICY_DEACTIVATE", "PLAN_CHANGED",
    "SUBSCRIPTION_LOCKED", "SUBSCRIPTION_UNLOCKED", "APP_BLOCK_LIST_UPDATED", "GIFT_RECEIVED", "POLICY_SNAPSHOT", "POLICY_DELETED", "FAMILY_CREATE",
)


def control_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, value): change events as JSON, some wrapped in JSON strings once or twice, some sent again under the same id."""
    e = _events(spark, sf_dir).where("event_id % 5 = 0").withColumn("n", F.floor(F.col("event_id") / 5))
    sub, fam = F.col("user_id") + 1, (F.floor(F.col("user_id") / 5) + 1).cast("bigint")
    kind = F.element_at(F.array(*[F.lit(k) for k in CONTROL_KINDS]), (F.col("n") % len(CONTROL_KINDS) + 1).cast("int"))
    amount = (F.floor(F.abs("value")) * 1000).cast("bigint")
    policy = (F.col("n") % 4 + 1).cast("bigint")
    at = lambda *names: kind.isin(*names)
    only = lambda cond, value: F.when(cond, value)
    encoded = F.concat(F.lit("1,"), (F.col("n") % 5 + 2).cast("string"), F.lit("|09:00|10:00"))
    one = F.struct(policy.alias("policyId"), F.when(F.col("n") % 3 == 0, F.lit("ONCE")).otherwise(F.lit("SCHEDULED")).alias("policyType"), only(F.col("n") % 3 != 0, encoded).alias("encoded"), only(F.col("n") % 3 == 0, F.lit(1_700_000_000) + amount).alias("expireEpoch"))
    lim = only(at("PLAN_CHANGED"), amount)
    body = F.struct(
        kind.alias("type"), F.concat(F.lit("c-"), F.col("event_id").cast("string")).alias("eventId"),
        only(at("FAMILY_MEMBER_ADDED", "FAMILY_MEMBER_REMOVED", "FAMILY_MODE_CHANGED", "FAMILY_SUB_LIMIT_CHANGED"), fam).alias("familyId0"),
        only(at("FAMILY_CREATE"), fam + 100_000).alias("familyId1"),
        only(at("FAMILY_MEMBER_ADDED", "FAMILY_MEMBER_REMOVED", "FAMILY_SUB_LIMIT_CHANGED", "PLAN_CHANGED", "SUBSCRIPTION_LOCKED", "SUBSCRIPTION_UNLOCKED", "APP_BLOCK_LIST_UPDATED", "POLICY_SNAPSHOT"), sub).alias("subId"),
        only(at("FAMILY_CREATE"), F.array(sub, sub + 1, sub + 2)).alias("members"),
        only(at("FAMILY_MODE_CHANGED"), F.when(F.col("n") % 2 == 0, F.lit("PRIORITY")).otherwise(F.lit("FIFO"))).alias("mode"),
        only(at("FAMILY_MODE_CHANGED"), F.array(F.struct(sub.alias("subId"), F.lit(1).alias("priority")), F.struct((sub + 1).alias("subId"), F.lit(0).alias("priority")))).alias("priorities"),
        only(at("FAMILY_SUB_LIMIT_CHANGED"), amount).alias("newLimit"), lim.alias("planLimit"),
        only(at("POLICY_CHANGED"), one).alias("policy"), only(at("POLICY_CHANGED"), F.array(sub, sub + 1)).alias("subIds"),
        only(at("POLICY_DEACTIVATE", "POLICY_DELETED"), F.array(F.struct(policy.alias("policyId"), F.when(F.col("n") % 7 != 0, F.array(sub)).alias("subIds")))).alias("policies0"),
        only(at("POLICY_SNAPSHOT"), F.array(one)).alias("policies1"),
        only(at("APP_BLOCK_LIST_UPDATED") & (F.col("n") % 5 != 0), F.array(F.col("n") % 9, F.col("n") % 9 + 1)).alias("appIds"),
        only(at("GIFT_RECEIVED"), sub).alias("receiverSubId"), only(at("GIFT_RECEIVED"), (F.col("user_id") + 3) % 15 + 1).alias("giverSubId"), only(at("GIFT_RECEIVED"), F.concat(F.lit("g"), F.col("event_id").cast("string"))).alias("giftId"),
        only(at("GIFT_RECEIVED"), amount).alias("giftLimitBytes"), only(at("GIFT_RECEIVED"), amount).alias("giftAmountBytes"),
        only(at("GIFT_RECEIVED"), F.date_format("ts", "yyyyMM")).alias("yyyyMM"), only(at("GIFT_RECEIVED"), F.date_format("ts", "yyyyMMdd")).alias("yyyyMMDD"),
    )
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    text = F.regexp_replace(F.regexp_replace(F.to_json(body), "familyId[01]", "familyId"), "policies[01]", "policies")
    family_kind = kind.startswith("FAMILY") | at("POLICY_CHANGED", "POLICY_DEACTIVATE", "POLICY_DELETED")
    text = F.when(F.col("n") % 4 == 1, F.when(family_kind, quoted(text)).otherwise(quoted(quoted(text)))).otherwise(text)
    sent = e.select(F.col("event_id").alias("seq"), text.alias("value"))
    return sent.unionByName(sent.where("seq % 35 = 0").withColumn("seq", F.col("seq") + REPEAT_OFFSET))


LIMIT_KINDS = (
    "FAMILY_MEMBER_ADDED", "FAMILY_MODE_CHANGED", "FAMILY_MEMBER_REMOVED", "FAMILY_SUB_LIMIT_CHANGED", "FAMILY_MEMBER_ADDED", "FAMILY_MEMBER_REMOVED", "PLAN_CHANGED", "GIFT_RECEIVED",
)


def limit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, kst, value): a change of limits for each event of the table, in the order of its time and at it, some under the id of another.

    Families are created, anew or for the first time, between other changes of theirs; added and removed are members and strangers alike.
    """
    e = _events(spark, sf_dir)
    n, sub = F.col("event_id"), F.col("user_id") + 1
    fam = (F.floor(F.col("user_id") / 5) + 1).cast("bigint")
    kind = F.when(n % 97 == 5, F.lit("FAMILY_CREATE")).otherwise(F.element_at(F.array(*[F.lit(k) for k in LIMIT_KINDS]), (n % len(LIMIT_KINDS) + 1).cast("int")))
    at = lambda *names: kind.isin(*names)
    amount = (F.floor(F.abs("value")) * 100_000).cast("bigint")
    target = (fam - 1) * 5 + n % 7 + 1  # two in seven are no members at the start
    score = lambda k: F.struct(((fam - 1) * 5 + k + 1).alias("subId"), ((n + 3 * k) % 4).alias("priority"))
    body = F.struct(
        kind.alias("type"), F.concat(F.lit("l-"), F.when(n % 31 == 7, n - 1).otherwise(n).cast("string")).alias("eventId"), F.when(kind.startswith("FAMILY"), fam).alias("familyId"),
        F.when(at("FAMILY_MEMBER_ADDED", "FAMILY_MEMBER_REMOVED", "FAMILY_SUB_LIMIT_CHANGED"), target).when(at("PLAN_CHANGED"), sub).alias("subId"),
        F.when(at("FAMILY_CREATE"), F.array(target, sub)).alias("members"), F.when(at("FAMILY_MODE_CHANGED"), F.when(n % 3 == 0, F.lit("FIFO")).otherwise(F.lit("PRIORITY"))).alias("mode"),
        F.when(at("FAMILY_MODE_CHANGED"), F.array(score(0), score(1), score(2))).alias("priorities"), F.when(at("FAMILY_SUB_LIMIT_CHANGED"), amount).alias("newLimit"),
        F.when(at("PLAN_CHANGED"), F.when(n % 5 == 0, F.lit(DAILY_PLAN_LIMIT)).when(n % 11 == 0, F.lit(-1)).otherwise(amount)).alias("planLimit"),
        F.when(at("GIFT_RECEIVED"), sub).alias("receiverSubId"), F.when(at("GIFT_RECEIVED"), sub + 1).alias("giverSubId"), F.when(at("GIFT_RECEIVED"), F.concat(F.lit("n"), n.cast("string"))).alias("giftId"),
        F.when(at("GIFT_RECEIVED"), amount).alias("giftLimitBytes"), F.when(at("GIFT_RECEIVED"), amount).alias("giftAmountBytes"),
        F.when(at("GIFT_RECEIVED"), F.date_format("ts", "yyyyMM")).alias("yyyyMM"), F.when(at("GIFT_RECEIVED"), F.date_format("ts", "yyyyMMdd")).alias("yyyyMMDD"),
    )
    return e.select(n.alias("seq"), (F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(9))).alias("kst"), F.to_json(body).alias("value"))


def odd_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family_id, family_limit): stored limits that are no multiple of a member's share; one family in six is not there."""
    rows = family_sub(spark, sf_dir).select("family_id").distinct()
    return rows.where("family_id % 6 <> 4").select("family_id", (F.col("family_id") * 1_234_567 % 9_000_001).alias("family_limit"))
