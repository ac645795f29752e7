"""Canonical hiring views over the star-schema tables; every operator takes frames of this shape.

Ids are opaque; nulls are placed where the operators' null rules matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Clock of the order tables and of the event tables; no operator reads the time of day.
AS_OF = "2001-08-01 06:30:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr(
        "r_regionkey as id", "r_name as name", "lower(replace(r_name, ' ', '-')) as slug", "r_regionkey <> 4 as is_active"
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as users of the agency of their nation's region."""
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
        .selectExpr(
            "s_suppkey as id",
            "s_name as name",
            "n_regionkey as agency_id",
            "element_at(array('admin', 'recruiter', 'hiring_manager', 'viewer', 'recruiter'), cast(s_suppkey % 5 as int) + 1) as role",
            "n_name as department",
            "s_acctbal > 0 as is_active",
            "cast(s_acctbal as int) as wallet_balance",
            "timestampadd(HOUR, s_suppkey, timestamp'2000-01-01') as created_at",
            f"case when s_suppkey % 7 = 0 then null else timestampadd(MINUTE, -(s_suppkey % 60), timestamp'{AS_OF}') end as last_login_at",
        )
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as job descriptions of the company named as their nation."""
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "customer")
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
        .selectExpr(
            "c_custkey as id",
            "n_regionkey as agency_id",
            "concat('Engineer ', c_custkey % 50) as title",
            "case when c_custkey % 31 = 0 then null else concat(' ', n_name) end as company_name",
            "case when c_custkey % 20 = 0 then '' when c_custkey % 21 = 0 then null else c_mktsegment end as department",
            "case when c_custkey % 6 = 5 then null else cast(c_custkey % 6 as int) end as vacancies",
            "c_acctbal > 0 as is_active",
            "element_at(array(null, 'active', ' Published', 'open', 'closed', 'draft'), cast(c_custkey % 6 as int) + 1) as status",
            f"case when c_custkey % 4 = 0 then null else timestampadd(DAY, c_custkey % 400 - 200, timestamp'{AS_OF}') end as valid_through",
            "element_at(array('Pune', 'Mumbai', ' ', 'Delhi'), cast(c_custkey % 4 as int) + 1) as city",
            "case when c_custkey % 3 = 0 then null else 'MH' end as state",
            "'India' as country",
            "concat('[\"sql\",\"', element_at(array('python', 'java', 'React'), cast(c_custkey % 3 as int) + 1), '\"]') as skills_json",
            "concat('$', 10000 + c_custkey, ' - ', 20000 + 2 * c_custkey, ' per year') as salary_range",
            "timestampadd(DAY, c_custkey % 1000, timestamp'1998-01-01') as created_at",
        )
    )


SKILLS = ("python", "js", "React.js", "c++", "html5", "Node.js", "sql", "docker-compose", "k8s", "engineering", "java", "git", "machine learning", "Postgres", "excel", "go")
STAGE_OF_ORDER = (
    "APPLIED",
    "SHORTLISTED",
    "RESUME_REJECTED",
    "REVIEW",
    "INTERVIEW_SCHEDULED",
    "INTERVIEW_RESCHEDULED",
    "INTERVIEWED",
    "SELECTED",
    "INTERVIEW_REVIEW",
    "NO_SHOW",
    "SELECTED",
    "REJECTED",
    "INTERVIEW_FAILED",
    "OFFER_MADE",
    "APPLIED",
)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates; stages come from status and priority, two of them legacy ones."""
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    skill = lambda k: f"element_at(array({quoted(SKILLS)}), cast((o_orderkey * 7 + {k * 5}) % 16 as int) + 1)"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id",
        "concat('C', o_orderkey) as code",
        "case when o_orderkey % 13 = 0 then null else o_custkey end as job_id",
        "case when o_orderkey % 7 = 0 then null else cast(o_orderkey % 5 as int) end as agency_id",
        "concat('Cand ', o_orderkey % 5000) as name",
        "concat('c', o_orderkey % 4000, '@mail.example') as email",
        f"element_at(array({quoted(STAGE_OF_ORDER)}), case o_orderstatus when 'F' then 0 when 'O' then 5 else 10 end + cast(left(o_orderpriority, 1) as int)) as stage",
        "case when o_orderkey % 11 = 0 then null else o_totalprice / 5000 end as resume_score",
        "case when o_orderkey % 17 = 0 then null else 60.0D end as score_threshold",
        f"case when o_orderkey % 9 = 0 then null else array({skill(0)}, {skill(1)}, {skill(2)}) end as skills",
        "case when o_orderkey % 19 = 0 then null else o_orderpriority end as source",
        "case o_orderkey % 23 when 0 then 'salary' when 1 then 'location' end as decline_reason",
        "case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then 'accepted' when o_orderstatus = 'F' and o_orderpriority = '2-HIGH' then 'made' when o_orderstatus = 'O' and o_orderpriority = '1-URGENT' then 'Accepted' end as offer_status",
        "o_custkey % 100 as assigned_to",
        "o_orderkey % 100 as created_by",
        "o_orderdate as created_at",
        "case when o_orderkey % 5 = 0 then null else timestampadd(DAY, o_orderkey % 30, o_orderdate) end as updated_at",
        "case when o_orderkey % 3 = 0 then null else timestampadd(HOUR, (o_orderkey % 45) * 24 + 5, o_orderdate) end as stage_updated_at",
        "case when o_orderkey % 4 = 0 then null else timestampadd(DAY, o_orderkey % 60, o_orderdate) end as stage_entered_at",
    )


def interviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as interviews of the order's candidate."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd')) as id",
        "l_orderkey as candidate_id",
        "case when l_linenumber = 7 then 'No-Show' when l_returnflag = 'A' then if(l_linestatus = 'F', 'completed', 'Selected ') when l_returnflag = 'N' then if(l_linestatus = 'F', 'scheduled', 'in progress') else if(l_linestatus = 'F', 'rejected', 'rescheduled') end as status",
        "case when l_partkey % 29 = 0 then null else timestampadd(HOUR, l_partkey % 24, l_shipdate) end as scheduled_at",
        "timestampadd(DAY, -10, l_shipdate) as created_at",
        "case when l_suppkey % 9 = 0 then null else l_quantity end as interview_score",
        "case when l_partkey % 5 = 0 then null else round(l_discount * 100 + 0.0, 2) end as technical_score",
        "case when l_partkey % 6 = 0 then null else round(l_tax * 100 + 0.0, 2) end as communication_score",
        "case when l_partkey % 4 = 0 then null else l_linenumber * 10.0D end as culture_fit_score",
        "l_partkey % 3 = 0 as is_async",
        "case when l_partkey % 8 < 3 then concat('https://sessions.example/interview?session=', l_partkey) end as async_link",
        "case when l_partkey % 8 = 1 then 'https://meet.example/x' when l_partkey % 8 = 2 then ' ' end as meeting_link",
        "case when l_suppkey % 6 = 0 then concat('t', l_partkey) end as transcript",
        "case when l_suppkey % 10 = 0 then l_shipdate end as async_completed_at",
    )


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line items as booked slots, whose candidate is spelled in several ways."""
    return table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").selectExpr(
        "concat_ws('-', l_orderkey, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd')) as id",
        "case l_orderkey % 4 when 0 then concat('C', l_orderkey) when 1 then cast(l_orderkey as string) when 2 then concat('{c', l_orderkey, '}') else concat(' c', l_orderkey, ' ') end as candidate",
        "to_date(l_shipdate) as slot_date",
        "case when l_partkey % 10 = 0 then null else concat(lpad(cast(l_partkey % 24 as string), 2, '0'), ':', lpad(cast(l_suppkey % 60 as string), 2, '0'), ':00') end as slot_time",
        "timestampadd(DAY, -3, l_shipdate) as created_at",
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "ts", "user_id", "event_type as action", "value", "cast(get_json_object(props, '$.k') as int) as k"
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as wallet transactions: purchases are credits, the rest debits."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "user_id % 100 as user_id",
        "cast(floor(value) as int) as amount",
        "if(event_type = 'purchase', 'CREDIT', 'DEBIT') as transaction_type",
        "case event_type when 'view' then concat('Interview completed - Interview ID ', event_id % 500) when 'purchase' then 'Top-up' else event_type end as description",
        "ts as created_at",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as e-mails to candidates."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "event_id % 3000 as candidate_id",
        "element_at(array('interview_invite', 'shortlist_mail', 'rejection_mail', 'offer_letter', null), cast(event_id % 5 as int) + 1) as email_type",
        "case when event_type = 'error' then 'failed' else 'sent' end as status",
        "case when event_id % 4 = 0 then null else ts end as sent_at",
        "ts as created_at",
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metered usage of an agency's features."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "cast(user_id % 5 as int) as agency_id",
        "element_at(array('interview', 'resume', 'job_post'), cast(event_id % 3 as int) + 1) as feature",
        "cast(1 + event_id % 3 as int) as amount",
        "ts",
    )
