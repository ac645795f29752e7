"""The canonical views in DuckDB SQL, written independently of the DataFrame ones, and the query register."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import resumes as made

Query = Callable[[SparkSession, str], DataFrame]

VIEWS = {
    "agencies": "SELECT r_regionkey AS id, r_name AS name, lower(replace(r_name, ' ', '-')) AS slug, r_regionkey <> 4 AS is_active FROM region",
    "users": """
  SELECT s_suppkey AS id, s_name AS name, n_regionkey AS agency_id,
         CASE s_suppkey % 5 WHEN 0 THEN 'admin' WHEN 2 THEN 'hiring_manager' WHEN 3 THEN 'viewer' ELSE 'recruiter' END AS role,
         n_name AS department, s_acctbal > 0 AS is_active, CAST(trunc(s_acctbal) AS INT) AS wallet_balance,
         TIMESTAMP '2000-01-01' + to_hours(s_suppkey) AS created_at,
         CASE WHEN s_suppkey % 7 <> 0 THEN TIMESTAMP '2001-08-01 06:30:00' - to_minutes(s_suppkey % 60) END AS last_login_at
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "jobs": """
  SELECT c_custkey AS id, n_regionkey AS agency_id, 'Engineer ' || (c_custkey % 50) AS title,
         CASE WHEN c_custkey % 31 <> 0 THEN ' ' || n_name END AS company_name,
         CASE WHEN c_custkey % 20 = 0 THEN '' WHEN c_custkey % 21 = 0 THEN NULL ELSE c_mktsegment END AS department,
         CAST(nullif(c_custkey % 6, 5) AS INT) AS vacancies, c_acctbal > 0 AS is_active,
         CASE c_custkey % 6 WHEN 1 THEN 'active' WHEN 2 THEN ' Published' WHEN 3 THEN 'open' WHEN 4 THEN 'closed' WHEN 5 THEN 'draft' END AS status,
         CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2001-08-01 06:30:00' + to_days(CAST(c_custkey % 400 - 200 AS INT)) END AS valid_through,
         CASE c_custkey % 4 WHEN 0 THEN 'Pune' WHEN 1 THEN 'Mumbai' WHEN 2 THEN ' ' ELSE 'Delhi' END AS city,
         CASE WHEN c_custkey % 3 <> 0 THEN 'MH' END AS state, 'India' AS country,
         '["sql","' || CASE c_custkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE 'React' END || '"]' AS skills_json,
         '$' || (10000 + c_custkey) || ' - ' || (20000 + 2 * c_custkey) || ' per year' AS salary_range,
         TIMESTAMP '1998-01-01' + to_days(CAST(c_custkey % 1000 AS INT)) AS created_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "candidates": """
  SELECT o_orderkey AS id, 'C' || o_orderkey AS code, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS job_id,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 5 AS INT) END AS agency_id,
         'Cand ' || (o_orderkey % 5000) AS name, 'c' || (o_orderkey % 4000) || '@mail.example' AS email,
         CASE o_orderstatus
           WHEN 'F' THEN ['APPLIED', 'SHORTLISTED', 'RESUME_REJECTED', 'REVIEW', 'INTERVIEW_SCHEDULED'][CAST(o_orderpriority[1] AS INT)]
           WHEN 'O' THEN ['INTERVIEW_RESCHEDULED', 'INTERVIEWED', 'SELECTED', 'INTERVIEW_REVIEW', 'NO_SHOW'][CAST(o_orderpriority[1] AS INT)]
           ELSE ['SELECTED', 'REJECTED', 'INTERVIEW_FAILED', 'OFFER_MADE', 'APPLIED'][CAST(o_orderpriority[1] AS INT)] END AS stage,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 5000 END AS resume_score,
         CASE WHEN o_orderkey % 17 <> 0 THEN CAST(60 AS DOUBLE) END AS score_threshold,
         CASE WHEN o_orderkey % 9 <> 0 THEN list_transform([0, 5, 10], lambda k: ['python', 'js', 'React.js', 'c++', 'html5', 'Node.js', 'sql', 'docker-compose',
           'k8s', 'engineering', 'java', 'git', 'machine learning', 'Postgres', 'excel', 'go'][(o_orderkey * 7 + k) % 16 + 1]) END AS skills,
         CASE WHEN o_orderkey % 19 <> 0 THEN o_orderpriority END AS source,
         CASE o_orderkey % 23 WHEN 0 THEN 'salary' WHEN 1 THEN 'location' END AS decline_reason,
         CASE o_orderstatus || o_orderpriority WHEN 'F1-URGENT' THEN 'accepted' WHEN 'F2-HIGH' THEN 'made' WHEN 'O1-URGENT' THEN 'Accepted' END AS offer_status,
         o_custkey % 100 AS assigned_to, o_orderkey % 100 AS created_by, o_orderdate AS created_at,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 30 AS INT)) END AS updated_at,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_hours((o_orderkey % 45) * 24 + 5) END AS stage_updated_at,
         CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 60 AS INT)) END AS stage_entered_at
  FROM orders""",
    "interviews": """
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS id,
         l_orderkey AS candidate_id,
         CASE WHEN l_linenumber = 7 THEN 'No-Show' ELSE CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'completed' WHEN 'AO' THEN 'Selected '
           WHEN 'NF' THEN 'scheduled' WHEN 'NO' THEN 'in progress' WHEN 'RF' THEN 'rejected' ELSE 'rescheduled' END END AS status,
         CASE WHEN l_partkey % 29 <> 0 THEN l_shipdate + to_hours(l_partkey % 24) END AS scheduled_at,
         l_shipdate - INTERVAL 10 DAY AS created_at, CASE WHEN l_suppkey % 9 <> 0 THEN l_quantity END AS interview_score,
         CASE WHEN l_partkey % 5 <> 0 THEN round(l_discount * 100 + 0.0, 2) END AS technical_score,
         CASE WHEN l_partkey % 6 <> 0 THEN round(l_tax * 100 + 0.0, 2) END AS communication_score,
         CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_linenumber * 10 AS DOUBLE) END AS culture_fit_score,
         l_partkey % 3 = 0 AS is_async,
         CASE WHEN l_partkey % 8 < 3 THEN 'https://sessions.example/interview?session=' || l_partkey END AS async_link,
         CASE l_partkey % 8 WHEN 1 THEN 'https://meet.example/x' WHEN 2 THEN ' ' END AS meeting_link,
         CASE WHEN l_suppkey % 6 = 0 THEN 't' || l_partkey END AS transcript, CASE WHEN l_suppkey % 10 = 0 THEN l_shipdate END AS async_completed_at
  FROM lineitem""",
    "slots": """
  SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS id,
         CASE l_orderkey % 4 WHEN 0 THEN 'C' || l_orderkey WHEN 1 THEN CAST(l_orderkey AS VARCHAR) WHEN 2 THEN '{c' || l_orderkey || '}' ELSE ' c' || l_orderkey || ' ' END AS candidate,
         CAST(l_shipdate AS DATE) AS slot_date,
         CASE WHEN l_partkey % 10 <> 0 THEN lpad(CAST(l_partkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0') || ':00' END AS slot_time,
         l_shipdate - INTERVAL 3 DAY AS created_at
  FROM lineitem WHERE l_linenumber = 1""",
    "activity": "SELECT event_id AS id, ts, user_id, event_type AS action, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "ledger": """
  SELECT event_id AS id, user_id % 100 AS user_id, CAST(floor(value) AS INT) AS amount,
         CASE WHEN event_type = 'purchase' THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type,
         CASE event_type WHEN 'view' THEN 'Interview completed - Interview ID ' || (event_id % 500) WHEN 'purchase' THEN 'Top-up' ELSE event_type END AS description,
         ts AS created_at
  FROM events""",
    "messages": """
  SELECT event_id AS id, event_id % 3000 AS candidate_id,
         CASE event_id % 5 WHEN 0 THEN 'interview_invite' WHEN 1 THEN 'shortlist_mail' WHEN 2 THEN 'rejection_mail' WHEN 3 THEN 'offer_letter' END AS email_type,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'sent' END AS status, CASE WHEN event_id % 4 <> 0 THEN ts END AS sent_at, ts AS created_at
  FROM events""",
    "usage": """
  SELECT event_id AS id, CAST(user_id % 5 AS INT) AS agency_id, CASE event_id % 3 WHEN 0 THEN 'interview' WHEN 1 THEN 'resume' ELSE 'job_post' END AS feature,
         CAST(1 + event_id % 3 AS INT) AS amount, ts
  FROM events""",
}


def _resumes() -> str:
    """The same résumés as ``sources.resumes``."""
    lists = lambda xs: "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in xs) + "]"
    year = lambda more: f"CAST((doc_id + i - 1) % {made.YEARS} + {made.FIRST_YEAR + more} AS VARCHAR)"
    insert = f"{lists(made.INSERTS)}[(doc_id + i - 1) % {len(made.INSERTS)} + 1]"
    for mark, value in (("{y}", year(0)), ("{z}", year(2)), ("{c}", f"{lists(made.COMPANIES)}[doc_id % {len(made.COMPANIES)} + 1]")):
        insert = f"replace({insert}, '{mark}', {value})"
    pick = lambda xs: f"{lists(xs)}[doc_id % {len(xs)} + 1]"
    head = f"{pick(made.PEOPLE)} || ' ' || {pick(made.PLACES)} || ' asha' || doc_id || '@mail.example' || chr(10) || 'email: asha' || doc_id || '@mail.example' || chr(10)"
    lines = f"list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {insert} || chr(10) || x)"
    return f"SELECT doc_id AS id, {head} || array_to_string({lines}, chr(10)) AS text FROM documents"


VIEWS["resumes"] = _resumes()


def with_views(sql: str) -> str:
    """The statement with the views that it names, and those that they name, in front."""
    body = sql.strip()
    wanted = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    own = re.match(r"WITH\s(RECURSIVE\s)?", body)
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    if not wanted:
        return body
    word = "WITH RECURSIVE" if own and own[1] else "WITH"
    return f"{word} {head}{', ' + body[own.end():] if own else chr(10) + body}"


class Register:
    """Queries by name with their SQL."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = with_views(sql)
            return f

        return add
