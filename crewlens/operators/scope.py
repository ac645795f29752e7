"""Filters and row-level visibility: frame in, frame out.  Clocks are parameters."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Viewer:
    """Who looks: an id, a role, and the agency or company that the role is bound to."""

    id: int
    role: str
    agency_id: int | None = None
    company: str | None = None


def norm(c: Column | str) -> Column:
    """Trimmed and lower-cased."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def date_window(df: DataFrame, field: str | Column, from_date=None, to_date=None, date=None, month=None) -> DataFrame:
    """Inclusive from/to dates beat one date, which beats a month 'YYYY-MM'; nothing given keeps all rows."""
    c = F.col(field) if isinstance(field, str) else field
    if from_date or to_date:
        if from_date:
            df = df.filter(c >= F.lit(from_date).cast("timestamp"))
        return df.filter(c < F.date_add(F.lit(to_date).cast("date"), 1).cast("timestamp")) if to_date else df
    if date:
        return df.filter((c >= F.lit(date).cast("timestamp")) & (c < F.date_add(F.lit(date).cast("date"), 1).cast("timestamp")))
    if month:
        first = F.lit(f"{month}-01").cast("date")
        return df.filter((c >= first.cast("timestamp")) & (c < F.add_months(first, 1).cast("timestamp")))
    return df


ROLLING_DAYS = {"last_7_days": 7, "last_30_days": 30, "last_3_months": 90, "last_6_months": 180}


def rolling_window(df: DataFrame, field: str, name: str, as_of: str, start=None, end=None) -> DataFrame:
    """The last days before ``as_of`` by name; 'custom' takes inclusive dates; an unknown name keeps all rows."""
    if name in ROLLING_DAYS:
        return df.filter(F.col(field) >= F.expr(f"timestamp'{as_of}' - interval {ROLLING_DAYS[name]} days"))
    return date_window(df, field, start, end) if name == "custom" else df


def period_windows(name: str, as_of: str, start=None, end=None) -> tuple[datetime, datetime, datetime, datetime]:
    """Start and end of the period, and of the one of the same length just before it."""
    now = datetime.fromisoformat(as_of)
    if name == "custom" and start and end:
        first, last = datetime.fromisoformat(start), datetime.fromisoformat(end) + timedelta(hours=23, minutes=59, seconds=59)
    else:
        first, last = now - timedelta(days=ROLLING_DAYS.get(name, 30)), now
    return first, last, first - (last - first), first


def visible_candidates(cands: DataFrame, jobs: DataFrame, users: DataFrame, viewer: Viewer) -> DataFrame:
    """Candidates that a viewer may see.

    Super admins see all; admins what belongs to their agency by candidate, job, creator or assignee;
    clients the candidates of their company's jobs, without a company none; others what is assigned to them.
    """
    if viewer.role == "super_admin":
        return cands
    if viewer.role == "admin":
        j = jobs.select(F.col("id").alias("_job"), F.col("agency_id").alias("_job_agency"))
        people = users.select("id", "agency_id")
        creator = people.toDF("_creator", "_creator_agency")
        assignee = people.toDF("_assignee", "_assignee_agency")
        mine = [F.col(c) == F.lit(viewer.agency_id) for c in ("agency_id", "_job_agency", "_creator_agency", "_assignee_agency")]
        return (
            cands.join(j, F.col("job_id") == F.col("_job"), "left")
            .join(creator, F.col("created_by") == F.col("_creator"), "left")
            .join(assignee, F.col("assigned_to") == F.col("_assignee"), "left")
            .filter(mine[0] | mine[1] | mine[2] | mine[3])
            .select(*cands.columns)
        )
    if viewer.role == "client":
        if not (viewer.company or "").strip():
            return cands.limit(0)
        own = jobs.filter(norm("company_name") == viewer.company.strip().lower()).select(F.col("id").alias("job_id"))
        return cands.join(own, "job_id", "left_semi").select(*cands.columns)
    return cands.filter(F.col("assigned_to") == viewer.id)


def visible_jobs(jobs: DataFrame, cands: DataFrame, viewer: Viewer) -> DataFrame:
    """Jobs that a viewer may see: the agency's, the company's, or those with a candidate assigned to the viewer."""
    if viewer.role == "super_admin":
        return jobs
    if viewer.role == "admin":
        return jobs.filter(F.col("agency_id") == viewer.agency_id)
    if viewer.role == "client":
        return jobs.filter(norm("company_name") == (viewer.company or "").strip().lower())
    own = cands.filter((F.col("assigned_to") == viewer.id) & F.col("job_id").isNotNull()).select(F.col("job_id").alias("id"))
    return jobs.join(own, "id", "left_semi").select(*jobs.columns)


def of_client(cands: DataFrame, jobs: DataFrame, company: str | None) -> DataFrame:
    """Candidates of jobs of a company, by trimmed lower-cased name; no company keeps all rows."""
    if not company or company == "all":
        return cands
    own = jobs.filter(norm("company_name") == company.strip().lower()).select(F.col("id").alias("job_id"))
    return cands.join(own, "job_id", "left_semi").select(*cands.columns)


def scoped(cands: DataFrame, jobs: DataFrame, recruiter=None, client=None, department=None) -> DataFrame:
    """Recruiter, client and department filters; 'all' and, for the recruiter, what is not a number keep all rows."""
    if recruiter not in (None, "all") and str(recruiter).isdigit():
        cands = cands.filter(F.col("assigned_to") == int(recruiter))
    cands = of_client(cands, jobs, client)
    if department and department != "all":
        own = jobs.filter(F.col("department") == department).select(F.col("id").alias("job_id"))
        cands = cands.join(own, "job_id", "left_semi").select(*cands.columns)
    return cands


def contains(text: str, *columns: Column) -> Column:
    """Whether any column holds the text, whatever its case; the text's % and _ are ordinary."""
    safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(c.ilike(f"%{safe}%"), F.lit(False))
    return found


def search_candidates(cands: DataFrame, jobs: DataFrame, text: str) -> DataFrame:
    """Candidates with the text in name, e-mail, code, source or skills, or in their job."""
    j = jobs.filter(contains(text, *[F.col(c) for c in ("title", "company_name", "department", "city")])).select(F.col("id").alias("_job"))
    own = contains(text, *[F.col(c) for c in ("name", "email", "code", "source")], F.to_json("skills"))
    marked = cands.join(j.distinct(), F.col("job_id") == F.col("_job"), "left")
    return marked.filter(own | F.col("_job").isNotNull()).select(*cands.columns)


def search_jobs(jobs: DataFrame, text: str) -> DataFrame:
    return jobs.filter(contains(text, *[F.col(c) for c in ("title", "company_name", "department", "city", "state", "country", "skills_json")]))


def filter_jobs(jobs: DataFrame, location=None, skills: str | None = None, status=None) -> DataFrame:
    """Jobs by place, by all skills of a comma-separated list, and by lower-cased status."""
    if location:
        jobs = jobs.filter(contains(location, *[F.col(c) for c in ("city", "state", "country")]))
    for skill in [s.strip() for s in (skills or "").split(",") if s.strip()]:
        jobs = jobs.filter(contains(skill, F.col("skills_json")))
    return jobs.filter(F.lower("status") == status.lower()) if status else jobs


def active_job(as_of: str) -> Column:
    """Active, of no or an open status, and not past its last day."""
    status = F.col("status").isNull() | F.lower("status").isin("active", "published", "open")
    return F.col("is_active") & status & (F.col("valid_through").isNull() | (F.col("valid_through") >= F.lit(as_of).cast("timestamp")))


def open_job(as_of: str) -> Column:
    """As ``active_job`` with the status trimmed and no status read as open."""
    status = F.lower(F.trim(F.coalesce("status", F.lit("open")))).isin("active", "published", "open")
    return F.coalesce("is_active", F.lit(False)) & status & (F.col("valid_through").isNull() | (F.col("valid_through") >= F.lit(as_of).cast("timestamp")))


def stuck(cands: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Candidates shortlisted or scheduled for longer than so many days."""
    late = F.col("stage_entered_at") < F.expr(f"timestamp'{as_of}' - interval {days} days")
    return cands.filter(F.col("stage").isin("SHORTLISTED", "INTERVIEW_SCHEDULED") & late)


def page(df: DataFrame, order: list[Column], page=None, limit=None, offset=None) -> DataFrame:
    """Rows of one page; nothing given keeps all rows.  The limit is held between 1 and 200, 20 if not given."""
    df = df.orderBy(*order)
    if page is None and limit is None and offset is None:
        return df
    size = max(1, min(limit or 20, 200))
    skip = offset if offset is not None else (max(page or 1, 1) - 1) * size
    return df.offset(max(0, skip)).limit(size)


def duplicates_of(new: DataFrame, known: DataFrame) -> DataFrame:
    """New candidates whose job, name and e-mail, trimmed and lower-cased, a known one has; blanks never match."""
    key = lambda d: d.select(F.col("job_id").alias("_j"), norm("name").alias("_n"), norm("email").alias("_e"))
    k = key(known).filter("_n <> '' and _e <> ''").distinct()
    cond = (new["job_id"] == k["_j"]) & (norm(new["name"]) == k["_n"]) & (norm(new["email"]) == k["_e"])
    return new.join(k, cond, "left_semi")


def settings(owners: DataFrame, own: DataFrame, defaults: dict[str, int]) -> DataFrame:
    """(agency, key, value) of every owner and key: its own setting, else the default."""
    every = owners.select("agency", F.explode(F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])).alias("key", "standard"))
    return every.join(own, ["agency", "key"], "left").select("agency", "key", F.coalesce("value", "standard").alias("value"))


def beyond(rows: DataFrame, key: Column, skip: int) -> DataFrame:
    """All rows after the first ``skip`` by an ascending ``key`` whose ties are equal rows; no task holds them all.

    Only the first rows are gathered, for the last key among them and how often they have it; equal rows are counted.
    """
    keyed = rows.withColumn("_key", key)
    last = keyed.orderBy("_key").limit(skip).groupBy(F.col("_key").alias("_last")).agg(F.count(F.lit(1)).alias("_seen")).orderBy(F.col("_last").desc()).limit(1)
    both = keyed.crossJoin(F.broadcast(last))  # one row
    same = both.filter("_key = _last").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"), F.max("_seen").alias("_seen")).filter("_n > _seen")
    left = same.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n") - F.col("_seen"))))
    return both.filter("_key > _last").select(*rows.columns).union(left.select(*rows.columns))


def search_interviews(interviews: DataFrame, candidates: DataFrame, jobs: DataFrame, words: str) -> DataFrame:
    """Interviews whose status or transcript, candidate's name or job's title has the words; ids of candidates and jobs are unique.

    Each text is searched where it stands, so only keys are shuffled, and no interview that its own texts have found.
    """
    hit = lambda *names: F.coalesce(contains(words, *[F.col(x) for x in names]), F.lit(False))
    titled = jobs.filter(hit("title")).select(F.col("id").alias("job_id"))
    named = candidates.filter(hit("name")).select("id")
    others = candidates.filter(~hit("name")).select("id", "job_id").join(titled, "job_id", "left_semi").select("id")
    found = named.union(others).withColumnRenamed("id", "candidate_id")
    rest = interviews.filter(~hit("status", "transcript")).select("id", "candidate_id").join(found, "candidate_id", "left_semi")
    return interviews.filter(hit("status", "transcript")).select("id").union(rest.select("id"))
