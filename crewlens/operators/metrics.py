"""Dashboard metrics: one pass of conditional aggregates wherever the reported numbers allow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PASS_SCORE
from .pipeline import literal_map, out_of_ten, plain_status
from .windows import funnel, latest_interview


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def ratio(part: Column, whole: Column, digits: int = 1, scale: float = 100.0) -> Column:
    """scale * part / whole, zero where the whole is zero."""
    return F.round(F.coalesce(F.try_divide(part * scale, whole), F.lit(0.0)), digits)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days between two times, towards minus infinity."""
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86400)


def hired_at() -> Column:
    return F.coalesce("stage_updated_at", "updated_at", "created_at")


def stage_metrics(cands: DataFrame, exclude_applied: bool = False) -> DataFrame:
    """One row: candidates, four stage counts, sum and count of résumé scores."""
    base = cands.filter("stage <> 'APPLIED'") if exclude_applied else cands
    stage = lambda s: F.coalesce(count_if(F.col("stage") == s), F.lit(0)).cast("long").alias(s.lower())
    return base.agg(
        F.count(F.lit(1)).alias("total_candidates"),
        *[stage(s) for s in ("SHORTLISTED", "RESUME_REJECTED", "SELECTED", "REJECTED")],
        F.round(F.coalesce(F.sum("resume_score"), F.lit(0.0)), 2).alias("resume_score_sum"),
        F.count("resume_score").alias("resume_score_count"),
    )


def interview_metrics(cands: DataFrame, interviews: DataFrame) -> DataFrame:
    """One row of counts over candidates' latest interviews; filter the interviews by date first."""
    own = cands.select(F.col("id").alias("candidate_id"), "stage", "resume_score")
    last = latest_interview(interviews).select("candidate_id", "status", "interview_score").join(own, "candidate_id")
    s, score = plain_status(F.col("status")), out_of_ten(F.col("interview_score"))
    done, passed = s == "completed", F.coalesce(score, F.lit(0.0)) >= PASS_SCORE
    whole = lambda c: F.coalesce(count_if(c), F.lit(0)).cast("long")
    return last.agg(
        whole(s.isin("scheduled", "ongoing")).alias("interviews_scheduled"),
        whole((F.col("stage") == "SELECTED") | (done & passed)).alias("selected"),
        whole(done & ~passed).alias("rejected"),
        whole(done).alias("completed_interviews"),
        whole(done & passed & (F.coalesce("resume_score", F.lit(0.0)) >= 80)).alias("offer_ready"),
        F.round(F.coalesce(F.avg(score), F.lit(0.0)), 4).alias("avg_interview_score"),
    )


def hiring_funnel(cands: DataFrame, interviews: DataFrame) -> DataFrame:
    """(ordinal, stage, count, percentage) of five stages; no candidates are shown as one."""
    a = stage_metrics(cands)
    b = interview_metrics(cands.filter("stage <> 'APPLIED'"), interviews)
    b = b.select("interviews_scheduled", F.col("selected").alias("_selected"), F.col("rejected").alias("_rejected"))
    one = a.crossJoin(F.broadcast(b))  # one row each
    total = F.greatest("total_candidates", F.lit(1))
    steps = (
        ("Total Candidates", total),
        ("Shortlisted", F.col("shortlisted")),
        ("Interview Scheduled", F.col("interviews_scheduled")),
        ("Selected", F.col("_selected")),
        ("Rejected", F.col("_rejected")),
    )
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("stage"), c.alias("count")) for i, (n, c) in enumerate(steps)])
    tall = one.select(total.alias("_total"), F.explode(rows).alias("r")).select("_total", "r.*")
    return tall.select("ordinal", "stage", "count", F.round(F.col("count") * 100.0 / F.col("_total"), 1).alias("percentage"))


def recruitment_funnel(shown: DataFrame, as_of: str) -> DataFrame:
    """Seven steps with conversion, drop-off and mean days in stage, from candidates with their ``shown`` stage."""
    since = F.coalesce("stage_entered_at", "stage_updated_at", "created_at")
    days = F.greatest(F.lit(0), elapsed_days(since, F.lit(as_of).cast("timestamp")))
    offer = F.lower(F.coalesce("offer_status", F.lit("")))
    steps = {
        "Applied": F.lit(True),
        "Screened": F.col("stage") != "APPLIED",
        "Shortlisted": F.col("stage") == "SHORTLISTED",
        "Interviewed": F.col("shown").isin("INTERVIEW_SCHEDULED", "INTERVIEWED"),
        "Selected": F.col("shown") == "SELECTED",
        "Offered": offer.isin("made", "accepted"),
        "Hired": offer == "accepted",
    }
    counts = [F.coalesce(count_if(c), F.lit(0)).cast("long").alias(f"n_{k}") for k, c in steps.items()]
    means = [F.round(F.coalesce(F.avg(F.when(c, days)), F.lit(0.0)), 1).alias(f"d_{k}") for k, c in steps.items()]
    wide = shown.agg(*counts, *means)
    told = funnel(wide, [(k, f"n_{k}") for k in steps])
    times = wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), F.col(f"d_{k}").alias("avg_days")) for k in steps])).alias("r")).select("r.*")
    return told.join(F.broadcast(times), "stage")  # seven rows


INTERVIEWED = ("INTERVIEW_SCHEDULED", "INTERVIEW_RESCHEDULED", "INTERVIEWED", "SELECTED", "REJECTED")


def kpis(cands: DataFrame, interviews: DataFrame, open_jobs: DataFrame, windows) -> DataFrame:
    """(key, value, previous, change_pct, trend) of nine indicators in a period against the one before."""
    a, b, c, d = [F.lit(str(t)).cast("timestamp") for t in windows]
    made = F.col("created_at")
    period = F.when((made >= a) & (made <= b), 1).when((made >= c) & (made <= d), 2)
    # the border belongs to both periods
    both = F.when(made == a, F.array(F.lit(1), F.lit(2))).when(period.isNotNull(), F.array(period))
    rows = cands.withColumn("period", F.explode(both))
    offer = F.lower(F.coalesce("offer_status", F.lit("")))
    selected = F.col("stage") == "SELECTED"
    days = F.greatest(F.lit(0), elapsed_days(F.col("created_at"), hired_at()))
    base = rows.groupBy("period").agg(
        F.count(F.lit(1)).alias("total_candidates"),
        count_if(offer.isin("made", "accepted")).alias("offers_released"),
        count_if(offer == "accepted").alias("offers_accepted"),
        count_if(selected).alias("_selected"),
        count_if(F.col("stage").isin(*INTERVIEWED)).alias("_interviewed"),
        F.round(F.coalesce(F.avg(F.when(selected, days)), F.lit(0.0)), 1).alias("avg_time_to_hire"),
    )
    live = interviews.filter(F.col("status").isin("scheduled", "in_progress")).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))
    active = rows.select("id", "period").join(live, F.col("id") == F.col("candidate_id")).groupBy("period").agg(F.sum("n").alias("active_interviews"))
    jobs = open_jobs.agg(F.count(F.lit(1)).alias("total_open_jobs"))
    spark = cands.sparkSession
    frame = spark.range(1, 3).select(F.col("id").cast("int").alias("period")).crossJoin(F.broadcast(jobs))  # two rows
    full = frame.join(base, "period", "left").join(active, "period", "left").na.fill(0)
    hires = F.when(F.col("offers_accepted") > 0, F.col("offers_accepted")).otherwise(F.col("_selected"))
    full = full.withColumn("total_hires", hires)
    full = full.withColumn("offer_acceptance_rate", ratio(F.col("offers_accepted"), F.col("offers_released")))
    full = full.withColumn("interview_to_hire_ratio", ratio(F.col("_interviewed"), F.col("total_hires"), 2, 1.0))
    keys = ("total_open_jobs", "total_candidates", "active_interviews", "offers_released", "offers_accepted", "total_hires", "avg_time_to_hire", "offer_acceptance_rate", "interview_to_hire_ratio")
    tall = full.select("period", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("v")) for k in keys])).alias("r"))
    wide = tall.groupBy("r.key").agg(F.max(F.when(F.col("period") == 1, F.col("r.v"))).alias("value"), F.max(F.when(F.col("period") == 2, F.col("r.v"))).alias("previous"))
    change = delta(F.col("value"), F.col("previous"))
    return wide.withColumn("change_pct", change).withColumn(
        "trend", F.when(F.col("change_pct") > 0, "up").when(F.col("change_pct") < 0, "down").otherwise("flat")
    )


def delta(now: Column, before: Column) -> Column:
    """Change in per cent; from zero it is 100, or 0 if nothing changed."""
    return F.when(before == 0, F.when(now == 0, 0.0).otherwise(100.0)).otherwise(F.round(F.try_divide((now - before) * 100.0, F.abs(before)), 1))


def month(c: Column) -> Column:
    """Month label, the same in all years."""
    return F.date_format(c, "MMM")


def time_to_hire(cands: DataFrame) -> DataFrame:
    days = F.greatest(F.lit(1), elapsed_days(F.col("created_at"), hired_at()))
    hired = cands.filter("stage = 'SELECTED' and created_at is not null")
    return hired.groupBy(month(F.col("created_at")).alias("month")).agg(F.round(F.avg(days), 1).alias("avg_days"))


# Spellings of skills and the name they are counted under.
HEATMAP_ALIASES = {
    "js": "javascript",
    "ts": "typescript",
    "py": "python",
    "node": "node.js",
    "nodejs": "node.js",
    "react.js": "react",
    "reactjs": "react",
    "vue.js": "vue",
    "vuejs": "vue",
    "angular.js": "angular",
    "angularjs": "angular",
    "next": "next.js",
    "nextjs": "next.js",
    "express.js": "express",
    "expressjs": "express",
    "mongo": "mongodb",
    "postgres": "postgresql",
    "k8s": "kubernetes",
    "docker-compose": "docker",
    "git": "git",
    "github": "git",
    "gitlab": "git",
}
# Words in skill lists that are no skills.
HEATMAP_BLOCKED = (
    "engineering communication course institute university board year of telangana state andhra pradesh karnataka maharashtra "
    "tamil nadu delhi mumbai bangalore hyderabad chennai kolkata pune ahmedabad education experience projects summary objective "
    "profile resume curriculum vitae personal details information contact address date birth gender nationality marital status "
    "languages hobbies interests references declaration certifications achievements awards responsibilities duties role position "
    "designation company organization"
).split()


def capitalised(c: Column) -> Column:
    """First letter upper, all others lower."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1_000_000)))


def skill_heatmap(cands: DataFrame, top: int = 15) -> DataFrame:
    """(skill, count, avg_score) of the most frequent skills; ties by name.  A score of zero is left out of the mean."""
    each = cands.select(F.explode("skills").alias("skill"), "resume_score")
    low = F.lower(F.trim("skill"))
    letters = F.regexp_replace("skill", r"[.\- #]", "").rlike(r"^\p{L}+$")
    good = ~F.col("skill").rlike("[%+0-9]") & ~low.isin(*HEATMAP_BLOCKED) & F.length("skill").between(2, 30) & letters
    named = each.filter(good).select(F.coalesce(literal_map(HEATMAP_ALIASES)[low], low).alias("s"), "resume_score")
    score = F.avg(F.when(F.col("resume_score") != 0, F.col("resume_score")))
    counted = named.groupBy("s").agg(F.count(F.lit(1)).alias("count"), F.round(F.coalesce(score, F.lit(0.0)), 1).alias("avg_score"))
    best = counted.orderBy(F.col("count").desc(), "s").limit(top)
    return best.select(capitalised(F.col("s")).alias("skill"), "count", "avg_score")


BUCKETS = (("0-20", 0, 20), ("21-40", 21, 40), ("41-60", 41, 60), ("61-80", 61, 80), ("81-100", 81, 100))


def score_distribution(cands: DataFrame) -> DataFrame:
    """Candidates by closed integer buckets; a score between two buckets is in none."""
    counts = cands.agg(*[F.coalesce(count_if(F.col("resume_score").between(a, b)), F.lit(0)).cast("long").alias(n) for n, a, b in BUCKETS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("range"), F.col(f"`{n}`").alias("count")) for n, _, _ in BUCKETS])).alias("r")).select("r.*")


def counts_by_job(cands: DataFrame) -> DataFrame:
    return cands.filter("job_id is not null").groupBy("job_id").agg(
        count_if(F.col("stage") != "APPLIED").alias("candidates"),
        count_if(F.col("stage") == "SHORTLISTED").alias("shortlisted"),
        count_if(F.col("stage") == "SELECTED").alias("selected"),
    )


def active_jobs(jobs: DataFrame, cands: DataFrame, admin: bool) -> DataFrame:
    """Active jobs with counts; ``selected`` holds the shortlisted ones; others than admins see no job without candidates."""
    full = jobs.filter("is_active").join(counts_by_job(cands), F.col("id") == F.col("job_id"), "left")
    full = full.na.fill(0, ["candidates", "shortlisted"])
    places = F.coalesce(F.nullif("vacancies", F.lit(0)), F.lit(1))
    status = F.when(F.coalesce("status", F.lit("")) != "", F.col("status")).when(F.col("shortlisted") >= places, "filled").otherwise("open")
    out = full.select("id", "title", "company_name", places.alias("vacancies"), "candidates", F.col("shortlisted").alias("selected"), status.alias("status"))
    return out if admin else out.filter("candidates > 0")


def hiring_by_department(jobs: DataFrame, cands: DataFrame) -> DataFrame:
    hired = cands.filter("job_id is not null").groupBy("job_id").agg(count_if(F.col("stage") == "SELECTED").alias("h"))
    full = jobs.join(hired, F.col("id") == F.col("job_id"), "left").na.fill(0, ["h"])
    places = F.coalesce(F.nullif("vacancies", F.lit(0)), F.lit(1))
    dept = F.coalesce(F.nullif("department", F.lit("")), F.lit("Other"))
    return full.groupBy(dept.alias("department")).agg(F.sum("h").alias("hired"), F.sum(F.greatest(F.lit(0), places - F.col("h"))).alias("open"))


def insights(cands: DataFrame, interviews: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """Up to five sentences in one array, from one row of counts."""
    now = f"timestamp'{as_of}'"
    a = cands.agg(
        count_if(F.col("stage").isin("SHORTLISTED", "INTERVIEW_SCHEDULED") & F.coalesce(F.col("stage_entered_at") < F.expr(f"{now} - interval 7 days"), F.lit(False))).alias("stuck"),
        count_if((F.col("stage") == "SHORTLISTED") & F.coalesce(F.col("resume_score") >= 85, F.lit(False))).alias("ready"),
    )
    b = interview_metrics(cands, interviews).select("completed_interviews", "offer_ready")
    recent = cands.filter(F.col("created_at") >= F.expr(f"{now} - interval 14 days")).select(F.col("job_id").alias("id"))
    c = jobs.filter("is_active").join(recent, "id", "left_anti").agg(F.count(F.lit(1)).alias("stale"))
    one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each
    many = lambda n, word: F.concat(F.col(n).cast("string"), F.lit(f" {word}"), F.when(F.col(n) > 1, "s").otherwise(""))
    said = F.array_compact(
        F.array(
            F.when(F.col("stuck") > 0, F.concat(many("stuck", "candidate"), F.lit(" waiting over 7 days in pipeline - action needed"))),
            F.when(F.col("ready") > 0, F.concat(F.col("ready").cast("string"), F.lit(" high-scoring candidate"), F.when(F.col("ready") > 1, "s").otherwise(""), F.lit(" (85+) ready for interview scheduling"))),
            F.when(F.col("completed_interviews") > 0, F.concat(many("completed_interviews", "interview"), F.lit(" completed - pending hiring decision"))),
            F.when(F.col("stale") > 0, F.concat(many("stale", "role"), F.lit(" with no applications in 14 days - review job posting"))),
            F.when(F.col("offer_ready") > 0, F.concat(F.col("offer_ready").cast("string"), F.lit(" strong candidate"), F.when(F.col("offer_ready") > 1, "s").otherwise(""), F.lit(" ready for offer - don't lose them to competitors"))),
        )
    )
    calm = F.array(F.lit("Pipeline is healthy - all candidates progressing smoothly"), F.lit("No urgent actions required today"))
    return one.select(F.when(F.size(said) == 0, calm).otherwise(F.slice(said, 1, 5)).alias("insights"))


def client_stats(jobs: DataFrame, cands: DataFrame) -> DataFrame:
    """Companies, companies with active jobs, positions, filled and open ones."""
    name = F.nullif(F.trim("company_name"), F.lit(""))
    a = jobs.agg(
        F.count_distinct(name).alias("companies"),
        F.count_distinct(F.when(F.col("is_active"), name)).alias("active_companies"),
        F.sum(F.coalesce("vacancies", F.lit(0))).cast("long").alias("positions"),
    )
    b = cands.agg(count_if(F.col("stage") == "SELECTED").alias("filled"))
    return a.crossJoin(F.broadcast(b)).withColumn("open", F.greatest(F.lit(0).cast("long"), F.col("positions") - F.col("filled")))  # one row each
