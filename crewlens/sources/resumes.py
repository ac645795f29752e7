"""Résumés made of the documents' whole texts, with headings, entries and contact lines set between their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands before a line, by (id + place) modulo their number; {y} is a year, {z} two years later, {c} a company.
INSERTS = (
    "Professional Summary",
    "Technical Skills: Python, SQL; Docker",
    "WORK EXPERIENCE",
    "Organization: {c}\nDesignation: Senior Engineer\nPeriod: Jan {y} - Mar {z}",
    "Data Analyst | 06/{y} to Present {c} Led a team",
    "I worked as Lead Designer and joined Initech from {y} to {z} there",
    "Education:",
    "Awards & Recognition",
    "References",
    "Languages: English, Hindi",
    "Worked from {y} to {z} with 5 years of experience",
    "Contact: Pune",
    "",
    "Projects",
    "Trained FY {y}-{z} and after",
    "Responsibilities: plan and build\nReports to {c}",
)
COMPANIES = ("Acme Pvt Ltd", "Globex Solutions", "Initech")
FIRST_YEAR, YEARS = 1998, 20
PEOPLE = ("Asha Verma", "Ravi Kumar", "Meera Nair", "Jon Snow")
PLACES = ("Pune, India", "Navi Mumbai, India", "Oslo, Norway")


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): one résumé for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = lambda i: F.col("doc_id") + i

    def before(i):
        year = (number(i) % YEARS + FIRST_YEAR).cast("string")
        company = F.element_at(F.array(*[F.lit(x) for x in COMPANIES]), (F.col("doc_id") % len(COMPANIES) + 1).cast("int"))
        text = F.element_at(F.array(*[F.lit(x) for x in INSERTS]), (number(i) % len(INSERTS) + 1).cast("int"))
        later = (number(i) % YEARS + FIRST_YEAR + 2).cast("string")
        for mark, value in (("{y}", year), ("{z}", later), ("{c}", company)):
            text = F.replace(text, F.lit(mark), value)
        return text

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(before(i), F.lit("\n"), x))
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % len(xs) + 1).cast("int"))
    mail = F.concat(F.lit("asha"), F.col("doc_id").cast("string"), F.lit("@mail.example"))
    head = F.concat(pick(PEOPLE), F.lit(" "), pick(PLACES), F.lit(" "), mail, F.lit("\nemail: "), mail, F.lit("\n"))
    return docs.select(F.col("doc_id").alias("id"), F.concat(head, F.array_join(lines, "\n")).alias("text"))


#: Work histories as people write them: block, line and prose forms, and lines that only look like one; {y}, {z} and {m} are years and a month.
HISTORIES = (
    "Senior Data Engineer at Globex Solutions\n{m} {y} - {m} {z}\nBuilt pipelines for reporting",
    "Acme Pvt Ltd | QA Lead | 06/{y} - Present\nTested releases",
    "Initech Systems - Pune, India\nProduct Manager\n{y} - {z}\nOwned the roadmap",
    "{m} {y} to {m} {z}\nSoftware Engineer\nHooli Technologies",
    "* Led three projects\n* {y} - {z} migration",
    "Backend Developer, Umbrella Labs, {m}'{y2} - till date",
    "Certified Associate\nCisco Systems\n{y} - {z}",
    "Business Analyst in Stark Works ({y} - {z})",
    "I worked as a Lead Designer and joined Wayne Corp from {y} to {z} there",
    "Data Analyst | 0{d}/{y} to {z} Vandelay Inc Led a team of four QA Engineer | {z} - Present Soylent Corp Built tests",
    "Consultant\nWonka Solutions, since {y}",
    "Joined {m} {y} and worked until {m} {z}\nTyrell Corporation",
    "Trainer, FY {y}-{z2}\nPied Piper Academy",
    "Python Developer\nAperture\n{z} - {y}",
    "Chaired a reading group, no dates",
    "Associate Consultant\nMassive Dynamic Services\n{y}.0{d} - {z}.0{d}",
    "Organization: Cyberdyne Systems\nDesignation: Principal Engineer\nPeriod\n{m} {y} - {m} {z}",
    "Director of Sales @ Oscorp\n{y} ~ {z}",
    "{y} - {z}",
    "1. Team Lead - Nakatomi Trading\n{m} {y} - Current",
)
MONTH_NAMES = ("Jan", "Feb", "March", "Apr", "May", "June", "Jul", "August", "Sept", "Oct", "Nov", "Dec")


def work_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content): one section of work history for each document; entries stand between lines of its whole text.

    Which entries, their dates, and whether empty lines part them, follow from a hash of the id and the line's place.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def entry(i):
        number = F.pmod(F.xxhash64(F.col("doc_id"), i), F.lit(1 << 30)).cast("int")
        year = FIRST_YEAR + number % YEARS
        values = {
            "{y}": year, "{z}": year + 1 + (number / 64).cast("int") % 4, "{y2}": F.lpad((year % 100).cast("string"), 2, "0"),
            "{z2}": F.lpad(((year + 1) % 100).cast("string"), 2, "0"), "{d}": 1 + number % 9,
            "{m}": F.element_at(F.array(*[F.lit(x) for x in MONTH_NAMES]), 1 + (number / 7).cast("int") % 12),
        }
        text = F.element_at(F.array(*[F.lit(x) for x in HISTORIES]), 1 + (number / 512).cast("int") % len(HISTORIES))
        for mark, value in values.items():
            text = F.replace(text, F.lit(mark), value.cast("string"))
        gap = F.when(number % 3 > 0, "\n").otherwise("")
        return F.concat(gap, text, gap, F.lit("\n"))

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(entry(i), x))
    return docs.select(F.col("doc_id").alias("id"), F.array_join(lines, "\n").alias("content"))


#: Heads of résumés as people write them; {n}, {u}, {c}, {t}, {m} and {p} are a name, the name in capitals, a town, its country, an address, a number.
HEADS = (
    "{n}\n{c}, {t}\n{m}", "Name: {n}\nLocation: {c}\n{m}", "RESUME\n{u}\n{c} | {m}", "CURRICULUM VITAE\n{n} | Senior Engineer | {p}\nAddress: 12 Main Street, {c}, {t}", "{n}, {p}\n{c}",
    "{n} - Data Analyst\nBased in {c}, {t}", "Senior Data Engineer\n{n}\n{c} | {m}", "Acme Technologies Pvt Ltd\n{n}\n{m}\nCity: {c}", "{m}\n{p}\n{n}\nCurrent location: {c}", "Profile Summary\n{n}\n{p}\nLiving in {c}",
    "{u}\n{p} | {m}\nLocated in {c}", "Full Name - {n}\nEmail: {m}\nPlace: {c}", "{n} {m}\n{c}, {t}", "{n} {p}\nLanguages: English, Hindi\n{c}", "Contact\n{m}\n{n}\nResiding in {c}, {t}", "{n} | {c}, {t} | {m}",
    "QA Lead\nPython, SQL\n{n}\n{c}", "{n} · {m}\nWilling to relocate to {c}", "1. {m}\n{n}\nAddress - {c}", "Global Services Limited\nProject Manager\n{n}\n{c}, {t}", "{u}, {p}\nlocation: {c}",
    "Email {m}\nPhone {p}\n{n}\n{c}", "  {n}  \n\n\n  {c} ,  {t} ", "Objective\nTo grow as an analyst\n{n}\n{m}\n{c}", "Nationality: {t}\n{n}\nLocation - {c}", "Technology project at {t}\n{n}\n{c}", "{n}\nSoftware Tester at Initech Labs\n{p}\n{m}\n{c}",
    "Name - {u}\nCity - {c}", "DevOps Consultant | AWS\n{n} | {p}\nbased in {c}", "{n} Email: {m} Phone: {p}\nLocation: {c}, {t}", "Updated CV 2024\nMachine Learning Engineer\n{u} | {m}\n{c}", "{m} | {p}\n{n} • Designer\nPlace - {c}",
)
SKILLS = ("Python", "SQL", "Docker", "Kubernetes", "React", "Java", "Excel", "Spark")
FIRST_NAMES = ("Asha", "Ravi", "Meera", "Jon", "Lena", "Omar", "Priya", "Tomas", "Ines", "Kofi", "Yuki", "Sara", "Mateo", "Nadia", "Viktor")
LAST_NAMES = ("Verma", "Kumar", "Nair", "Snow", "Berg", "Haddad", "Das", "Novak", "Costa", "Mensah", "Tanaka", "Lind", "Rojas", "Petrov", "O'Brien", "van Dyk")
#: Spellings of towns, and the town with its country as it is given back.
TOWNS = (
    ("pune", "Pune, India"), ("bengaluru", "Bengaluru, India"), ("bangalore", "Bengaluru, India"), ("new delhi", "New Delhi, India"), ("navi mumbai", "Navi Mumbai, India"), ("mumbai", "Mumbai, India"), ("bombay", "Mumbai, India"),
    ("oslo", "Oslo, Norway"), ("rio de janeiro", "Rio de Janeiro, Brazil"), ("lima", "Lima, Peru"), ("são paulo", "São Paulo, Brazil"), ("st. gallen", "St. Gallen, Switzerland"),
)


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, shape, name, town, skills): a résumé for each document, with a head in one of the shapes before its whole text, and what was put there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("int")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), 1 + n % len(xs))
    name = F.concat(pick(FIRST_NAMES, number), F.lit(" "), pick(LAST_NAMES, (number / 32).cast("int")))
    town = F.initcap(pick([a for a, _ in TOWNS], (number / 1024).cast("int")))
    country = pick([b.split(", ")[1] for _, b in TOWNS], (number / 1024).cast("int"))
    shape = F.pmod(F.col("doc_id"), F.lit(len(HEADS))).cast("int")
    mail = F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit("@mail.example"))
    head = pick(HEADS, shape)
    for mark, value in (("{n}", name), ("{u}", F.upper(name)), ("{c}", town), ("{t}", country), ("{m}", mail), ("{p}", F.lit("+91 98450 12345"))):
        head = F.replace(head, F.lit(mark), value)
    own = F.filter(F.array(*[F.lit(x) for x in SKILLS]), lambda _, i: F.shiftright(number, 12).bitwiseAND(F.lit(1 << 8) - 1) % F.element_at(F.array(*[F.lit(n) for n in (2, 3, 5, 7, 2, 3, 5, 7)]), i + 1) == 0)
    lists = (F.array_join(own, ", "), F.concat(F.lit("- "), F.array_join(own, "\n- ")), F.concat(F.lit("Have used "), F.array_join(own, " and then "), F.lit(" with care")))
    way = (number / 2048).cast("int") % len(lists)
    skills = F.when(way == 0, lists[0]).when(way == 1, lists[1]).otherwise(lists[2])
    # the text begins below the head, as the rest of a résumé does
    text = F.concat(head, F.lit("\n\nSKILLS\n"), skills, F.lit("\n\nEXPERIENCE\n"), F.coalesce("text", F.lit("")))
    town_of = pick([b for _, b in TOWNS], (number / 1024).cast("int"))
    return docs.select(F.col("doc_id").alias("id"), text.alias("text"), shape.alias("shape"), name.alias("name"), town_of.alias("town"), F.array_sort(own).alias("skills"))
