"""Synthetic candidates, each a function of ``(seed, id)`` alone.

Nothing is drawn from ``rand()`` and no row looks at another, so the result does not depend
on partitioning and generating n rows needs no shuffle.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: distributions the generated pool must follow --------------------------
DOMAIN_WEIGHTS = {
    "ai_ml": 25, "backend": 20, "frontend": 10, "data_eng": 12,
    "devops": 10, "product": 8, "security": 8, "qa": 7,
}
EXPERIENCE_WEIGHTS = {1: 3, 2: 8, 3: 12, 4: 15, 5: 15, 6: 12, 7: 10, 8: 8, 9: 6, 10: 4, 11: 3, 12: 2}
NOTICE_DAYS = [0, 15, 15, 30, 30, 30, 45, 45, 60, 60, 90]
WORK_MODES = ["On-site", "Hybrid", "Remote", "Flexible"]
AVAILABILITY = ["Actively Looking", "Open to Opportunities", "Not Actively Looking", "Available Immediately"]
SALARY_STEPS = [(0, 2), (3, 5), (6, 8), (9, 15)]
SALARY_BANDS = {
    "ai_ml": [(6, 14), (14, 26), (24, 40), (35, 60)],
    "backend": [(4, 12), (12, 22), (20, 35), (30, 55)],
    "frontend": [(4, 11), (10, 20), (18, 32), (28, 48)],
    "data_eng": [(5, 13), (13, 24), (22, 38), (32, 55)],
    "devops": [(5, 13), (13, 24), (22, 38), (30, 52)],
    "product": [(6, 14), (14, 28), (25, 42), (38, 65)],
    "security": [(5, 12), (12, 24), (22, 38), (32, 55)],
    "qa": [(3, 10), (10, 18), (16, 28), (24, 42)],
}
OTHER_SALARY = (15, 35)


@dataclass(frozen=True)
class Vocabulary:
    """Words the pool is made of; any list can be replaced."""

    first_names: list = field(default_factory=lambda: [
        "Asha", "Bruno", "Chen", "Dalia", "Emeka", "Farah", "Goran", "Hana",
        "Ivan", "Jaya", "Kofi", "Lena", "Mateo", "Noor", "Olga", "Pavel",
    ])
    last_names: list = field(default_factory=lambda: [
        "Adeyemi", "Bauer", "Castro", "Dutta", "Eriksen", "Farouk", "Green", "Haddad",
        "Ito", "Joshi", "Kowalski", "Lopez", "Moreau", "Novak", "Okafor", "Park",
    ])
    cities: list = field(default_factory=lambda: [
        "Bangalore", "Hyderabad", "Mumbai", "Delhi", "Pune", "Chennai", "Kolkata", "Kochi",
    ])
    companies: list = field(default_factory=lambda: [
        "Alder Systems", "Birch Labs", "Cedar Cloud", "Dogwood Data", "Elm Payments", "Fir Robotics",
    ])
    education: list = field(default_factory=lambda: [
        "B.Tech Computer Science", "B.Sc Mathematics", "M.Tech Software Engineering", "MBA", "PhD Statistics",
    ])
    # domain -> groups of skills, the core group first
    skills: dict = field(default_factory=lambda: {
        "ai_ml": [["Python", "PyTorch", "NLP", "Deep Learning"], ["LLM", "RAG", "LangChain"], ["Docker", "MLOps", "AWS"], ["SQL", "Statistics"]],
        "backend": [["Java", "Go", "Python", "C#"], ["Django", "Spring Boot", "FastAPI"], ["PostgreSQL", "Redis"], ["Kafka", "gRPC", "REST APIs"]],
        "frontend": [["JavaScript", "TypeScript", "HTML", "CSS"], ["React", "Angular", "Svelte"], ["Jest", "Vite"], ["Flutter", "Kotlin"]],
        "data_eng": [["SQL", "Python", "Airflow", "Spark"], ["Snowflake", "BigQuery"], ["Kafka", "Flink"], ["Terraform", "ETL"]],
        "devops": [["Docker", "Kubernetes", "Terraform", "Ansible"], ["AWS", "GCP", "Azure"], ["Prometheus", "Grafana"], ["Bash", "Go"]],
        "product": [["Roadmap Planning", "User Research", "A/B Testing"], ["Jira", "Figma"], ["Scrum", "OKRs"], ["API Design", "SQL"]],
        "security": [["SIEM", "Network Security", "Penetration Testing"], ["Wireshark", "Nessus"], ["ISO 27001", "GDPR"], ["IAM", "Zero Trust"]],
        "qa": [["Manual Testing", "API Testing", "Automation Testing"], ["Selenium", "Cypress"], ["Python", "Java"], ["TDD", "BDD"]],
    })
    roles: dict = field(default_factory=lambda: {
        "ai_ml": ["AI Engineer", "Senior AI Engineer", "Junior ML Engineer"],
        "backend": ["Backend Developer", "Senior Backend Engineer"],
        "frontend": ["Frontend Developer", "Senior Frontend Engineer"],
        "data_eng": ["Data Engineer", "Senior Data Engineer"],
        "devops": ["DevOps Engineer", "Senior DevOps Engineer"],
        "product": ["Product Manager", "Senior Product Manager"],
        "security": ["Security Analyst", "Senior Security Engineer"],
        "qa": ["QA Engineer", "Senior QA Engineer"],
    })
    topics: dict = field(default_factory=lambda: {
        "ai_ml": ["model deployment", "semantic search"], "backend": ["payment systems", "event-driven services"],
        "frontend": ["design systems", "accessibility"], "data_eng": ["streaming pipelines", "data quality"],
        "devops": ["observability", "container platforms"], "product": ["B2B products", "growth"],
        "security": ["cloud security", "incident response"], "qa": ["test automation", "load testing"],
    })
    achievements: list = field(default_factory=lambda: [
        "Led a team of {n}", "Cut costs by {pct}%", "Shipped {n} services", "Mentored {n} developers",
    ])
    outlooks: list = field(default_factory=lambda: [
        "Looking for a growing team", "Keen on remote-first work", "Enjoys hard problems",
    ])
    bios: list = field(default_factory=lambda: [
        "{role} with {exp} years of experience in {topic}. {achievement}. {outlook}.",
        "{exp}-year {role} focused on {topic}. {achievement}. {outlook}.",
    ])


def draw(seed: int, salt: str, key: Column | None = None) -> Column:
    """Uniform whole number in [0, 2^32) from the id, a salt and the seed."""
    text = F.concat_ws("|", key if key is not None else F.col("id").cast("string"), F.lit(salt), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _by_domain(table: dict, make) -> Column:
    out = None
    for name, value in table.items():
        hit = F.col("domain") == name
        out = F.when(hit, make(value)) if out is None else out.when(hit, make(value))
    return out


def _weighted(number: Column, weights: dict) -> Column:
    at = number % sum(weights.values())
    total, out = 0, None
    for value, weight in weights.items():
        total += weight
        out = F.when(at < total, F.lit(value)) if out is None else out.when(at < total, F.lit(value))
    return out


def generate_candidates(ids: DataFrame, seed: int = 0, words: Vocabulary | None = None) -> DataFrame:
    """One candidate per row of ``ids`` (column ``id``), all 17 fields, skills as comma text.

    Emails are unique because the id is part of them.
    """
    words = words or Vocabulary()

    def number(salt):
        return draw(seed, salt)

    def pick(salt, values):
        at = (number(salt) % F.size(values)).cast("int")
        return F.element_at(values, at + 1)

    def sample(salt, values, k):
        marked = F.transform(values, lambda v: F.struct(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(salt), v, F.lit(str(seed)))).alias("mark"), v.alias("skill")))
        return F.transform(F.slice(F.sort_array(marked), F.lit(1), k), lambda m: m.skill)

    years, domain = F.col("experience_years"), F.col("domain")
    base = (
        ids.select("id")
        .withColumn("domain", _weighted(number("domain"), DOMAIN_WEIGHTS))
        .withColumn("experience_years", _weighted(number("years"), EXPERIENCE_WEIGHTS).cast("int"))
        .withColumn("first", pick("first", _strings(words.first_names)))
        .withColumn("last", pick("last", _strings(words.last_names)))
        .withColumn("role", pick("role", _by_domain(words.roles, _strings)))
        .withColumn("groups", _by_domain(words.skills, lambda gs: F.array(*[_strings(g) for g in gs])))
    )
    role = (
        F.when(years <= 2, F.replace("role", F.lit("Senior "), F.lit("Junior ")))
        .when(years >= 7, F.replace("role", F.lit("Junior "), F.lit("Senior ")))
        .otherwise(F.col("role"))
    )
    longest = max(len(gs) for gs in words.skills.values())
    picked = []
    for g in range(longest):
        group = F.coalesce(F.get("groups", F.lit(g)), F.array().cast("array<string>"))
        if g == 0:
            k = number("core") % 3 + 2
        else:
            k = number(f"k{g}") % F.greatest(F.least(F.lit(3), F.size(group)), F.lit(1)) + 1
            k = k + F.when(years >= 5, F.lit(1)).otherwise(F.lit(0))
        picked.append(sample(f"g{g}", group, F.least(k, F.size(group)).cast("int")))
    none = F.array().cast("array<string>")

    def extra(condition, skill):
        return F.when(condition, F.array(F.lit(skill))).otherwise(none)

    picked += [
        extra(years >= 7, "System Design"),
        extra((years >= 7) & (number("leads") % 100 >= 50), "Team Leadership"),
        extra((years >= 5) & (number("agile") % 100 >= 40), "Agile"),
    ]
    kept = sample("keep", F.array_distinct(F.concat(*picked)), (number("kept") % 5 + 6).cast("int"))

    bands = [F.lit(OTHER_SALARY[0]), F.lit(OTHER_SALARY[1])]
    for at, (low, high) in enumerate(SALARY_STEPS):
        inside = years.between(low, high)
        for end in (0, 1):
            own = _by_domain(SALARY_BANDS, lambda b, at=at, end=end: F.lit(b[at][end]))
            bands[end] = F.when(inside, own).otherwise(bands[end])
    salary = (bands[0] + number("salary") % (bands[1] - bands[0] + 1)).cast("int")

    initial = F.lower(F.substring("last", 1, 1))
    achievement = F.replace(
        F.replace(pick("achievement", _strings(words.achievements)), F.lit("{n}"), (number("n") % 14 + 2).cast("string")),
        F.lit("{pct}"), (number("pct") % 51 + 30).cast("string"),
    )
    bio = pick("bio", _strings(words.bios))
    for slot, value in [
        ("{role}", F.col("current_role")), ("{exp}", years.cast("string")),
        ("{topic}", pick("topic", _by_domain(words.topics, _strings))), ("{achievement}", achievement),
        ("{outlook}", pick("outlook", _strings(words.outlooks))),
    ]:
        bio = F.replace(bio, F.lit(slot), value)
    identifier = F.col("id").cast("bigint")
    return (
        base.withColumn("current_role", role)
        .select(
            F.format_string("C%04d", identifier + 1).alias("id"),
            F.concat_ws(" ", "first", "last").alias("name"),
            F.concat(F.lower("first"), F.lit("."), initial, identifier.cast("string"), F.lit("@email.com")).alias("email"),
            F.concat_ws(
                " ", F.lit("+91"), (number("phone1") % 30000 + 70000).cast("string"),
                (number("phone2") % 90000 + 10000).cast("string"),
            ).alias("phone"),
            pick("city", _strings(words.cities)).alias("location"),
            "experience_years",
            "current_role",
            pick("company", _strings(words.companies)).alias("current_company"),
            F.array_join(kept, ", ").alias("skills"),
            pick("education", _strings(words.education)).alias("education"),
            salary.alias("salary_expectation_lpa"),
            pick("notice", F.array(*[F.lit(d) for d in NOTICE_DAYS])).alias("notice_period_days"),
            F.concat(F.lit("linkedin.com/in/"), F.lower("first"), F.lower("last")).alias("linkedin"),
            F.when(number("github") % 100 >= 30, F.concat(F.lit("github.com/"), F.lower("first"), initial))
            .otherwise(F.lit("")).alias("github"),
            bio.alias("bio"),
            pick("mode", _strings(WORK_MODES)).alias("preferred_work_mode"),
            pick("availability", _strings(AVAILABILITY)).alias("availability_status"),
            domain.alias("domain"),
        )
    )
