"""Candidates, jobs and transcripts derived from the TPC-H-like test tables.

Integer arithmetic only, so that any engine derives the same rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Part names that stand for a named skill; every other part name is its own skill.
SKILL_NAMES = {
    "blue anvil": "Python", "blue bolt": "python3", "blue gear": "React.js",
    "blue gizmo": "ReactJS", "blue plate": "LLM", "blue ring": "LangChain",
    "blue rod": "RAG", "blue widget": "Kubernetes", "cold anvil": "k8s",
    "cold gear": "SQL", "cold gizmo": "Docker", "cold plate": "AWS",
    "cold ring": "Java", "cold rod": "rest apis", "hot anvil": "RESTful",
    "hot gear": "NLP", "hot gizmo": "Machine Learning", "hot plate": "ML",
    "hot ring": "CI/CD", "hot rod": "Go",
}
TITLES = [
    "Senior AI Engineer", "Data Engineer", "DevOps Engineer", "Frontend Developer",
    "Backend Lead", "Full Stack Developer", "Product Manager", "QA Specialist",
    "Security Analyst", "Junior Software Developer",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skill_of_part(p_name):
    names = F.create_map(*[F.lit(x) for pair in SKILL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, p_name), p_name)


# Names of the most parts that travel as numbers and are held as bits of bigints; others travel and are held as text.
KNOWN, BITS = 248, 64


def _known_skills(spark, sf_dir):
    named = table(spark, sf_dir, "part").select(skill_of_part(F.col("p_name")).alias("skill")).filter("skill is not null")
    most = named.groupBy("skill").count().orderBy(F.desc("count"), "skill").limit(KNOWN).collect()
    return sorted(r.skill for r in most)


def _lineitem_skills(spark, sf_dir, known):
    """Line items with ``at``, the place of their skill in ``known``, and the skill as ``other`` if it has none."""
    skill = F.col("skill")
    names = F.array(*[F.lit(s) for s in known]).cast("array<string>")
    part = (
        table(spark, sf_dir, "part")
        .select("p_partkey", skill_of_part(F.col("p_name")).alias("skill"))
        .withColumn("at", F.nullif(F.array_position(names, skill), F.lit(0)).cast("int") - 1)
        .select("p_partkey", "at", F.when(F.col("at").isNull(), skill).alias("other"))
    )
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return items.join(part, items.l_partkey == part.p_partkey).select("l_orderkey", "l_suppkey", "at", "other")


def _sets_by_customer(held, known):
    """``o_custkey, skills``: bits of known names need no sorting and fixed space while they are gathered."""
    words = [known[i : i + BITS] for i in range(0, len(known), BITS)] or [[]]
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at") % BITS)
    sets = [
        F.coalesce(F.bit_or(F.when(F.floor(F.col("at") / BITS) == w, bit)), F.lit(0).cast("bigint")).alias(f"w{w}")
        for w in range(len(words))
    ]
    more = [F.collect_set("other").alias("others")] if len(known) == KNOWN else []

    def named(w, word):
        return F.filter(F.array(*[F.lit(s) for s in word]).cast("array<string>"), lambda s, i: F.getbit(f"w{w}", i) == 1)

    known_skills = [named(w, word) for w, word in enumerate(words)]
    skills = F.sort_array(F.concat(*known_skills, "others")) if more else F.concat(*known_skills)
    return held.groupBy("o_custkey").agg(*sets, *more).select("o_custkey", skills.alias("skills"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    known = _known_skills(spark, sf_dir)
    held = _lineitem_skills(spark, sf_dir, known)
    skills = _sets_by_customer(held.join(orders, held.l_orderkey == orders.o_orderkey), known)
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(skills, key == F.col("o_custkey"), "left")
        .select(
            key.cast("string").alias("candidate_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@email.com")).alias("email"),
            F.col("n_name").alias("location"),
            (key % 13).cast("int").alias("experience_years"),
            F.col("c_mktsegment").alias("current_role"),
            F.coalesce("skills", F.array().cast("array<string>")).alias("skills"),
            F.floor((F.col("c_acctbal") + 1000) / 200).cast("int").alias("salary_expectation_lpa"),
            ((key % 7) * 15).cast("int").alias("notice_period_days"),
            F.concat(F.lit("Customer in "), F.col("c_mktsegment")).alias("bio"),
            key.alias("pool_order"),
        )
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_count = W.partitionBy("l_suppkey").orderBy(F.desc("n"), "skill")
    known = _known_skills(spark, sf_dir)
    names = F.array(*[F.lit(s) for s in known]).cast("array<string>")
    ranked = (
        _lineitem_skills(spark, sf_dir, known)
        .groupBy("l_suppkey", "at", "other")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("l_suppkey", F.coalesce(F.get(names, F.col("at")), "other").alias("skill"), "n")
        .withColumn("place", F.row_number().over(by_count))
        .filter("place <= 8")
        .groupBy("l_suppkey")
        .agg(F.sort_array(F.collect_list(F.struct("place", "skill"))).alias("top"))
    )
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    key = F.col("s_suppkey").cast("int")
    low = key % 6
    top = F.coalesce("top", F.array().cast("array<struct<place:int,skill:string>>"))

    def places(first, last):
        return F.transform(
            F.filter(top, lambda t: t.place.between(first, last)), lambda t: t.skill
        )

    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(ranked, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .select(
            F.col("s_suppkey").cast("string").alias("job_id"),
            F.element_at(F.array(*[F.lit(t) for t in TITLES]), key % 10 + 1).alias("title"),
            F.when(key % 5 == 0, F.lit("Remote"))
            .when(key % 7 == 0, F.concat(F.col("n_name"), F.lit(" (Hybrid)")))
            .otherwise(F.col("n_name"))
            .alias("location"),
            places(1, 5).alias("required_skills"),
            places(6, 8).alias("nice_to_have"),
            F.struct(
                low.alias("min"),
                F.when(key % 11 != 0, low + 2 + key % 4).alias("max"),
                F.when(key % 17 == 0, low + 1).alias("exact"),
            ).alias("experience_years"),
            F.struct(
                (key % 10 + 5).alias("min"), (key % 10 + 10 + key % 15).alias("max")
            ).alias("salary_range_lpa"),
            F.array().cast("array<string>").alias("key_responsibilities"),
            F.lit("Any").alias("education_required"),
            F.lit(30).alias("notice_preference_days"),
            F.lit(None).cast("string").alias("raw_text"),
        )
    )


def jd_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the text of a job description, with ranges made from its id."""
    key = F.col("doc_id").cast("int")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("job_id"),
        F.col("text").alias("raw_text"),
        F.struct(
            (key % 4).alias("min"), F.when(key % 5 != 0, key % 4 + key % 3).alias("max")
        ).alias("experience_years"),
        F.struct((key % 20).alias("min"), (key % 20 + key % 6).alias("max")).alias("salary_range_lpa"),
        F.transform(
            F.filter(F.sequence(F.lit(0), key % 12), lambda i: i > 0),
            lambda i: F.concat(F.lit("skill "), i.cast("string")),
        ).alias("required_skills"),
    )


def recorded_talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts of the candidate of the same number, whatever the job."""
    return conversations(spark, sf_dir).drop("job_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns as recruiter and candidate turns; system turns are dropped."""
    return (
        table(spark, sf_dir, "conversations")
        .filter("role in ('user', 'assistant')")
        .select(
            F.lit("chat").alias("job_id"),
            F.col("conv_id").cast("string").alias("candidate_id"),
            F.col("turn").cast("int").alias("turn"),
            F.when(F.col("role") == "user", F.lit("candidate")).otherwise(F.lit("recruiter")).alias("speaker"),
            F.col("text").alias("message"),
            F.lit(None).cast("string").alias("intent"),
        )
    )
