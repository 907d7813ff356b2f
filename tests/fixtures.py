"""Small jobs and candidates for the tests."""

from pyspark.sql import types as T

from rosterwise.schemas import CANDIDATES, JOBS, TRANSCRIPTS


def job(job_id, required=(), nice=(), location="Pune", exp=(0, 10, None), pay=(0, 100), title="Engineer", text=None):
    return (
        job_id, title, location, None if required is None else list(required), exp,
        pay, [], None if nice is None else list(nice), "Any", 30, text,
    )


def person(order, skills=(), exp=3, location="Pune", salary=10, notice=30, name=None, cid=None):
    values = dict.fromkeys(CANDIDATES.names)
    values.update(
        candidate_id=cid or f"C{order}", name=name or f"Person {order}", location=location, experience_years=exp,
        current_role="Developer", skills=None if skills is None else list(skills),
        salary_expectation_lpa=salary, notice_period_days=notice, pool_order=order,
    )
    return tuple(values.values())


def _typed(value, kind):
    """``value`` with floats where ``kind`` has doubles."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_typed(v, f.dataType) for v, f in zip(value, kind.fields, strict=True))
    return float(value) if isinstance(kind, T.DoubleType) else value


def jobs_df(spark, rows):
    return spark.createDataFrame([_typed(r, JOBS) for r in rows], JOBS)


def pool_df(spark, rows):
    return spark.createDataFrame([_typed(r, CANDIDATES) for r in rows], CANDIDATES)


def turns_df(spark, rows):
    """Rows ``(job_id, candidate_id, turn, speaker, message)``."""
    return spark.createDataFrame([(*r, None) for r in rows], TRANSCRIPTS)


# The worked example: one job and one candidate with every score known by hand.
GOLD_JOB = job(
    "G", ["Python", "LLM", "LangChain"], ["MLOps"], "Bangalore (Hybrid)", (3, 6, None), (15, 25), "Senior AI Engineer"
)
GOLD_PERSON = person(
    0, ["Python", "Django", "FastAPI", "PostgreSQL", "Docker", "AWS", "LLM", "LangChain"], 5, "Bangalore", 18, 30,
    "Priya Sharma", "C001",
)
