"""Public table schemas."""

from pyspark.sql import types as T

_TEXT, _INT, _TEXTS = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())
#: Years, pay and days as they are given, with fractions and beyond 32 bits; any numeric type will do in their place.
_NUMBER = T.DoubleType()
#: The fields of candidates that hold such numbers.
NUMBERS = ["experience_years", "salary_expectation_lpa", "notice_period_days"]


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CANDIDATES = _struct(
    candidate_id=_TEXT, name=_TEXT, email=_TEXT, phone=_TEXT, location=_TEXT,
    experience_years=_NUMBER, current_role=_TEXT, current_company=_TEXT, skills=_TEXTS,
    education=_TEXT, salary_expectation_lpa=_NUMBER, notice_period_days=_NUMBER, linkedin=_TEXT,
    github=_TEXT, bio=_TEXT, preferred_work_mode=_TEXT, availability_status=_TEXT,
    pool_order=T.LongType(),
)

# The struct a parsed job description decodes to.
JD_REPLY = _struct(
    title=_TEXT, location=_TEXT, required_skills=_TEXTS,
    experience_years=_struct(min=_NUMBER, max=_NUMBER, exact=_NUMBER),
    salary_range_lpa=_struct(min=_NUMBER, max=_NUMBER), key_responsibilities=_TEXTS,
    nice_to_have=_TEXTS, education_required=_TEXT, notice_preference_days=_NUMBER,
)

JOBS = T.StructType(
    [T.StructField("job_id", _TEXT), *JD_REPLY.fields, T.StructField("raw_text", _TEXT)]
)

TRANSCRIPTS = _struct(
    job_id=_TEXT, candidate_id=_TEXT, turn=_INT, speaker=_TEXT, message=_TEXT, intent=_TEXT
)
