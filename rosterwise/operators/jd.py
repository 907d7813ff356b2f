"""Job descriptions: decode a parsed reply, or read the fields from labelled text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lowered
from ..schemas import JD_REPLY

MIN_LENGTH = 50
#: Tasks that the texts holding one and the same word are dealt to.
SALT = 16


def reject_reason(raw_text: Column) -> Column:
    """Text when the description is too short, else null."""
    stripped = F.regexp_replace(F.coalesce(raw_text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(
        F.length(stripped) < MIN_LENGTH, F.lit("Job Description too short. Minimum 50 characters.")
    )


def is_sufficient() -> Column:
    skills = F.coalesce("required_skills", F.array().cast("array<string>"))
    return (F.coalesce("title", F.lit("")) != "") & (F.size(skills) > 0)


def json_span(reply: Column) -> Column:
    """From the first ``{`` to the last ``}``, or the whole text."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(reply)


def fallback_reply() -> Column:
    empty = F.array().cast("array<string>")
    return F.struct(
        F.lit("Unknown").alias("title"),
        F.lit("Any").alias("location"),
        empty.alias("required_skills"),
        F.struct(
            F.lit(0).alias("min"), F.lit(10).alias("max"), F.lit(None).cast("int").alias("exact")
        ).alias("experience_years"),
        F.struct(F.lit(0).alias("min"), F.lit(100).alias("max")).alias("salary_range_lpa"),
        empty.alias("key_responsibilities"),
        empty.alias("nice_to_have"),
        F.lit("Any").alias("education_required"),
        F.lit(60).alias("notice_preference_days"),
    ).cast(JD_REPLY)


def decode_replies(replies: DataFrame) -> DataFrame:
    """``job_id, reply, raw_text`` to jobs; a reply that is no JSON becomes the fallback job."""
    schema = T.StructType([*JD_REPLY.fields, T.StructField("broken", T.StringType())])
    parsed = F.from_json("span", schema, {"columnNameOfCorruptRecord": "broken"})
    rows = replies.withColumn("span", json_span(F.col("reply"))).withColumn("parsed", parsed)
    # The parser stops after the first value; as a list element, anything after it is an error.
    alone = F.json_array_length(F.concat(F.lit("["), "span", F.lit("]"))) == 1
    good = alone & F.col("parsed").isNotNull() & F.col("parsed.broken").isNull()
    fields = F.col("parsed").dropFields("broken")
    return (
        rows.withColumn("jd", F.when(good, fields).otherwise(fallback_reply()))
        .select("job_id", "jd.*", "raw_text")
        .withColumn("required_skills_lower", lowered(F.col("required_skills")))
        .withColumn("nice_to_have_lower", lowered(F.col("nice_to_have")))
    )


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("bigint")


def _bullets(text: Column, heading: str) -> Column:
    """Lines after ``heading:`` up to a blank line, without the dash."""
    block = F.regexp_extract(text, rf"(?is){heading}\s*:[ \t]*\r?\n(.*?)(?:\r?\n[ \t]*\r?\n|\z)", 1)
    lines = F.transform(F.split(block, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s*[-*•]\s*|\s+$", ""))
    return F.filter(lines, lambda x: x != "")


PIECES = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"


def _pieces(text: Column) -> Column:
    """Words (runs of letters and digits) and what lies between them, by turns; a gap, if empty, at either end."""
    found = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    starts, ends = text.rlike(r"^[\p{L}\p{N}]"), text.rlike(r"[\p{L}\p{N}]\z")
    blank, none = F.array(F.lit("")), F.array().cast("array<string>")
    return F.concat(F.when(starts, blank).otherwise(none), found, F.when(ends, blank).otherwise(none))


def phrase_index(vocabulary: DataFrame) -> DataFrame:
    """``skill`` as a phrase: ``core`` from its first to its last word, their number ``n``, and the gaps outside."""
    pieces = F.col("_pieces")
    rows = vocabulary.select("skill").distinct().withColumn("_pieces", _pieces(F.trim(F.lower("skill"))))
    return rows.filter(F.size(pieces) > 2).select(
        "skill", ((F.size(pieces) - 1) / 2).cast("int").alias("n"),
        F.array_join(F.slice(pieces, 2, F.size(pieces) - 2), "").alias("core"),
        F.get(pieces, F.lit(0)).alias("lead"), F.element_at(pieces, -1).alias("tail"),
    )


def phrase_cores(texts: DataFrame, keys, text: str, lengths: list[int]) -> DataFrame:
    """``keys`` and each distinct run (``core``) of as many words as one of ``lengths`` says, with what lies between them."""
    word, gap = r"[\p{L}\p{N}]++", r"[^\p{L}\p{N}]++"
    starts = r"(?<![\p{L}\p{N}])"
    low = F.lower(text)
    found = [F.regexp_extract_all(low, F.lit(f"{starts}(?=({word}(?:{gap}{word}){{{n - 1}}}))"), F.lit(1)) for n in lengths]
    return texts.select(*keys, F.explode(F.array_distinct(F.concat(*found))).alias("core"))


def phrase_runs(texts: DataFrame, keys, text: str, lengths: list[int]) -> DataFrame:
    """Every such run with the gaps ``before`` and ``after`` it, and whether it is the ``first`` or ``last`` of its length."""
    pieces = F.col("_pieces")
    rows = texts.select(*keys, _pieces(F.lower(text)).alias("_pieces"))
    words = ((F.size(pieces) - 1) / 2).cast("int")

    def runs(n):
        def run(i):
            return F.struct(
                F.concat(*[F.get(pieces, 2 * i + (1 + k)) for k in range(2 * n - 1)]).alias("core"),
                F.get(pieces, 2 * i).alias("before"), F.get(pieces, 2 * i + 2 * n).alias("after"),
                (i == 0).alias("first"), (i == words - n).alias("last"),
            )

        return F.when(words >= n, F.transform(F.sequence(F.lit(0), words - n), run))

    found = F.flatten(F.array_compact(F.array(*[runs(n) for n in lengths])))
    return rows.select(*keys, F.explode(found).alias("_run")).select(*keys, "_run.*")


def mentioned_skills(texts: DataFrame, keys, text: str, vocabulary: DataFrame) -> DataFrame:
    """``keys, skill``: vocabulary skills that occur in ``text`` as whole words.

    A skill is a phrase of words with gaps between them, and each run of as many words in a text is looked up
    as a whole, so what meets are occurrences. Only skills with signs outside their words ("C#") look at the gaps
    beside a run as well. Runs are salted, so a word of every text goes to SALT tasks, and the phrases go along
    SALT times; a small vocabulary is broadcast by Spark's own size check instead. Only the numbers of words that
    skills have come to the driver. Null and empty texts have no skills; skills without a letter or digit are not
    looked for.
    """
    phrases = phrase_index(vocabulary).withColumn("signed", F.concat("lead", "tail") != "")
    salted = phrases.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salt = F.pmod(F.xxhash64(*keys), F.lit(SALT)).cast("int")
    lengths = {False: [], True: []}
    for row in phrases.select("signed", "n").distinct().orderBy("n").collect():
        lengths[row.signed].append(row.n)
    lead, tail, before, after = (F.col(c) for c in ("lead", "tail", "before", "after"))
    # A phrase that takes a whole gap would end beside the next word.
    leads = (lead == "") | (F.endswith(before, lead) & (F.col("first") | (lead != before)))
    tails = (tail == "") | (F.startswith(after, tail) & (F.col("last") | (tail != after)))
    found = texts.select(*keys, F.lit("").alias("skill")).limit(0)
    if lengths[False]:
        cores = phrase_cores(texts, keys, text, lengths[False]).withColumn("salt", salt)
        found = found.union(cores.join(salted.filter(~F.col("signed")), ["core", "salt"]).select(*keys, "skill"))
    if lengths[True]:
        runs = phrase_runs(texts, keys, text, lengths[True]).withColumn("salt", salt)
        met = runs.join(salted.filter("signed"), ["core", "salt"]).filter(leads & tails)
        found = found.union(met.select(*keys, "skill"))
    return found.distinct()


def extract_jobs(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``job_id, raw_text`` to jobs, by labels ("Job Title:", "Requirements:", ...).

    Skills are the vocabulary terms found in the requirement and nice-to-have bullets.
    """
    raw = F.coalesce("raw_text", F.lit(""))

    def label(name):
        return F.nullif(F.trim(F.regexp_extract(raw, rf"(?im)^[ \t]*{name}\s*:[ \t]*(.+?)\s*$", 1)), F.lit(""))

    span = r"(\d+)\s*(?:-|–|to)\s*(\d+)"
    years = rf"(?i){span}\+?\s*(?:years|yrs)"
    pay = rf"(?i)salary(?: range)?\s*:[^\d\n]*{span}"
    rows = texts.select(
        "job_id",
        label("job title").alias("title"),
        F.coalesce(label("location"), F.lit("Any")).alias("location"),
        _bullets(raw, "requirements").alias("requirement_lines"),
        _bullets(raw, r"nice[ -]to[ -]have").alias("nice_lines"),
        F.struct(
            F.coalesce(_number(raw, years), _number(raw, r"(?i)(\d+)\+?\s*(?:years|yrs)")).alias("min"),
            _number(raw, years, 2).alias("max"),
            F.lit(None).cast("bigint").alias("exact"),
        ).alias("experience_years"),
        F.struct(_number(raw, pay).alias("min"), _number(raw, pay, 2).alias("max")).alias("salary_range_lpa"),
        _number(raw, r"(?i)notice(?: period)?\s*:[^\d\n]*(\d+)").alias("notice_preference_days"),
        "raw_text",
    )

    def found(lines, name):
        bullets = rows.select("job_id", F.array_join(lines, "\n").alias("bullets"))
        return (
            mentioned_skills(bullets, ["job_id"], "bullets", vocabulary)
            .groupBy("job_id")
            .agg(F.sort_array(F.collect_set("skill")).alias(name))
        )

    empty = F.array().cast("array<string>")
    return (
        rows.join(found("requirement_lines", "required"), "job_id", "left")
        .join(found("nice_lines", "nice"), "job_id", "left")
        .select(
            "job_id",
            "title",
            "location",
            F.coalesce("required", empty).alias("required_skills"),
            "experience_years",
            "salary_range_lpa",
            F.col("requirement_lines").alias("key_responsibilities"),
            F.array_except(F.coalesce("nice", empty), F.coalesce("required", empty)).alias("nice_to_have"),
            F.lit("Any").alias("education_required"),
            "notice_preference_days",
            "raw_text",
        )
    )
