"""Interest score of a transcript: enthusiasm 40, engagement 30, commitment 30.

A transcript is never gathered whole. Turns are folded into chunks of TURNS_PER_CHUNK turn
numbers; a chunk keeps counts, one bit per marker found in its text, and the first and last
few characters. A marker may also span messages of two or more chunks, so each chunk adds
the markers found in the text around its start, which needs those characters only. Bits and
counts of the chunks then combine with partial aggregation. So the text of a transcript that
holds a third of all turns is spread over many tasks.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.numbers import clamp_text
from ..functions.text import bind, lowered
from ..session import cut_lineage

TURNS_PER_CHUNK = 1024
BITS = 62


@dataclass(frozen=True)
class Markers:
    enthusiasm_positive: list = field(default_factory=lambda: list(K.ENTHUSIASM_POSITIVE))
    enthusiasm_negative: list = field(default_factory=lambda: list(K.ENTHUSIASM_NEGATIVE))
    engagement: list = field(default_factory=lambda: list(K.ENGAGEMENT_MARKERS))
    commitment_positive: list = field(default_factory=lambda: list(K.COMMITMENT_POSITIVE))
    commitment_negative: list = field(default_factory=lambda: list(K.COMMITMENT_NEGATIVE))

    def all(self) -> list[str]:
        return [t for terms in vars(self).values() for t in terms]


def _words(terms) -> list[list[str]]:
    return [terms[i : i + BITS] for i in range(0, len(terms), BITS)]


def _bits(text: Column, word: list[str]) -> Column:
    """Bigint with bit i set if ``text`` contains the i-th term."""
    cells = F.array(
        *[F.struct(F.lit(t).alias("term"), F.lit(1 << i).cast("bigint").alias("bit")) for i, t in enumerate(word)]
    )
    zero = F.lit(0).cast("bigint")

    def scan(bound):
        return F.aggregate(
            cells, zero, lambda m, c: F.when(F.contains(bound, c.term), m.bitwiseOR(c.bit)).otherwise(m)
        )

    return bind(text, scan)


def _named(bits: Column, word: list[str]) -> Column:
    """The terms whose bits are set."""
    return F.filter(F.array(*[F.lit(t) for t in word]), lambda t, i: F.getbit(bits, i) == 1)


def transcript_signals(transcripts: DataFrame, keys, markers=None, skills=None) -> DataFrame:
    """Per transcript: messages, characters and questions of the candidate, and ``found``.

    ``found`` holds the markers in the candidate's text, messages joined by a blank in turn
    order. With ``skills`` (a lower-cased array column of ``transcripts``), ``mentioned``
    holds those that occur within a single candidate message.
    """
    keys = list(keys)
    terms = list(dict.fromkeys((markers or Markers()).all()))
    words = _words(terms)
    reach = max([len(t) for t in terms], default=1)

    said = F.col("speaker") == "candidate"
    message = F.coalesce("message", F.lit(""))
    chunk = F.when(said, F.floor(F.col("turn") / TURNS_PER_CHUNK))
    own = [F.first(skills).alias("own_skills")] if skills else []
    chunks = (
        transcripts.withColumn("chunk", chunk)
        .groupBy(*keys, "chunk")
        .agg(
            F.sort_array(F.collect_list(F.when(said, F.struct("turn", message.alias("message"))))).alias("turns"),
            F.count_if(said).alias("n"),
            F.coalesce(F.sum(F.when(said, F.length(message))), F.lit(0)).alias("chars"),
            F.coalesce(
                F.sum(F.when(said, F.length(message) - F.length(F.replace(message, F.lit("?"), F.lit(""))))),
                F.lit(0),
            ).alias("questions"),
            *own,
        )
        .withColumn("messages", F.transform("turns", lambda t: F.lower(t.message)))
        .withColumn("text", F.when(F.col("n") > 0, F.array_join("messages", " ")))
    )
    spoken = F.col("n") > 0
    slim = [F.col(c) for c in (*keys, "chunk", "n", "chars", "questions")] + [
        F.left("text", F.lit(reach)).alias("head"),
        F.when(spoken, F.right("text", F.lit(reach))).alias("tail"),
        *[_bits(F.coalesce("text", F.lit("")), word).alias(f"inside{w}") for w, word in enumerate(words)],
    ]
    if skills:
        said_skills = F.filter(
            F.array_distinct("own_skills"),
            lambda s: F.exists("messages", lambda m: F.contains(m, s)),
        )
        slim.append(F.coalesce(said_skills, F.array().cast("array<string>")).alias("heard"))
    chunks = chunks.select(*slim)

    before = W.partitionBy(*keys).orderBy("chunk").rowsBetween(-(reach + 1), -1)
    lead = F.right(F.array_join("lead", " "), F.lit(reach))
    joint = F.when(F.size("lead") > 0, F.concat(lead, F.lit(" "), "head"))
    chunks = chunks.withColumn("lead", F.collect_list("tail").over(before)).withColumn("joint", joint)
    for w, word in enumerate(words):
        across = _bits(F.coalesce("joint", F.lit("")), word)
        chunks = chunks.withColumn(f"bits{w}", F.col(f"inside{w}").bitwiseOR(across))

    # One row of counts and bits per chunk, and one row per skill mentioned in it.
    numbers = ["n", "chars", "questions", *[f"bits{w}" for w in range(len(words))]]
    if skills:
        rows = F.concat(F.array(F.lit(None).cast("string")), "heard")
        chunks = chunks.select(*keys, *numbers, F.posexplode(rows).alias("at", "skill"))
        first = F.col("at") == 0
        numbers_of = {c: F.when(first, F.col(c)) for c in numbers}
        mentioned = [F.collect_set("skill").alias("mentioned")]
    else:
        numbers_of = {c: F.col(c) for c in numbers}
        mentioned = []
    out = chunks.groupBy(*keys).agg(
        *[F.sum(numbers_of[c]).alias(c) for c in numbers[:3]],
        *[F.bit_or(numbers_of[c]).alias(c) for c in numbers[3:]],
        *mentioned,
    )
    found = [_named(F.col(f"bits{w}"), word) for w, word in enumerate(words)]
    found = F.concat(F.array().cast("array<string>"), *found)
    return out.withColumn("found", found).drop(*numbers[3:])


def _among(terms) -> Column:
    """The listed terms that were found, in list order."""
    if not terms:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.array_contains("found", t))


def _tagged(terms: Column, prefix: str, suffix: str = "'") -> Column:
    return F.transform(terms, lambda t: F.concat(F.lit(prefix), t, F.lit(suffix)))


def _clamp(x: Column, high: int) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(high)), x))


def availability(commitment: Column) -> Column:
    return (
        F.when(commitment >= 22, F.lit("High commitment — likely to join if offer matches"))
        .when(commitment >= 15, F.lit("Moderate commitment — needs convincing on role fit"))
        .when(commitment >= 8, F.lit("Low commitment — exploring options passively"))
        .otherwise(F.lit("Very low commitment — unlikely to move"))
    )


def for_each_job(matches: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``transcripts`` by job and candidate; those without a ``job_id`` count for every job of their candidate."""
    if "job_id" in transcripts.columns:
        return transcripts
    return matches.select("job_id", "candidate_id").join(transcripts, "candidate_id")


def score_interest(matches: DataFrame, transcripts: DataFrame, markers=None) -> DataFrame:
    """Interest of every matched pair; a pair without a transcript gets the default signals.

    Nothing that is read from a talk depends on the job, so talks without a ``job_id`` are folded once per
    candidate, however many jobs the candidate matches, and the signals are joined to the pairs.
    """
    m = markers or Markers()
    keys = ["job_id", "candidate_id"]
    person = F.col("raw_candidate")
    pairs = matches.select(
        *keys,
        "candidate_name",
        lowered(person["skills"]).alias("skills"),
        F.coalesce(person["notice_period_days"], F.lit(60)).alias("notice"),
    )
    # People are told apart by id and skills: the skills are looked for in what was said.
    talked_by = [*[k for k in keys if k in transcripts.columns], "skills"]
    people = pairs.select(*talked_by).distinct()
    turns = transcripts.select(*talked_by[:-1], "turn", "speaker", "message").join(people, talked_by[:-1])
    # Written by themselves: the plan of the scores stays small.
    signals = cut_lineage(transcript_signals(turns.withColumn("own", F.col("skills")), talked_by, m, "own"))
    rows = pairs.join(signals, talked_by, "left")

    none = F.array().cast("array<string>")
    average = F.col("chars") / F.greatest(F.col("n"), F.lit(1))
    keen, wary = _among(m.enthusiasm_positive), _among(m.enthusiasm_negative)
    curious = _among(m.engagement)
    ready, bound = _among(m.commitment_positive), _among(m.commitment_negative)
    skills_said = F.filter("skills", lambda s: F.array_contains("mentioned", s))
    notice, questions = F.col("notice"), F.col("questions")

    enthusiasm = _clamp(20.0 + F.size(keen) * 4 - F.size(wary) * 6 + F.size(skills_said) * 2, 40)
    length_points = F.when(average > 80, F.lit(3)).when(average < 30, F.lit(-5)).otherwise(F.lit(0))
    engagement = _clamp(10.0 + questions * 5 + F.size(curious) * 3 + length_points, 30)
    notice_points = F.when(notice <= 30, F.lit(5)).when(notice >= 90, F.lit(-3)).otherwise(F.lit(0))
    commitment = _clamp(15.0 + F.size(ready) * 5 - F.size(bound) * 8 + notice_points, 30)

    def only_if(condition, text):
        return F.when(condition, F.array(text)).otherwise(none)

    positive = F.concat(
        _tagged(keen, "Enthusiasm marker: '"),
        F.transform(skills_said, lambda s: F.concat(F.lit("Self-identified skill fit: "), s)),
        only_if(
            questions >= 2,
            F.concat(F.lit("Asked "), questions.cast("string"), F.lit(" questions (high engagement)")),
        ),
        _tagged(curious, "Engagement marker: '"),
        only_if(average > 80, F.lit("Detailed responses (high engagement)")),
        _tagged(ready, "Commitment signal: '"),
        only_if(notice <= 30, F.lit("Short notice period (highly available)")),
    )
    negative = F.concat(
        _tagged(wary, "Hesitation marker: '"),
        only_if(average < 30, F.lit("Very short responses (low engagement)")),
        _tagged(bound, "Commitment blocker: '"),
        only_if(notice >= 90, F.lit("Long notice period (3+ months)")),
    )
    talked = F.col("n").isNotNull()

    def either(value, default):
        return F.when(talked, value).otherwise(default)

    return (
        rows.select(
            *keys,
            "candidate_name",
            either(enthusiasm, F.lit(20.0)).alias("enthusiasm_score"),
            either(engagement, F.lit(10.0)).alias("engagement_score"),
            either(commitment, F.lit(15.0)).alias("commitment_score"),
            either(F.sort_array(F.array_distinct(positive)), none).alias("positive_signals"),
            either(
                F.sort_array(F.array_distinct(negative)),
                F.array(F.lit("Conversation simulation failed")),
            ).alias("negative_signals"),
            F.coalesce("questions", F.lit(0)).alias("questions_asked"),
            either(
                availability(commitment),
                F.lit("Unknown — conversation could not be completed"),
            ).alias("availability_commitment"),
            talked.alias("conversation_completed"),
        )
        .withColumn(
            "total_interest_score",
            F.col("enthusiasm_score") + F.col("engagement_score") + F.col("commitment_score"),
        )
        .withColumn(
            "conversation_preview",
            F.concat(
                F.lit("Enthusiasm: "), clamp_text(F.col("enthusiasm_score"), 0, 40),
                F.lit("/40 | Engagement: "), clamp_text(F.col("engagement_score"), 0, 30),
                F.lit("/30 | Commitment: "), clamp_text(F.col("commitment_score"), 0, 30),
                F.lit("/30"),
            ),
        )
    )
