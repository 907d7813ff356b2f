"""Flat shortlist, nested report document, label/value summary."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flat_shortlist(ranked: DataFrame) -> DataFrame:
    """``job_id`` and the 15 columns of the spreadsheet export."""

    def head(column, n):
        return F.array_join(F.slice(column, 1, n), ", ")

    skills, factors = F.col("skill_breakdown"), F.col("factor_breakdown")
    return ranked.select(
        "job_id",
        F.col("rank").alias("Rank"),
        F.col("candidate_name").alias("Name"),
        F.col("combined_score").alias("Combined Score"),
        F.col("match_score").alias("Match Score"),
        F.col("interest_score").alias("Interest Score"),
        F.col("recommendation").alias("Recommendation"),
        head(skills["matched_skills"], 8).alias("Matched Skills"),
        head(skills["missing_skills"], 5).alias("Missing Skills"),
        factors["skills"]["label"].alias("Skills Score"),
        factors["experience"]["label"].alias("Experience Score"),
        factors["salary"]["label"].alias("Salary Score"),
        factors["location"]["label"].alias("Location Score"),
        F.col("availability_timeline").alias("Availability"),
        head("enthusiasm_signals", 3).alias("Enthusiasm Signals"),
        head("concerns", 2).alias("Concerns"),
    )


# Turns of a chunk. A nested document holds the first chunk of a transcript and says how many turns there
# are; the parts of a document hold all of them.
CHUNK_TURNS = 1_000


def report_turns(ranked: DataFrame, transcripts: DataFrame) -> DataFrame:
    """All turns of the ranked pairs as rows, with the rank."""
    keys = ["job_id", "candidate_id"]
    turns = transcripts.select(*keys, "turn", "speaker", "message", "intent")
    return turns.join(ranked.select(*keys, "rank"), keys)


def transcript_chunks(ranked: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Every turn of the ranked pairs, CHUNK_TURNS per row: ``chunk`` from 0, ``turns`` in order.

    Turns are numbered within slices of turn numbers, plus the turns of earlier slices, so a long
    conversation is spread over tasks; turns without a number come first.
    """
    keys = ["job_id", "candidate_id"]
    turn = F.struct("turn", "speaker", "message", "intent")
    number = F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-(1 << 62)))
    turns = report_turns(ranked, transcripts).withColumn("_slice", number)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = turns.groupBy(*keys, "_slice").count().select(
        *keys, "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("turn", "speaker", "message")) - 1
    placed = turns.withColumn("_inside", inside).join(offsets, [*keys, "_slice"])
    chunk = F.floor((F.col("_inside") + F.col("_before")) / CHUNK_TURNS).cast("int")
    return placed.withColumn("chunk", chunk).groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def document_parts(documents: DataFrame, ranked: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Whole documents in bounded rows: ``job_id, rank, chunk, candidate_id, head, turns``.

    Of each job first (rank 0, chunk 0) the document without transcripts as JSON in ``head``; then for each ranked
    candidate the chunks of the transcript in order. (rank, chunk) number the parts, so no task has to see a
    document to number it. ``documents`` come from ``report_documents`` without transcripts.
    """
    chunks = transcript_chunks(ranked, transcripts)
    ranks = ranked.select("job_id", "candidate_id", "rank")
    said = chunks.join(ranks, ["job_id", "candidate_id"]).select(
        "job_id", F.col("rank").cast("int").alias("rank"), "chunk", "candidate_id", F.lit(None).cast("string").alias("head"), "turns"
    )
    zero = F.lit(0)
    heads = documents.select(
        "job_id", zero.alias("rank"), zero.alias("chunk"), F.lit(None).cast("string").alias("candidate_id"),
        F.to_json(F.struct(*documents.columns)).alias("head"), F.lit(None).cast(said.schema["turns"].dataType).alias("turns"),
    )
    return heads.unionByName(said)


def part_counts(parts: DataFrame) -> DataFrame:
    """``job_id, rank, parts, turns``: what a reader has to find of each document head and transcript."""
    return parts.groupBy("job_id", "rank").agg(
        F.count(F.lit(1)).alias("parts"), F.sum(F.coalesce(F.array_size("turns"), F.lit(0))).cast("long").alias("turns")
    )


def whole_documents(parts: DataFrame) -> DataFrame:
    """``job_id, head, transcripts``: parts put together, transcripts as structs of rank, candidate_id and turns.

    A row holds a whole document: for jobs whose transcripts fit one; others are read part by part.
    """
    pieces = F.array_sort(F.collect_list(F.struct("chunk", "turns")))
    one = parts.filter("rank > 0").groupBy("job_id", "rank", "candidate_id").agg(
        F.flatten(F.transform(pieces, lambda p: p["turns"])).alias("turns")
    )
    said = one.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "turns"))).alias("transcripts"))
    return parts.filter("rank = 0").select("job_id", "head").join(said, "job_id", "left")


def _nested_turns(ranked: DataFrame, transcripts: DataFrame) -> DataFrame:
    """First chunk per pair, and the number of all turns."""
    keys = ["job_id", "candidate_id"]
    chunks = transcript_chunks(ranked, transcripts)
    counts = chunks.groupBy(*keys).agg(F.sum(F.size("turns")).alias("conversation_turns"))
    first = chunks.filter("chunk = 0").select(*keys, F.col("turns").alias("conversation_transcript"))
    return first.join(counts, keys)


def report_documents(
    jobs: DataFrame, ranked: DataFrame, summary: DataFrame, transcripts=None, bias=None, market=None
) -> DataFrame:
    """One nested document per job with a shortlist; ``summary`` comes from ``tier_counts``.

    For whole documents whatever the length of their transcripts see ``document_parts``.

    A transcript of more than CHUNK_TURNS turns goes on in ``transcript_chunks``; its
    ``conversation_turns`` says so.

    Candidates are at most ``top_k`` per job. The time stamp is when the query runs.
    """
    keys = ["job_id", "candidate_id"]
    factors = F.col("factor_breakdown")
    rows = ranked.withColumn(
        "factor_breakdown",
        F.struct(*[factors[k].dropFields("label").alias(k) for k in ("skills", "experience", "salary", "location")]),
    )
    fields = [
        "rank", "candidate_id", "candidate_name", "match_score", "interest_score", "combined_score",
        "match_explanation", "interest_explanation", "availability_timeline", "concerns",
        "enthusiasm_signals", "skill_breakdown", "factor_breakdown", "conversation_preview",
        "recommendation",
    ]
    if transcripts is not None:
        rows = rows.join(_nested_turns(ranked, transcripts), keys, "left")
        fields += ["conversation_transcript", "conversation_turns"]
    people = rows.groupBy("job_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("candidates")
    )
    counts = summary.select(
        "job_id",
        "total_candidates_considered",
        F.struct(
            "priority_hires", "fast_track", "recommended", "average_match_score", "average_interest_score"
        ).alias("summary"),
    )
    head = jobs.select(
        "job_id",
        F.coalesce("title", F.lit("Unknown")).alias("job_title"),
        F.coalesce("location", F.lit("Any")).alias("job_location"),
    )
    out = head.join(counts, "job_id").join(people, "job_id")
    for name, part in (("bias_analysis", bias), ("market_intelligence", market)):
        if part is not None:
            columns = [c for c in part.columns if c != "job_id"]
            out = out.join(part.select("job_id", F.struct(*columns).alias(name)), "job_id", "left")
    return out.withColumn(
        "report_generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def summary_rows(jobs: DataFrame, summary: DataFrame) -> DataFrame:
    """Label/value pairs per job, in ``position`` order."""
    values = [
        ("Job Title", F.coalesce("title", F.lit("N/A"))),
        ("Job Location", F.coalesce("location", F.lit("N/A"))),
        ("Total Candidates Evaluated", F.col("total_candidates_considered")),
        ("Priority Hires", F.col("priority_hires")),
        ("Fast-Track", F.col("fast_track")),
        ("Recommended", F.col("recommended")),
        ("Average Match Score", F.col("average_match_score")),
        ("Average Interest Score", F.col("average_interest_score")),
        ("Report Generated", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm")),
    ]
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), value.cast("string").alias("value"))
            for i, (label, value) in enumerate(values, 1)
        ]
    )
    return jobs.join(summary, "job_id").select("job_id", F.inline(pairs))
