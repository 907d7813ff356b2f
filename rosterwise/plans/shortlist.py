"""From jobs and a pool to ranked shortlists, reports and funnel."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bias, discovery, interest, jd, market, matching, ranking, report
from ..operators.pool_index import PoolIndex, build_index
from ..schemas import TRANSCRIPTS
from ..session import cut_lineage


@dataclass(frozen=True)
class Shortlist:
    jobs: DataFrame
    candidates: DataFrame
    discovered: DataFrame
    matches: DataFrame
    transcripts: DataFrame
    interest: DataFrame
    ranked: DataFrame

    def tier_counts(self) -> DataFrame:
        return ranking.tier_counts(self.ranked)

    def funnel(self) -> DataFrame:
        return ranking.funnel(self.jobs, self.candidates, self.discovered, self.matches, self.ranked)

    def flat(self) -> DataFrame:
        return report.flat_shortlist(self.ranked)

    def summary(self) -> DataFrame:
        return report.summary_rows(self.jobs, self.tier_counts())

    def turns(self) -> DataFrame:
        return report.report_turns(self.ranked, self.transcripts)

    def transcript_chunks(self) -> DataFrame:
        return report.transcript_chunks(self.ranked, self.transcripts)

    def _reported(self, talks: DataFrame | None) -> DataFrame:
        has_text = self.jobs.filter("raw_text is not null")
        return report.report_documents(
            self.jobs, self.ranked, self.tier_counts(), talks, bias.bias_report(has_text), market.market_intel(self.jobs)
        )

    def documents(self) -> DataFrame:
        return self._reported(self.transcripts)

    def document_parts(self) -> DataFrame:
        return report.document_parts(self._reported(None), self.ranked, self.transcripts)


def indexed(candidates: DataFrame | PoolIndex, top_k: int) -> PoolIndex:
    """The index of a pool for shortlists of ``top_k``; an index is taken as it is."""
    return candidates if isinstance(candidates, PoolIndex) else build_index(candidates, keep=3 * top_k)


def discover_and_match(
    jobs: DataFrame, candidates: DataFrame | PoolIndex, min_score: float = 45.0, top_k: int = 10, synonyms=None
) -> tuple[DataFrame, DataFrame]:
    """Coarse cut to 3 * top_k, then the deep match. Both results are written once."""
    index = indexed(candidates, top_k)
    long_enough = F.col("raw_text").isNull() | jd.reject_reason(F.col("raw_text")).isNull()
    usable = jobs.filter(jd.is_sufficient() & long_enough)
    found = cut_lineage(discovery.discover(usable, index, 3 * top_k))
    return found, cut_lineage(matching.best_matches(found, usable, index.people, min_score, top_k, synonyms))


def build_shortlist(
    jobs: DataFrame,
    candidates: DataFrame | PoolIndex,
    talks: DataFrame | None = None,
    min_score: float = 45.0,
    top_k: int = 10,
    match_weight: float = 0.6,
    interest_weight: float = 0.4,
    markers: interest.Markers | None = None,
    synonyms=None,
) -> Shortlist:
    """``talks`` are recorded transcripts, by job and candidate or by candidate alone; pairs without one, and all
    pairs if there are no ``talks``, get the default signals. A pool that serves several calls is best indexed once.
    """
    index = indexed(candidates, top_k)
    found, matches = discover_and_match(jobs, index, min_score, top_k, synonyms)
    if talks is None:
        talks = jobs.sparkSession.createDataFrame([], TRANSCRIPTS)
    signals = interest.score_interest(matches, talks, markers)
    ranked = cut_lineage(ranking.rank_candidates(matches, signals, match_weight, interest_weight))
    return Shortlist(jobs, index.people, found, matches, interest.for_each_job(ranked, talks), signals, ranked)
