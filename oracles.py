"""DuckDB SQL for the queries of ``__spark_entry__``, written relationally on its own."""

from difflib import SequenceMatcher
from functools import lru_cache
from itertools import product

from rosterwise.functions import constants as K
from rosterwise.operators import generate as G
from rosterwise.operators.bias import bias_lexicon
from rosterwise.plans.driver_views import SKILL_NAMES, TITLES

HIGH_BAR = 82.0
SEED = 7
#: Words with single blanks between them, as many as there are.
PHRASE = r"[\p{L}\p{N}]+(?: [\p{L}\p{N}]+)*"
OWN_GENDERED = {"the ": "a", "and ": "plus", "his ": "their"}
OWN_AGE = ["of", "tion", "in the", "que"]
OWN_MARKERS = ["the ", "and", "of the", "tion. ", ". an", "in in", "que la", "é e", "on on", "absent term"]


def q(text) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(str(c) if isinstance(c, (int, float)) else q(c) for c in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def r1(x: str) -> str:
    """One decimal, exact binary value, ties to even (what Python's round does)."""
    hi = f"(floor({x}*1048576::DOUBLE)/1048576::DOUBLE)"
    lo = f"({x}-{hi})"
    n = f"floor({hi}*10::DOUBLE+{lo}*10::DOUBLE)"
    d = f"(({hi}*10::DOUBLE-{n}-0.5::DOUBLE)+{lo}*10::DOUBLE)"
    return f"(({n}+CASE WHEN {d}>0 THEN 1 WHEN {d}<0 THEN 0 ELSE {n}%2 END)/10::DOUBLE)"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# --- jobs and candidates -----------------------------------------------------------------
HELD = [
    values("skill_names", "p_name, skill", SKILL_NAMES.items()),
    """held AS (SELECT l_orderkey, l_suppkey, coalesce(s.skill, p.p_name) AS skill
    FROM lineitem JOIN part p ON l_partkey = p_partkey LEFT JOIN skill_names s ON s.p_name = p.p_name)""",
]
CANDIDATES = HELD + [
    """cand_skill AS (SELECT DISTINCT o_custkey AS cid, skill, lower(skill) AS low
    FROM held JOIN orders ON l_orderkey = o_orderkey)""",
    """candidates AS (SELECT c_custkey AS cid, c_name AS name, n_name AS location,
    CAST(c_custkey % 13 AS INT) AS exp, c_mktsegment AS role,
    CAST(floor((c_acctbal + 1000) / 200) AS INT) AS salary, CAST((c_custkey % 7) * 15 AS INT) AS notice
    FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
]
JOBS = CANDIDATES + [
    """job_skill AS (SELECT * FROM (SELECT l_suppkey AS sid, skill, lower(skill) AS low,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, skill) AS place
    FROM (SELECT l_suppkey, skill, count(*) AS n FROM held GROUP BY ALL)) WHERE place <= 8)""",
    """jobs AS (SELECT s_suppkey AS sid, CASE s_suppkey % 10 """
    + " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(TITLES))
    + """ END AS title,
    CASE WHEN s_suppkey % 5 = 0 THEN 'Remote' WHEN s_suppkey % 7 = 0 THEN n_name || ' (Hybrid)' ELSE n_name END AS location,
    CAST(s_suppkey % 6 AS INT) AS exp_min,
    CASE WHEN s_suppkey % 11 <> 0 THEN CAST(s_suppkey % 6 + 2 + s_suppkey % 4 AS INT) END AS exp_max,
    CASE WHEN s_suppkey % 17 = 0 THEN CAST(s_suppkey % 6 + 1 AS INT) END AS exp_exact,
    CAST(s_suppkey % 10 + 5 AS INT) AS sal_min, CAST(s_suppkey % 10 + 10 + s_suppkey % 15 AS INT) AS sal_max,
    (SELECT count(*) FROM job_skill k WHERE k.sid = s_suppkey AND place <= 5) AS n_req,
    (SELECT count(*) FROM job_skill k WHERE k.sid = s_suppkey AND place > 5) AS n_nice
    FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
]


def discovered(keep: int, jobs: str = "jobs") -> list[str]:
    return JOBS + [
        """hits AS (SELECT sid, cid, count(*) FILTER (place <= 5) AS r, count(*) FILTER (place > 5) AS n
    FROM job_skill JOIN cand_skill USING (low) GROUP BY sid, cid)""",
        f"""pairs AS (SELECT j.*, c.cid, c.name, c.location AS c_location, c.exp, c.role, c.salary, c.notice,
    coalesce(r, 0) AS r, coalesce(n, 0) AS n, coalesce(nullif(exp_max, 0), 10) AS emax,
    (lower(j.location) LIKE '%remote%' OR lower(j.location) LIKE '%any%') AS anywhere,
    (contains(lower(j.location), lower(c.location)) OR contains(lower(c.location), lower(j.location))) AS near
    FROM {jobs} j CROSS JOIN candidates c LEFT JOIN hits h ON h.sid = j.sid AND h.cid = c.cid)""",
        """points AS (SELECT *,
    0::DOUBLE + CASE WHEN n_req > 0 THEN r::DOUBLE / n_req * 50::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN n_nice > 0 THEN n::DOUBLE / n_nice * 15::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN exp BETWEEN exp_min AND emax THEN 20::DOUBLE WHEN exp >= exp_min * 0.7::DOUBLE THEN 10::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN anywhere OR near THEN 15::DOUBLE ELSE 5::DOUBLE END AS raw FROM pairs)""",
        f"scored AS (SELECT *, {r1('raw')} AS discovery_score FROM points WHERE raw >= 25)",
        f"""discovered AS (SELECT * FROM (SELECT *,
    row_number() OVER (PARTITION BY sid ORDER BY discovery_score DESC, cid) AS discovery_rank FROM scored)
    WHERE discovery_rank <= {keep})""",
    ]


def _discovery(keep):
    return with_(
        *discovered(keep),
        select="""SELECT sid::VARCHAR AS job_id, cid::VARCHAR AS candidate_id, discovery_rank, discovery_score,
    coalesce(nullif(concat_ws('; ', CASE WHEN r >= 2 THEN r || ' required skills match' END,
      CASE WHEN n >= 1 THEN n || ' nice-to-have skills' END,
      CASE WHEN exp BETWEEN exp_min AND emax THEN 'Experience in range'
           WHEN exp >= exp_min * 0.7::DOUBLE THEN 'Experience close to range' END,
      CASE WHEN near AND NOT anywhere THEN 'Location match' END), ''), 'Partial skill match') AS discovery_reason
    FROM discovered""",
    )


# --- skills -----------------------------------------------------------------------------
GROUPS = values("grp", "head, member", [(k, m) for k, ms in K.SYNONYMS.items() for m in [k, *ms]])
EXPAND = "expand AS (SELECT DISTINCT a.member AS term, b.member AS other FROM grp a JOIN grp b USING (head))"


@lru_cache
def fuzzy_rows():
    """All pairs at 0.85 or more among the names that can occur, by the standard library."""
    parts = [f"{a} {b}" for a, b in product(
        ["blue", "cold", "hot", "large", "new", "old", "red", "small"],
        ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"],
    )]
    names = {SKILL_NAMES.get(p, p).lower() for p in parts}
    names |= {m for k, ms in K.SYNONYMS.items() for m in [k, *ms]}
    rows = []
    for a, b in product(sorted(names), repeat=2):
        if a != b:
            ratio = SequenceMatcher(None, a, b).ratio()
            if ratio >= 0.85:
                rows.append((a, b, ratio))
    return rows


def overlap(keep: int, jobs: str = "jobs") -> list[str]:
    fuzzy = ", ".join(f"({q(a)}, {q(b)}, {r!r}::DOUBLE)" for a, b, r in fuzzy_rows())
    return discovered(keep, jobs) + [
        GROUPS,
        EXPAND,
        f"fuzzy(js, cs, ratio) AS (VALUES {fuzzy})",
        """jd_term AS (SELECT DISTINCT sid, unnest([low, other]) AS term FROM job_skill LEFT JOIN expand ON term = low)""",
        """cd_term AS (SELECT DISTINCT cid, unnest([low, other]) AS term FROM cand_skill LEFT JOIN expand ON term = low)""",
        """direct AS (SELECT sid, cid, d.term FROM discovered p JOIN jd_term d USING (sid) JOIN cd_term c USING (cid)
    WHERE d.term = c.term)""",
        """jd_rest AS (SELECT sid, cid, term FROM discovered JOIN jd_term USING (sid) WHERE term IS NOT NULL
    EXCEPT SELECT sid, cid, term FROM direct)""",
        """cd_rest AS (SELECT sid, cid, term FROM discovered JOIN cd_term USING (cid) WHERE term IS NOT NULL
    EXCEPT SELECT sid, cid, term FROM direct)""",
        """alike AS (SELECT sid, cid, js, cs FROM jd_rest j JOIN fuzzy ON js = j.term
    JOIN cd_rest c USING (sid, cid) WHERE c.term = cs)""",
        "total AS (SELECT sid, count(term) AS n_terms FROM jd_term GROUP BY sid)",
        "d_text AS (SELECT sid, cid, count(*) AS n_direct, string_agg(term, ', ' ORDER BY term) AS direct_text FROM direct GROUP BY sid, cid)",
        "f_text AS (SELECT sid, cid, count(*) AS n_fuzzy, string_agg(js || '≈' || cs, ', ' ORDER BY js, cs) AS fuzzy_text FROM alike GROUP BY sid, cid)",
        """m_text AS (SELECT sid, cid, count(*) AS n_miss, string_agg(term, ', ' ORDER BY term) AS miss_text FROM
    (SELECT sid, cid, term FROM jd_rest EXCEPT SELECT sid, cid, js FROM alike) GROUP BY sid, cid)""",
        """overlap AS (SELECT p.*, coalesce(n_terms, 0) AS n_terms, coalesce(n_direct, 0) AS n_direct,
    coalesce(n_fuzzy, 0) AS n_fuzzy, coalesce(n_miss, 0) AS n_miss, coalesce(direct_text, '') AS direct_text,
    coalesce(fuzzy_text, '') AS fuzzy_text, coalesce(miss_text, '') AS miss_text,
    (coalesce(n_direct, 0) + coalesce(n_fuzzy, 0))::DOUBLE / greatest(coalesce(n_terms, 0), 1) * 100::DOUBLE AS pct_raw
    FROM discovered p LEFT JOIN total USING (sid) LEFT JOIN d_text USING (sid, cid)
    LEFT JOIN f_text USING (sid, cid) LEFT JOIN m_text USING (sid, cid))""",
        f"semantic AS (SELECT *, {r1('pct_raw')} AS pct FROM overlap)",
    ]


# --- match ------------------------------------------------------------------------------
def factors(jobs: str = "jobs") -> list[str]:
    return overlap(30, jobs) + [
        """over AS (SELECT *, CASE WHEN sal_max > 0 THEN (salary - sal_max)::DOUBLE / sal_max ELSE 1::DOUBLE END AS over_pct,
    coalesce(exp_exact, 0) AS exact, (exp BETWEEN exp_min AND emax) AS inside FROM semantic)""",
        """parts AS (SELECT *, pct * 0.4::DOUBLE AS p_skill,
    (CASE WHEN exact <> 0 AND exp = exact THEN 25::DOUBLE WHEN exact <> 0 THEN greatest(0, 25 - abs(exp - exact) * 5)
      WHEN inside THEN 25::DOUBLE - abs(exp - (exp_min + emax)::DOUBLE / 2) / (emax - exp_min + 1) * 5
      WHEN exp < exp_min THEN greatest(0, 25 - (exp_min - exp) * 4) ELSE greatest(15, 25 - (exp - emax) * 2) END)::DOUBLE AS p_exp,
    CASE WHEN salary BETWEEN sal_min AND sal_max THEN 20::DOUBLE WHEN salary < sal_min THEN 18::DOUBLE
      ELSE greatest(0::DOUBLE, 20::DOUBLE - over_pct * 20::DOUBLE) END AS p_sal,
    CASE WHEN anywhere OR near THEN 15::DOUBLE ELSE 6::DOUBLE END AS p_loc,
    CASE WHEN exact <> 0 AND exp = exact THEN 'Exact match: ' || exp || ' years'
      WHEN exact <> 0 THEN exp || ' yrs vs required ' || exact || ' yrs (diff: ' || abs(exp - exact) || ')'
      WHEN inside THEN exp || ' yrs — within range ' || exp_min || '-' || emax
      WHEN exp < exp_min THEN exp || ' yrs — ' || (exp_min - exp) || ' yrs below minimum'
      ELSE exp || ' yrs — ' || (exp - emax) || ' yrs above range (overqualified)' END AS t_exp,
    CASE WHEN salary BETWEEN sal_min AND sal_max THEN '₹' || salary || ' LPA within budget ₹' || sal_min || '-' || sal_max || ' LPA'
      WHEN salary < sal_min THEN '₹' || salary || ' LPA — under budget (good for company)'
      ELSE '₹' || salary || ' LPA — ' || round_even(over_pct * 100::DOUBLE, 0)::BIGINT || '% over max budget' END AS t_sal,
    CASE WHEN anywhere THEN 'Remote/Any location — full points' WHEN near THEN 'Exact location match: ' || c_location
      ELSE c_location || ' vs ' || location || ' — different city, assume open to relocate' END AS t_loc FROM over)""",
        f"""rounded AS (SELECT *, p_skill + p_exp + p_sal + p_loc AS p_all, {r1('p_skill')} AS s_skill,
    {r1('p_exp')} AS s_exp, {r1('p_sal')} AS s_sal, {r1('p_loc')} AS s_loc,
    p_skill / 40 * 100 AS q_skill, p_exp / 25 * 100 AS q_exp, p_sal / 20 * 100 AS q_sal, p_loc / 15 * 100 AS q_loc FROM parts)""",
        f"""matched AS (SELECT *, {r1('p_all')} AS match_score,
    'Skills ' || round_even(s_skill, 0)::BIGINT || '/40 — ' || (n_direct + n_fuzzy) || ' matched, ' || n_miss || ' missing | '
    || 'Experience ' || round_even(s_exp, 0)::BIGINT || '/25 — ' || t_exp || ' | Salary ' || round_even(s_sal, 0)::BIGINT
    || '/20 — ' || t_sal || ' | Location ' || round_even(s_loc, 0)::BIGINT || '/15 — ' || t_loc AS explanation,
    s_skill || '/40' AS l_skill,
    CASE WHEN (exact <> 0 AND exp <> exact) OR (exact = 0 AND NOT inside) THEN s_exp::INT::VARCHAR ELSE s_exp::VARCHAR END || '/25' AS l_exp,
    CASE WHEN p_sal = 0 THEN '0' ELSE s_sal::VARCHAR END || '/20' AS l_sal, s_loc || '/15' AS l_loc,
    concat_ws(', ', nullif(direct_text, ''), nullif(fuzzy_text, '')) AS matched_text FROM rounded)""",
    ]


def shortlist(bar: float = 45.0, jobs: str = "jobs") -> list[str]:
    lowered = f"CASE WHEN least(count(*) FILTER (match_score >= {bar}) OVER (PARTITION BY sid), 10) < 3 THEN {bar - 10}::DOUBLE ELSE {bar}::DOUBLE END"
    return factors(jobs) + [
        f"bars AS (SELECT *, {lowered} AS threshold FROM matched)",
        """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY match_score DESC, discovery_rank) AS match_rank
    FROM bars WHERE match_score >= threshold) WHERE match_rank <= 10)""",
    ]


# --- transcripts and interest -------------------------------------------------------------
TALK = [
    """own AS (SELECT c.cid, list(skill ORDER BY skill) AS skills FROM candidates c JOIN cand_skill USING (cid) GROUP BY c.cid)""",
    """hit AS (SELECT sid, cid, min(c.skill) AS first_hit, count(*) AS n_hit FROM best JOIN cand_skill c USING (cid)
    JOIN job_skill j USING (sid) WHERE c.low = j.low AND place <= 5 GROUP BY sid, cid)""",
    """who AS (SELECT b.*, coalesce(first_hit, skills[1], 'the required stack') AS primary_skill, coalesce(n_hit, 0) AS n_hit
    FROM best b LEFT JOIN hit USING (sid, cid) LEFT JOIN own USING (cid))""",
    """talk AS (SELECT sid, cid, notice, name, unnest([
    {'turn': 1, 'speaker': 'recruiter', 'intent': 'intro', 'message': 'Hi ' || name || ', your background as a ' || role || ' looks relevant for our ' || title || ' role, especially around ' || primary_skill || '. Would you be open to a quick discussion?'},
    {'turn': 2, 'speaker': 'candidate', 'intent': 'initial_response', 'message': 'Thanks for reaching out. ' || CASE WHEN n_hit > 0 THEN 'I am very interested because the role matches my recent work.' ELSE 'I am open to learning more, though I would want to understand the fit better.' END || ' The ' || title || ' opportunity sounds worth exploring.'},
    {'turn': 3, 'speaker': 'recruiter', 'intent': 'deep_dive', 'message': 'Great. Could you share a recent example of how you used ' || primary_skill || ' in a project?'},
    {'turn': 4, 'speaker': 'candidate', 'intent': 'technical_response', 'message': 'I have used ' || primary_skill || ' in production work and can walk through the architecture, tradeoffs, and outcomes in an interview.'},
    {'turn': 5, 'speaker': 'recruiter', 'intent': 'availability_probe', 'message': 'What is your notice period, salary expectation, and comfort with the role location: ' || location || '?'},
    {'turn': 6, 'speaker': 'candidate', 'intent': 'commitment_signal', 'message': 'My notice period is around ' || notice || ' days. ' || CASE WHEN sal_max <> 0 AND salary <= sal_max THEN 'The salary range looks aligned with my expectations.' ELSE 'I would want to discuss the compensation range in more detail.' END || ' I am open to the next step if the team, scope, and offer are aligned.'}
    ], recursive := true) FROM who)""",
]
MARKERS = values(
    "marker", "kind, term, seq",
    [(kind, t, i) for kind, terms in [
        ("pos", K.ENTHUSIASM_POSITIVE), ("neg", K.ENTHUSIASM_NEGATIVE), ("eng", K.ENGAGEMENT_MARKERS),
        ("rdy", K.COMMITMENT_POSITIVE), ("bnd", K.COMMITMENT_NEGATIVE),
    ] for i, t in enumerate(terms)],
)


RECORDED = [
    """talk AS (SELECT sid, cid, turn, CASE c.role WHEN 'user' THEN 'candidate' ELSE 'recruiter' END AS speaker, c.text AS message
    FROM best JOIN conversations c ON conv_id = cid WHERE c.role IN ('user', 'assistant'))""",
]


def interest() -> list[str]:
    return RECORDED + [
        MARKERS,
        """said AS (SELECT sid, cid, count(*) FILTER (speaker = 'candidate') AS msgs,
    coalesce(sum(length(message)) FILTER (speaker = 'candidate'), 0) AS chars,
    coalesce(string_agg(lower(message), ' ' ORDER BY turn) FILTER (speaker = 'candidate'), '') AS txt
    FROM talk GROUP BY sid, cid)""",
        """found AS (SELECT sid, cid, kind, term FROM said JOIN marker ON contains(txt, term))""",
        """skill_said AS (SELECT DISTINCT sid, cid, low FROM talk JOIN cand_skill USING (cid)
    WHERE speaker = 'candidate' AND contains(lower(message), low))""",
        """tally AS (SELECT b.sid, b.cid, b.notice, msgs, msgs IS NOT NULL AS talked, chars::DOUBLE / greatest(msgs, 1) AS avg_len,
    length(txt) - length(replace(txt, '?', '')) AS questions,
    (SELECT count(*) FROM found f WHERE f.sid = b.sid AND f.cid = b.cid AND kind = 'pos') AS n_pos,
    (SELECT count(*) FROM found f WHERE f.sid = b.sid AND f.cid = b.cid AND kind = 'neg') AS n_neg,
    (SELECT count(*) FROM found f WHERE f.sid = b.sid AND f.cid = b.cid AND kind = 'eng') AS n_eng,
    (SELECT count(*) FROM found f WHERE f.sid = b.sid AND f.cid = b.cid AND kind = 'rdy') AS n_rdy,
    (SELECT count(*) FROM found f WHERE f.sid = b.sid AND f.cid = b.cid AND kind = 'bnd') AS n_bnd,
    (SELECT count(*) FROM skill_said f WHERE f.sid = b.sid AND f.cid = b.cid) AS n_skill
    FROM best b LEFT JOIN said USING (sid, cid))""",
        """signal AS (
    SELECT sid, cid, 'P' AS side, CASE kind WHEN 'pos' THEN 'Enthusiasm marker: ''' WHEN 'eng' THEN 'Engagement marker: ''' ELSE 'Commitment signal: ''' END || term || '''' AS txt FROM found WHERE kind IN ('pos', 'eng', 'rdy')
    UNION SELECT sid, cid, 'N', CASE kind WHEN 'neg' THEN 'Hesitation marker: ''' ELSE 'Commitment blocker: ''' END || term || '''' FROM found WHERE kind IN ('neg', 'bnd')
    UNION SELECT sid, cid, 'P', 'Self-identified skill fit: ' || low FROM skill_said JOIN said USING (sid, cid)
    UNION SELECT sid, cid, 'P', 'Asked ' || questions || ' questions (high engagement)' FROM tally WHERE talked AND questions >= 2
    UNION SELECT sid, cid, 'P', 'Detailed responses (high engagement)' FROM tally WHERE talked AND avg_len > 80
    UNION SELECT sid, cid, 'N', 'Very short responses (low engagement)' FROM tally WHERE talked AND avg_len < 30
    UNION SELECT sid, cid, 'P', 'Short notice period (highly available)' FROM tally WHERE talked AND notice <= 30
    UNION SELECT sid, cid, 'N', 'Long notice period (3+ months)' FROM tally WHERE talked AND notice >= 90
    UNION SELECT sid, cid, 'N', 'Conversation simulation failed' FROM tally WHERE NOT talked)""",
        """signals AS (SELECT sid, cid, count(*) FILTER (side = 'P') AS n_p, count(*) FILTER (side = 'N') AS n_n,
    coalesce(string_agg(txt, ' / ' ORDER BY txt) FILTER (side = 'P'), '') AS positive,
    coalesce(string_agg(txt, ' / ' ORDER BY txt) FILTER (side = 'N'), '') AS negative,
    coalesce(list(txt ORDER BY txt) FILTER (side = 'P'), []) AS p_list, coalesce(list(txt ORDER BY txt) FILTER (side = 'N'), []) AS n_list
    FROM signal GROUP BY sid, cid)""",
        """grades AS (SELECT t.sid, t.cid, talked, coalesce(questions, 0) AS questions,
    coalesce(n_p, 0) AS n_p, coalesce(n_n, 0) AS n_n, coalesce(positive, '') AS positive, coalesce(negative, '') AS negative,
    coalesce(p_list, []) AS p_list, coalesce(n_list, []) AS n_list,
    CASE WHEN talked THEN greatest(0, least(40, 20 + 4 * n_pos - 6 * n_neg + 2 * n_skill)) ELSE 20 END::DOUBLE AS ent,
    CASE WHEN talked THEN greatest(0, least(30, 10 + 5 * questions + 3 * n_eng + CASE WHEN avg_len > 80 THEN 3 WHEN avg_len < 30 THEN -5 ELSE 0 END)) ELSE 10 END::DOUBLE AS eng,
    CASE WHEN talked THEN greatest(0, least(30, 15 + 5 * n_rdy - 8 * n_bnd + CASE WHEN notice <= 30 THEN 5 WHEN notice >= 90 THEN -3 ELSE 0 END)) ELSE 15 END::DOUBLE AS com
    FROM tally t LEFT JOIN signals USING (sid, cid))""",
        """interest AS (SELECT *, ent + eng + com AS interest_score,
    CASE WHEN NOT talked THEN 'Unknown — conversation could not be completed'
      WHEN com >= 22 THEN 'High commitment — likely to join if offer matches'
      WHEN com >= 15 THEN 'Moderate commitment — needs convincing on role fit'
      WHEN com >= 8 THEN 'Low commitment — exploring options passively'
      ELSE 'Very low commitment — unlikely to move' END AS available,
    'Enthusiasm: ' || CASE WHEN ent IN (0, 40) THEN ent::INT::VARCHAR ELSE ent::VARCHAR END || '/40 | Engagement: '
    || CASE WHEN eng IN (0, 30) THEN eng::INT::VARCHAR ELSE eng::VARCHAR END || '/30 | Commitment: '
    || CASE WHEN com IN (0, 30) THEN com::INT::VARCHAR ELSE com::VARCHAR END || '/30' AS preview FROM grades)""",
    ]


def ranked(bar: float = 45.0, jobs: str = "jobs") -> list[str]:
    return shortlist(bar, jobs) + interest() + [
        "mixed AS (SELECT b.*, i.* EXCLUDE (sid, cid), match_score * 0.6::DOUBLE + interest_score * 0.4::DOUBLE AS combined FROM best b JOIN interest i USING (sid, cid))",
        f"""tiers AS (SELECT *, {r1('combined')} AS combined_score, CASE WHEN combined >= 85 THEN 'PRIORITY HIRE' WHEN combined >= 75 THEN 'FAST-TRACK'
    WHEN combined >= 65 THEN 'RECOMMENDED' WHEN combined >= 55 THEN 'BACKUP' ELSE 'PASS' END AS tier FROM mixed)""",
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY combined_score DESC, match_rank) AS rank,
    CASE tier WHEN 'PRIORITY HIRE' THEN '🔥 PRIORITY HIRE: Exceptional fit + high enthusiasm. Contact immediately!'
      WHEN 'FAST-TRACK' THEN '⚡ FAST-TRACK: Strong match, good interest. Schedule interview this week.'
      WHEN 'RECOMMENDED' THEN '✅ RECOMMENDED: Solid fit, moderate interest. Good interview prospect.'
      WHEN 'BACKUP' THEN '📝 BACKUP: Decent on one dimension, weak on other. Keep in pipeline.'
      ELSE '❌ PASS: Low combined score. Focus on higher-ranked candidates.' END AS recommendation FROM tiers)""",
    ]


TIER_COUNTS = f"""counts AS (SELECT sid, count(*) AS total, count(*) FILTER (tier = 'PRIORITY HIRE') AS priority_hires,
    count(*) FILTER (tier = 'FAST-TRACK') AS fast_track, count(*) FILTER (tier = 'RECOMMENDED') AS recommended,
    sum(round(match_score * 10)::BIGINT)::DOUBLE / 10 / count(*) AS m_raw,
    sum(round(interest_score * 10)::BIGINT)::DOUBLE / 10 / count(*) AS i_raw,
    count(*) FILTER (talked) AS talks, min_by(cid, rank) AS best_cid FROM ranked GROUP BY sid),
    averages AS (SELECT *, {r1('m_raw')} AS avg_match, {r1('i_raw')} AS avg_interest FROM counts)"""

DOCS = """docs AS (SELECT doc_id::VARCHAR AS job_id, text, lower(text) AS low, (doc_id % 4)::INT AS emin,
    coalesce(nullif(CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 4 + doc_id % 3)::INT END, 0), 10) AS emax,
    (doc_id % 20)::INT AS smin, (doc_id % 20 + doc_id % 6)::INT AS smax, (doc_id % 12)::INT AS n_skills FROM documents)"""


def lexicon(rows) -> str:
    return values(
        "lexicon", "type, term, severity, suggestion, seq",
        [(e["type"], e["term"], e["severity"], e["suggestion"], i) for i, e in enumerate(rows)],
    )


def _bias_report():
    return with_(
        DOCS,
        lexicon(bias_lexicon()),
        """issue AS (SELECT job_id, count(term) AS n, count(*) FILTER (severity = 'high') AS hi, count(*) FILTER (severity = 'medium') AS me,
    coalesce(string_agg(DISTINCT type, ', ' ORDER BY type), '') AS types FROM docs LEFT JOIN lexicon ON contains(low, term) GROUP BY job_id)""",
        """advice AS (SELECT job_id, concat_ws(' / ',
    CASE WHEN emax - emin < 2 AND emin > 0 THEN 'Very narrow experience range may exclude qualified candidates. Consider widening by 1-2 years.' END,
    CASE WHEN smax > 0 AND smin > 0 AND (smax - smin)::DOUBLE / nullif(smax, 0) < 0.2::DOUBLE THEN 'Narrow salary band may limit negotiation flexibility and reduce applicant pool.' END,
    CASE WHEN n_skills > 8 THEN 'JD lists ' || n_skills || ' required skills — consider splitting into ''required'' (3-5) and ''nice-to-have''. Long requirement lists deter qualified candidates.' END) AS suggestions,
    (emax - emin < 2 AND emin > 0)::INT + coalesce(smax > 0 AND smin > 0 AND (smax - smin)::DOUBLE / nullif(smax, 0) < 0.2::DOUBLE, false)::INT + (n_skills > 8)::INT AS m FROM docs)""",
        select="""SELECT job_id, n AS issues_found, types AS issue_types, suggestions, hi AS high_severity, me AS medium_severity,
    greatest(0, 100 - 15 * n - 5 * m) AS fairness_score,
    CASE WHEN n = 0 AND m = 0 THEN '✅ No significant bias detected. JD appears inclusive and well-structured.'
      ELSE concat_ws(' | ', CASE WHEN hi > 0 THEN '🔴 ' || hi || ' high-severity bias issue(s) found' END,
        CASE WHEN me > 0 THEN '🟡 ' || me || ' medium-severity language issue(s)' END,
        CASE WHEN m > 0 THEN '💡 ' || m || ' improvement suggestion(s)' END) END AS summary FROM issue JOIN advice USING (job_id)""",
    )


def _title_rules(rules, column="t"):
    return " ".join(
        "WHEN " + " OR ".join(f"contains({column}, {q(term)})" for term in terms) + f" THEN {q(value)}" for value, terms in rules
    )


def _market():
    bench = values("bench", "cat, lev, lo, hi", [(c, lev, lo, hi) for c, levels in K.SALARY_BENCHMARK.items() for lev, (lo, hi) in levels.items()])
    hot = values("hot", "low, kind", [(s, "hot") for s in K.HIGH_DEMAND_SKILLS])
    common = values("common", "low, kind", [(s, "common") for s in K.COMMON_SKILLS])
    ai = ", ".join(q(s) for s in K.AI_SKILLS)
    return with_(
        *JOBS, bench, hot, common,
        f"""req AS (SELECT sid, count(*) FILTER (j.low IN ({ai})) AS n_ai, count(h.low) AS n_hot, count(c.low) AS n_common, count(*) AS n_all,
    coalesce(string_agg(h.low, ', ' ORDER BY place), '') AS hot_text, coalesce(string_agg(c.low, ', ' ORDER BY place), '') AS common_text
    FROM job_skill j LEFT JOIN hot h ON h.low = j.low LEFT JOIN common c ON c.low = j.low WHERE place <= 5 GROUP BY sid)""",
        f"""kinds AS (SELECT j.*, lower(title) AS t, lower(location) AS loc, coalesce(nullif(exp_max, 0), 10) AS emax,
    coalesce(n_ai, 0) AS n_ai, coalesce(n_hot, 0) AS n_hot, coalesce(n_common, 0) AS n_common, coalesce(n_all, 0) AS n_all,
    coalesce(hot_text, '') AS hot_text, coalesce(common_text, '') AS common_text,
    CASE {_title_rules(K.CATEGORY_TITLES)} WHEN coalesce(n_ai, 0) >= 2 THEN 'ai' ELSE 'default' END AS cat,
    CASE {_title_rules(K.SENIORITY_TITLES)} WHEN exp_min >= 8 THEN 'lead' WHEN exp_min >= 4 THEN 'senior' WHEN exp_min >= 2 THEN 'mid' ELSE 'junior' END AS lev
    FROM jobs j LEFT JOIN req USING (sid))""",
        """graded AS (SELECT k.*, lo, hi, 15 * n_hot + CASE WHEN emax - exp_min < 3 THEN 10 ELSE 0 END
    + CASE WHEN sal_max > 0 AND sal_max < 15 THEN 20 ELSE 0 END
    + CASE WHEN NOT contains(loc, 'remote') AND NOT contains(loc, 'any') AND NOT contains(loc, 'hybrid') THEN 10 ELSE 0 END AS d,
    CASE WHEN sal_max = 0 THEN 'Not specified — may deter candidates who value transparency'
      WHEN sal_max >= hi THEN '💰 Above market — strong competitive advantage'
      WHEN sal_max >= (lo + hi)::DOUBLE / 2 THEN '✅ Competitive — within market range'
      WHEN sal_max >= lo THEN '⚠️ Below market median — may struggle to attract top talent'
      ELSE '🔴 Below market — high risk of candidate rejection' END AS assessment
    FROM kinds k JOIN bench USING (cat, lev))""",
        select="""SELECT sid::VARCHAR AS job_id, cat AS role_category, lev AS seniority_level, '₹' || lo || '-' || hi || ' LPA' AS market_range,
    (lo + hi) // 2 AS market_median, '₹' || sal_min || '-' || sal_max || ' LPA' AS offered_range, assessment,
    CASE WHEN n_hot >= 3 THEN '🔴 Scarce — multiple high-demand skills required. Expect longer time-to-hire.'
      WHEN n_hot >= 1 THEN '🟡 Limited — some niche skills required. Moderate talent pool.'
      WHEN n_common >= 3 THEN '🟢 Abundant — mostly common skills. Large talent pool available.'
      ELSE '🟡 Moderate — mixed skill requirements.' END AS talent_supply, d AS difficulty_score,
    CASE WHEN d >= 40 THEN '🔴 Hard — expect 4-8 weeks to fill' WHEN d >= 20 THEN '🟡 Moderate — expect 2-4 weeks to fill' ELSE '🟢 Easy — expect 1-2 weeks to fill' END AS hiring_difficulty,
    CASE WHEN d >= 40 THEN '4-8 weeks' WHEN d >= 20 THEN '2-4 weeks' ELSE '1-2 weeks' END AS estimated_time_to_hire,
    coalesce(nullif(concat_ws(' / ',
      CASE WHEN contains(assessment, 'Below market') THEN 'Consider increasing salary range to market median to attract stronger candidates.' END,
      CASE WHEN n_hot >= 3 THEN 'Consider making some niche skills ''nice-to-have'' instead of required to widen the funnel.' END,
      CASE WHEN d >= 40 THEN 'This is a competitive hire. Consider offering remote/hybrid flexibility to expand the talent pool.' END,
      CASE WHEN n_all > 7 THEN 'JD has ' || n_all || ' required skills. Trim to 4-5 core skills to avoid deterring qualified candidates.' END,
      CASE WHEN n_nice = 0 THEN 'Add a ''Nice-to-have'' section — it helps candidates self-assess and increases application rate.' END,
      CASE WHEN NOT contains(loc, 'remote') AND NOT contains(loc, 'hybrid') THEN 'Consider adding remote/hybrid option — 68% of tech candidates prefer flexible work arrangements.' END), ''),
      'JD looks competitive and well-structured. No major adjustments needed.') AS recommendations,
    hot_text AS hot_skills_in_jd, common_text AS common_skills_in_jd FROM graded""",
    )


def _generated():
    def draw(salt):
        return f"('0x' || substr(md5(concat_ws('|', c_custkey::VARCHAR, {q(salt)}, '{SEED}')), 1, 8))::BIGINT"

    def weighted(salt, weights):
        total, cases = 0, []
        for value, weight in weights.items():
            total += weight
            cases.append(f"WHEN {draw(salt)} % {sum(weights.values())} < {total} THEN {value if isinstance(value, int) else q(value)}")
        return "CASE " + " ".join(cases) + " END"

    def pick(salt, items):
        body = ", ".join(str(i) if isinstance(i, int) else q(i) for i in items)
        return f"list_extract([{body}], ({draw(salt)} % {len(items)} + 1)::INT)"

    bands = values("band", "domain, lo_exp, hi_exp, lo, hi", [
        (d, a, b, lo, hi) for d, steps in G.SALARY_BANDS.items() for (a, b), (lo, hi) in zip(G.SALARY_STEPS, steps)
    ])
    words = G.Vocabulary()
    return with_(
        bands,
        f"people AS (SELECT c_custkey, {weighted('domain', G.DOMAIN_WEIGHTS)} AS domain, {weighted('years', G.EXPERIENCE_WEIGHTS)} AS years FROM customer)",
        select=f"""SELECT 'C' || CASE WHEN c_custkey + 1 < 10000 THEN lpad((c_custkey + 1)::VARCHAR, 4, '0') ELSE (c_custkey + 1)::VARCHAR END AS id,
    p.domain, years AS experience_years, (lo + {draw('salary')} % (hi - lo + 1))::INT AS salary_expectation_lpa,
    {pick('notice', G.NOTICE_DAYS)} AS notice_period_days, {pick('city', words.cities)} AS location,
    '+91 ' || ({draw('phone1')} % 30000 + 70000) || ' ' || ({draw('phone2')} % 90000 + 10000) AS phone,
    {pick('mode', G.WORK_MODES)} AS preferred_work_mode, {pick('availability', G.AVAILABILITY)} AS availability_status,
    true AS skill_count_ok, {draw('github')} % 100 < 30 AS no_github
    FROM people p JOIN band b ON b.domain = p.domain AND years BETWEEN lo_exp AND hi_exp""",
    )


def _number(x):
    return f"CASE WHEN {x} = floor({x}) THEN {x}::BIGINT::VARCHAR ELSE {x}::DOUBLE::VARCHAR END"


def _whole(*numbers):
    return "(" + " AND ".join(f"{x} = floor({x})" for x in numbers) + ")"


def _fraction_scores():
    """Quarters on years and pay; a score or distance is printed as a whole number if it comes from whole ones, or is a bound."""

    def gap(a, b):
        return f"CASE WHEN {_whole(a, b)} THEN abs({a} - {b})::BIGINT::VARCHAR ELSE abs({a} - {b})::DOUBLE::VARCHAR END"

    ctes = [
        c.replace("CAST(c_custkey % 13 AS INT) AS exp", "c_custkey % 13 + (c_custkey % 4)::DOUBLE / 4 AS exp")
        .replace("/ 200) AS INT) AS salary", "/ 200) AS INT) + (c_custkey % 4)::DOUBLE / 4 AS salary")
        .replace("CAST(s_suppkey % 6 AS INT) AS exp_min", "s_suppkey % 6 + (s_suppkey % 4)::DOUBLE / 4 AS exp_min")
        .replace("s_suppkey % 15 AS INT) AS sal_max", "s_suppkey % 15 AS INT) + (s_suppkey % 4)::DOUBLE / 4 AS sal_max")
        for c in factors()
    ]
    n = _number
    return with_(*ctes, select=f"""SELECT sid::VARCHAR AS job_id, cid::VARCHAR AS candidate_id, discovery_rank, discovery_score, match_score,
    s_exp AS experience_score, CASE WHEN exact <> 0 AND exp <> exact AND ({_whole("exp", "exact")} OR p_exp = 0)
      OR exact = 0 AND exp < exp_min AND ({_whole("exp", "exp_min")} OR p_exp = 0)
      OR exact = 0 AND exp > emax AND exp >= exp_min AND ({_whole("exp", "emax")} OR p_exp = 15) THEN s_exp::INT::VARCHAR ELSE s_exp::VARCHAR END || '/25' AS experience_label,
    CASE WHEN exact <> 0 AND exp = exact THEN 'Exact match: ' || {n("exp")} || ' years'
      WHEN exact <> 0 THEN {n("exp")} || ' yrs vs required ' || {n("exact")} || ' yrs (diff: ' || {gap("exp", "exact")} || ')'
      WHEN inside THEN {n("exp")} || ' yrs — within range ' || {n("exp_min")} || '-' || {n("emax")}
      WHEN exp < exp_min THEN {n("exp")} || ' yrs — ' || {gap("exp_min", "exp")} || ' yrs below minimum'
      ELSE {n("exp")} || ' yrs — ' || {gap("exp", "emax")} || ' yrs above range (overqualified)' END AS experience_note,
    s_sal AS salary_score, l_sal AS salary_label,
    CASE WHEN salary BETWEEN sal_min AND sal_max THEN '₹' || {n("salary")} || ' LPA within budget ₹' || {n("sal_min")} || '-' || {n("sal_max")} || ' LPA'
      WHEN salary < sal_min THEN '₹' || {n("salary")} || ' LPA — under budget (good for company)'
      ELSE '₹' || {n("salary")} || ' LPA — ' || round_even(over_pct * 100::DOUBLE, 0)::BIGINT || '% over max budget' END AS salary_note
    FROM matched""")


def _clean():
    number = "CASE WHEN {x} THEN {v} ELSE {d} END"
    exp = number.format(x="c_custkey % 6 > 1", v="(c_custkey % 13)::INT", d="0")
    notice = number.format(x="c_custkey % 5 <> 2", v="(c_custkey % 90)::INT", d="30")
    return f"""SELECT CASE WHEN c_custkey % 4 = 0 THEN printf('C%04d', c_custkey + 2) ELSE 'K' || c_custkey END AS candidate_id, c_name AS name,
    'Unknown' AS location, {exp} AS experience_years,
    CASE WHEN c_custkey % 7 = 0 THEN 'Software Engineer' ELSE c_mktsegment END AS current_role,
    CASE WHEN c_custkey % 8 = 0 THEN '' ELSE 'sql|' || lower(c_mktsegment) END AS skills, 'B.Tech' AS education,
    trunc(c_acctbal)::INT AS salary_expectation_lpa, {notice} AS notice_period_days, '' AS bio, c_custkey AS pool_order
    FROM customer"""


def _own_scan():
    rows = bias_lexicon(gendered=OWN_GENDERED, age=OWN_AGE, exclusionary=[], inflation={})
    return with_(
        DOCS, lexicon(rows),
        select=r"""SELECT job_id, type, CASE WHEN type = 'gendered_language' THEN trim(term) ELSE term END AS term, severity, suggestion
    FROM docs JOIN lexicon ON CASE WHEN contains(low, trim(term))
    THEN regexp_matches(' ' || low || ' ', '[^\p{L}\p{N}]' || trim(term) || '[^\p{L}\p{N}]') ELSE false END""",
    )


def _job_funnel():
    usable = "(SELECT * FROM jobs WHERE n_req > 0)"
    return with_(
        *ranked(HIGH_BAR, usable), TIER_COUNTS,
        """steps AS (SELECT j.sid, j.n_req > 0 AS parsed, (SELECT count(*) FROM candidates) AS pool_size,
    (SELECT count(*) FROM discovered d WHERE d.sid = j.sid) AS discovered, (SELECT count(*) FROM best b WHERE b.sid = j.sid) AS matched,
    (SELECT max(threshold) FROM best b WHERE b.sid = j.sid) AS threshold,
    coalesce(talks, 0) AS talks, coalesce(priority_hires, 0) AS p, coalesce(fast_track, 0) AS f, coalesce(recommended, 0) AS r
    FROM jobs j LEFT JOIN averages a USING (sid))""",
        """states AS (SELECT *, CASE WHEN NOT parsed THEN 'parse_failed' WHEN discovered = 0 THEN 'no_candidates' WHEN matched = 0 THEN 'no_matches' ELSE 'ok' END AS status FROM steps)""",
        select="""SELECT sid::VARCHAR AS job_id, pool_size, discovered, matched, talks AS conversations_completed, p AS priority_hires, f AS fast_track,
    r AS recommended, parsed AND discovered < 3 AS widened, coalesce(threshold, 0::DOUBLE) AS threshold, status,
    CASE status WHEN 'parse_failed' THEN 'Could not parse JD. Please include a clear job title and requirements.'
      WHEN 'no_candidates' THEN 'No matching candidates found in talent pool.' WHEN 'no_matches' THEN 'No candidates met minimum match threshold.' END AS error,
    CASE WHEN status <> 'ok' THEN NULL
      WHEN p > 0 THEN '🔥 Strong pipeline! ' || p || ' priority hire(s) identified. Recruiter should contact immediately.'
      WHEN f > 0 THEN '⚡ Good pipeline. ' || f || ' fast-track candidate(s). Schedule interviews this week.'
      WHEN r > 0 THEN '✅ Viable candidates found. ' || r || ' recommended for interview. Pipeline needs nurturing.'
      ELSE '📝 Weak pipeline. Consider revising JD requirements or expanding search channels.' END AS verdict FROM states""",
    )


def oracle_sql() -> dict[str, str]:
    canon = values("canon", "k, v", [(k, ms[0]) for k, ms in K.SYNONYMS.items()])
    names = "SELECT DISTINCT coalesce(s.skill, p.p_name) AS skill FROM part p LEFT JOIN skill_names s ON s.p_name = p.p_name"
    fuzzy = ", ".join(f"({q(a)}, {q(b)}, {r!r}::DOUBLE)" for a, b, r in fuzzy_rows())
    own_markers = values("own_marker", "term, seq", [(t, i) for i, t in enumerate(OWN_MARKERS)])
    chat = """chat AS (SELECT conv_id::VARCHAR AS candidate_id, count(*) FILTER (role = 'user') AS n,
    coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS chars,
    coalesce(string_agg(lower(text), ' ' ORDER BY turn) FILTER (role = 'user'), '') AS txt
    FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)"""
    bands = """CASE WHEN exp <= 2 THEN 'Junior (1-2 years)' WHEN exp <= 5 THEN 'Mid (3-5 years)'
    WHEN exp <= 8 THEN 'Senior (6-8 years)' ELSE 'Lead (9+ years)' END"""
    return {
        "discovery_topk": _discovery(30),
        "discovery_top1": _discovery(1),
        "skill_overlap": with_(*overlap(30), select="""SELECT sid::VARCHAR AS job_id, cid::VARCHAR AS candidate_id, direct_text AS direct_matches,
    fuzzy_text AS fuzzy_matches, n_terms AS total_jd_skills, n_direct + n_fuzzy AS matched_count, pct AS match_percentage,
    miss_text AS unmatched_jd_skills FROM semantic"""),
        "skill_expansion": with_(*HELD, GROUPS, EXPAND, canon, f"names AS ({names})",
            """bare AS (SELECT skill, replace(replace(lower(skill), '.', ''), ' ', '') AS b FROM names)""",
            """terms AS (SELECT skill, lower(skill) AS t FROM names UNION SELECT skill, other FROM names JOIN expand ON term = lower(skill))""",
            select="""SELECT skill, string_agg(t, ', ' ORDER BY t) AS expanded, any_value(coalesce(v, b)) AS canonical
    FROM terms JOIN bare USING (skill) LEFT JOIN canon ON k = b GROUP BY skill"""),
        "fuzzy_pairs": with_(*HELD, GROUPS, EXPAND, f"names AS ({names})", f"fuzzy(js, cs, ratio) AS (VALUES {fuzzy})",
            "terms AS (SELECT lower(skill) AS t FROM names UNION SELECT other FROM names JOIN expand ON term = lower(skill))",
            select="""SELECT js AS jd_skill, cs AS cand_skill, ratio FROM fuzzy WHERE js IN (SELECT t FROM terms) AND cs IN (SELECT t FROM terms)"""),
        "match_factors": with_(*factors(), f"""final AS (SELECT *, {r1('q_skill')} AS z_skill, {r1('q_exp')} AS z_exp, {r1('q_sal')} AS z_sal, {r1('q_loc')} AS z_loc FROM matched)""",
            select="""SELECT sid::VARCHAR AS job_id, cid::VARCHAR AS candidate_id, match_score, s_skill AS skill_match_score, s_exp AS experience_match_score,
    s_sal AS salary_match_score, s_loc AS location_match_score, z_skill AS skills_percentage, z_exp AS experience_percentage,
    z_sal AS salary_percentage, z_loc AS location_percentage, l_skill AS skills_label, l_exp AS experience_label, l_sal AS salary_label,
    l_loc AS location_label, explanation AS overall_explanation, matched_text AS matched_skills, n_fuzzy AS fuzzy_matches_found FROM final"""),
        "match_topk_adaptive": with_(*shortlist(HIGH_BAR), select="SELECT sid::VARCHAR AS job_id, cid::VARCHAR AS candidate_id, match_rank, match_score, threshold FROM best"),
        "bias_issues": with_(DOCS, lexicon(bias_lexicon()), select="""SELECT job_id, type, CASE WHEN type = 'gendered_language' THEN trim(term) ELSE term END AS term, severity, suggestion
    FROM docs JOIN lexicon ON contains(low, term)"""),
        "bias_issues_own_lexicon": _own_scan(),
        "bias_report": _bias_report(),
        "market_intel": _market(),
        "personas": with_(*shortlist(), """fit AS (SELECT b.*, (SELECT count(*) FROM job_skill j JOIN cand_skill c USING (low) WHERE j.sid = b.sid AND c.cid = b.cid AND place <= 5)::DOUBLE
    / greatest(n_req, 1) AS share FROM best b)""",
            """seg AS (SELECT *, CASE WHEN share > 0.5::DOUBLE AND salary <= sal_max THEN 'enthusiastic' WHEN share > 0.3::DOUBLE THEN 'cautious' ELSE 'non-committal' END AS segment FROM fit)""",
            select="""SELECT sid::VARCHAR AS job_id, cid::VARCHAR AS candidate_id, segment, name || ' is a ' || role || ' with ' || exp || ' years experience. They are '
    || CASE segment WHEN 'enthusiastic' THEN 'enthusiastic and engaged — this role aligns well with their career goals'
      WHEN 'cautious' THEN 'curious but cautious — interested but has some questions about fit'
      ELSE 'polite but non-committal — open to hearing more but not actively looking' END || '. Notice period: ' || notice
    || ' days. Salary expectation: ₹' || salary || ' LPA. ' || CASE WHEN salary <= sal_max THEN 'Salary is within budget.'
      ELSE 'Salary expectation exceeds budget — may raise this concern.' END AS persona FROM seg"""),
        "transcripts_templated": with_(*shortlist(), *TALK, select="SELECT sid::VARCHAR AS job_id, cid::VARCHAR AS candidate_id, turn, speaker, intent, message FROM talk"),
        "question_and_length_stats": with_(chat, select="""SELECT candidate_id, n, chars, length(txt) - length(replace(txt, '?', '')) AS questions,
    chars::DOUBLE / greatest(n, 1) AS avg_length FROM chat"""),
        "transcript_markers": with_(chat, own_markers, select="""SELECT candidate_id, coalesce(string_agg(term, ', ' ORDER BY seq), '') AS found
    FROM chat LEFT JOIN own_marker ON contains(txt, term) GROUP BY candidate_id"""),
        "interest_scores": with_(*shortlist(), *interest(), select="""SELECT sid::VARCHAR AS job_id, cid::VARCHAR AS candidate_id, ent AS enthusiasm_score, eng AS engagement_score,
    com AS commitment_score, interest_score AS total_interest_score, positive AS positive_signals, negative AS negative_signals, questions AS questions_asked,
    available AS availability_commitment, preview AS conversation_preview FROM interest"""),
        "ranked_shortlist": with_(*ranked(), select="""SELECT sid::VARCHAR AS job_id, rank, cid::VARCHAR AS candidate_id, name AS candidate_name, match_score, interest_score, combined_score,
    available || '. ' || n_p || ' positive signals, ' || n_n || ' concerns.' AS interest_explanation, recommendation, tier,
    CASE WHEN combined_score >= 85 THEN '🔥 PRIORITY' WHEN combined_score >= 75 THEN '⚡ FAST-TRACK' WHEN combined_score >= 65 THEN '✅ RECOMMENDED' ELSE '📝 BACKUP' END AS display_tier,
    CASE WHEN combined_score >= 85 THEN 'good' WHEN combined_score >= 65 THEN 'warn' ELSE 'plain' END AS score_band,
    CASE tier WHEN 'PRIORITY HIRE' THEN 'Send offer discussion invite' WHEN 'FAST-TRACK' THEN 'Schedule technical interview'
      WHEN 'RECOMMENDED' THEN 'Send culture-fit interview invite' ELSE 'Keep warm, reach out in 2 weeks' END AS next_step,
    CASE tier WHEN 'PRIORITY HIRE' THEN 'Within 24 hours' WHEN 'FAST-TRACK' THEN 'This week' WHEN 'RECOMMENDED' THEN 'Next week' ELSE 'Flexible' END AS timeline FROM ranked"""),
        "tier_counts": with_(*ranked(), TIER_COUNTS, select="""SELECT sid::VARCHAR AS job_id, total AS total_candidates_considered, priority_hires, fast_track, recommended,
    avg_match AS average_match_score, avg_interest AS average_interest_score, best_cid::VARCHAR AS best_candidate FROM averages"""),
        "job_funnel": _job_funnel(),
        "flat_shortlist": with_(*ranked(), """miss AS (SELECT sid, cid, list(term ORDER BY term) AS ml FROM
    (SELECT sid, cid, term FROM jd_rest EXCEPT SELECT sid, cid, js FROM alike) GROUP BY sid, cid)""",
            select="""SELECT sid::VARCHAR AS job_id, rank, name, combined_score, match_score, interest_score, recommendation,
    array_to_string(string_split(matched_text, ', ')[1:8], ', ') AS matched_skills, coalesce(array_to_string(ml[1:5], ', '), '') AS missing_skills,
    l_skill AS skills_score, l_exp AS experience_score, l_sal AS salary_score, l_loc AS location_score, available AS availability,
    coalesce(array_to_string(p_list[1:3], ', '), '') AS enthusiasm_signals, coalesce(array_to_string(n_list[1:2], ', '), '') AS concerns
    FROM ranked LEFT JOIN miss USING (sid, cid)"""),
        "summary_unpivot": with_(*ranked(), TIER_COUNTS, select="""SELECT sid::VARCHAR AS job_id, unnest([
    {'position': 1, 'label': 'Job Title', 'value': title}, {'position': 2, 'label': 'Job Location', 'value': location},
    {'position': 3, 'label': 'Total Candidates Evaluated', 'value': total::VARCHAR}, {'position': 4, 'label': 'Priority Hires', 'value': priority_hires::VARCHAR},
    {'position': 5, 'label': 'Fast-Track', 'value': fast_track::VARCHAR}, {'position': 6, 'label': 'Recommended', 'value': recommended::VARCHAR},
    {'position': 7, 'label': 'Average Match Score', 'value': avg_match::VARCHAR}, {'position': 8, 'label': 'Average Interest Score', 'value': avg_interest::VARCHAR}
    ], recursive := true) FROM jobs JOIN averages USING (sid)"""),
        "report_documents": with_(*ranked(), TIER_COUNTS, select=f"""SELECT r.sid::VARCHAR AS job_id, title AS job_title, location AS job_location, total AS total_candidates_considered,
    priority_hires, CASE {_title_rules(K.CATEGORY_TITLES, 'lower(title)')} WHEN (SELECT count(*) FROM job_skill k WHERE k.sid = r.sid AND place <= 5
    AND low IN ({', '.join(q(s) for s in K.AI_SKILLS)})) >= 2 THEN 'ai' ELSE 'default' END AS role_category,
    rank, cid::VARCHAR AS candidate_id, combined_score,
    (SELECT count(*) FROM talk t WHERE t.sid = r.sid AND t.cid = r.cid) AS turns FROM ranked r JOIN averages USING (sid)"""),
        "report_parts": with_(*ranked(), """spoken AS (SELECT r.sid, r.rank, r.cid, turn, speaker, message,
    row_number() OVER (PARTITION BY r.sid, r.cid ORDER BY turn NULLS FIRST, speaker, message) - 1 AS place FROM ranked r JOIN talk t ON t.sid = r.sid AND t.cid = r.cid)""",
            select="""SELECT sid::VARCHAR AS job_id, rank::INT AS rank, (place // 1000)::INT AS chunk, cid::VARCHAR AS candidate_id, '' AS job_title,
    count(*)::INT AS turns, md5(string_agg(turn || ':' || speaker || ':' || message, '|' ORDER BY place)) AS said_md5 FROM spoken GROUP BY ALL
    UNION ALL SELECT sid::VARCHAR, 0, 0, '', title, 0, md5('') FROM jobs WHERE sid IN (SELECT sid FROM ranked)"""),
        "pool_stats": with_(*CANDIDATES, """sums AS (SELECT count(*) AS n, count(DISTINCT location) AS locs, sum(exp)::DOUBLE / count(*) AS e, sum(salary)::DOUBLE / count(*) AS s FROM candidates)""",
            select=f"SELECT n AS total_candidates_in_pool, locs AS unique_locations, {r1('e')} AS avg_experience, {r1('s')} AS avg_salary FROM sums"),
        "pool_locations": with_(*CANDIDATES, select="SELECT location, count(*) AS candidates FROM candidates GROUP BY location"),
        "top_locations": with_(*CANDIDATES, select="SELECT location, count(*) AS candidates FROM candidates GROUP BY location ORDER BY 2 DESC, 1 LIMIT 5"),
        "experience_bands": with_(*CANDIDATES, select=f"SELECT {bands} AS band, count(*) AS candidates FROM candidates GROUP BY 1"),
        "clean_pool": _clean(),
        "header_check": "SELECT 'x' AS education, count(DISTINCT c_name) AS names FROM customer",
        "generate_pool": _generated(),
        "jd_extraction": with_(*JOBS, select="""SELECT sid::VARCHAR AS job_id, title, location,
    (SELECT coalesce(string_agg(skill, ', ' ORDER BY skill), '') FROM job_skill k WHERE k.sid = j.sid AND place <= 5) AS required_skills,
    (SELECT coalesce(string_agg(skill, ', ' ORDER BY skill), '') FROM job_skill k WHERE k.sid = j.sid AND place > 5) AS nice_to_have,
    exp_min, coalesce(exp_max, -1) AS exp_max, sal_min, sal_max, 30 AS notice_preference_days FROM jobs j"""),
        "jd_decode": with_(*JOBS, select="""SELECT sid::VARCHAR AS job_id, title, location,
    (SELECT coalesce(string_agg(low, ', ' ORDER BY place), '') FROM job_skill k WHERE k.sid = j.sid AND place <= 5) AS required_skills,
    (SELECT coalesce(string_agg(low, ', ' ORDER BY place), '') FROM job_skill k WHERE k.sid = j.sid AND place > 5) AS nice_to_have,
    exp_min::DOUBLE AS exp_min, coalesce(exp_max, -1)::DOUBLE AS exp_max, sal_max + (sid % 4)::DOUBLE / 4 AS sal_max,
    CASE WHEN sid % 3 = 0 THEN 3000000000 ELSE 30 END::DOUBLE AS notice_preference_days, n_req > 0 AS sufficient FROM jobs j"""),
        "fraction_scores": _fraction_scores(),
        "jd_rejects": r"""SELECT doc_id::VARCHAR AS job_id, length(text) AS chars, CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 50
    THEN 'Job Description too short. Minimum 50 characters.' END AS reject_reason FROM documents""",
        "jd_skill_scan": with_(
            r"said AS (SELECT string_split(unnest(regexp_extract_all(lower(text), '" + PHRASE + r"', 0)), ' ') AS w FROM benchmark)",
            "vocab AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS skill FROM said)",
            select=r"""SELECT doc_id::VARCHAR AS job_id, skill FROM documents JOIN vocab ON CASE WHEN contains(lower(text), skill)
    THEN regexp_matches(' ' || lower(text) || ' ', '[^\p{L}\p{N}]' || skill || '[^\p{L}\p{N}]') ELSE false END"""),
    }
