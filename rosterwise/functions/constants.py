"""Word lists, tables and message texts that the results are defined by.

They are defaults; the operators take them as arguments.
"""

# --- Fixed values: skill synonyms (key -> synonyms) ---------------------------------
SYNONYMS = {
    "react": ["reactjs", "react.js", "react (frontend framework)"],
    "reactjs": ["react", "react.js"],
    "react.js": ["react", "reactjs"],
    "python": ["python3", "py"],
    "python3": ["python", "py"],
    "node": ["nodejs", "node.js"],
    "nodejs": ["node", "node.js"],
    "node.js": ["node", "nodejs"],
    "aws": ["amazon web services", "ec2", "s3", "amazon cloud"],
    "gcp": ["google cloud platform", "google cloud"],
    "azure": ["microsoft azure"],
    "postgres": ["postgresql"],
    "postgresql": ["postgres"],
    "js": ["javascript"],
    "javascript": ["js"],
    "ts": ["typescript"],
    "typescript": ["ts"],
    "k8s": ["kubernetes"],
    "kubernetes": ["k8s"],
    "ml": ["machine learning"],
    "machine learning": ["ml"],
    "ai": ["artificial intelligence"],
    "artificial intelligence": ["ai"],
    "nlp": ["natural language processing"],
    "natural language processing": ["nlp"],
    "ci/cd": ["cicd", "continuous integration", "continuous deployment"],
    "rest": ["restful", "rest api", "rest apis"],
    "restful": ["rest", "rest api"],
}

# --- Fixed values: bias lexicons -----------------------------------------------------
GENDERED_TERMS = {
    "he ": "they", "him ": "them", "his ": "their",
    "manpower": "workforce", "chairman": "chairperson",
    "manmade": "synthetic", "mankind": "humankind",
    "guys": "team", "rockstar": "high-performer",
    "ninja": "expert", "guru": "specialist",
    "aggressive": "driven", "dominant": "leading",
    "hacker": "developer", "brotherhood": "community",
}
AGE_TERMS = [
    "young", "energetic", "fresh graduate only", "digital native",
    "recent graduate", "gen z", "millennial", "young blood",
    "junior only", "not more than", "maximum age", "age limit",
]
EXCLUSIONARY_TERMS = [
    "native english speaker", "mother tongue",
    "physically fit", "no disabilities",
    "married", "unmarried", "single",
    "specific religion", "specific caste",
]
_INSTITUTION = "Restricting to specific institutions limits talent pool significantly"
_TIER = "Tier-based filtering excludes qualified candidates from diverse backgrounds"
_YEARS = "Consider if this experience level is truly necessary for the role"
INFLATION_TERMS = {
    "degree required": "Consider skills-based hiring — many top engineers are self-taught",
    "iit": _INSTITUTION,
    "nit": _INSTITUTION,
    "tier 1 college": _TIER,
    "tier-1": _TIER,
    "10+ years": _YEARS,
    "15+ years": _YEARS,
}

# --- Fixed values: interest markers --------------------------------------------------
ENTHUSIASM_POSITIVE = [
    "excited", "thrilled", "perfect fit", "ideal", "love to", "definitely interested",
    "sounds great", "amazing opportunity", "exactly what", "passionate about",
    "very interested", "keen to", "would love", "absolutely", "count me in",
    "strong match", "aligned with", "eager to",
]
ENTHUSIASM_NEGATIVE = [
    "not sure", "maybe", "need to think", "hesitant", "not the right time",
    "comfortable where i am", "not looking", "happy current", "reluctant",
    "skeptical", "concerned about", "worried", "doesn't seem", "too risky",
]
ENGAGEMENT_MARKERS = [
    "what about", "how does", "can you tell me", "what is the", "who would",
    "what team", "tech stack", "culture", "growth", "learning", "challenge",
]
COMMITMENT_POSITIVE = [
    "can join", "available in", "notice period is", "can start",
    "flexible on", "willing to", "open to", "ready to move",
]
COMMITMENT_NEGATIVE = [
    "locked in", "contract until", "cannot leave", "bond", "committed to current",
    "just started", "too early", "not possible", "stuck",
]

# --- Fixed values: salary benchmark (category -> seniority -> low, high) ---------------
SALARY_BENCHMARK = {
    "ai": {"junior": (8, 15), "mid": (15, 28), "senior": (25, 45), "lead": (35, 60)},
    "ml": {"junior": (8, 15), "mid": (15, 28), "senior": (25, 45), "lead": (35, 60)},
    "backend": {"junior": (5, 12), "mid": (12, 22), "senior": (20, 35), "lead": (30, 50)},
    "frontend": {"junior": (5, 12), "mid": (10, 20), "senior": (18, 32), "lead": (28, 45)},
    "data": {"junior": (6, 14), "mid": (14, 25), "senior": (22, 40), "lead": (35, 55)},
    "devops": {"junior": (6, 14), "mid": (14, 24), "senior": (22, 38), "lead": (32, 50)},
    "fullstack": {"junior": (5, 12), "mid": (12, 22), "senior": (20, 35), "lead": (30, 50)},
    "product": {"junior": (8, 15), "mid": (15, 28), "senior": (25, 45), "lead": (40, 65)},
    "default": {"junior": (5, 12), "mid": (12, 22), "senior": (20, 35), "lead": (30, 50)},
}

# --- Fixed values: skill demand lists and title rules, first hit wins ------------------
HIGH_DEMAND_SKILLS = [
    "llm", "langchain", "rag", "ai agents", "vector databases",
    "kubernetes", "mlops", "rust", "go", "blockchain",
    "generative ai", "prompt engineering", "fine-tuning",
]
COMMON_SKILLS = [
    "python", "javascript", "java", "sql", "html", "css",
    "react", "node", "django", "flask", "aws", "docker",
    "git", "rest api", "postgresql", "mongodb",
]
CATEGORY_TITLES = [
    ("ai", ["ai", "ml", "machine learning", "artificial"]),
    ("data", ["data scientist", "data engineer", "data analyst"]),
    ("devops", ["devops", "sre", "platform", "infrastructure"]),
    ("frontend", ["frontend", "front-end", "ui"]),
    ("backend", ["backend", "back-end", "server"]),
    ("fullstack", ["fullstack", "full-stack", "full stack"]),
    ("product", ["product manager", "product owner"]),
]
AI_SKILLS = ["llm", "langchain", "tensorflow", "pytorch", "ml", "ai", "nlp"]
SENIORITY_TITLES = [
    ("lead", ["lead", "principal", "staff", "head", "director", "vp"]),
    ("senior", ["senior", "sr.", "sr "]),
    ("junior", ["junior", "jr.", "jr ", "intern", "fresher", "entry"]),
]

# --- Fixed values: tabular pool headers ----------------------------------------------
POOL_HEADERS = {
    "id": "ID",
    "name": "Name",
    "email": "Email",
    "phone": "Phone",
    "location": "Location",
    "experience_years": "Experience (Years)",
    "current_role": "Current Role",
    "current_company": "Current Company",
    "skills": "Skills",
    "education": "Education",
    "salary_expectation_lpa": "Salary Expectation (LPA)",
    "notice_period_days": "Notice Period (Days)",
    "linkedin": "LinkedIn",
    "github": "GitHub",
    "bio": "Bio",
    "preferred_work_mode": "Preferred Work Mode",
    "availability_status": "Availability Status",
}
HEADER_ALIASES = {
    "experience": "experience_years",
    "exp_years": "experience_years",
    "role": "current_role",
    "company": "current_company",
    "salary_lpa": "salary_expectation_lpa",
    "salary_expectation": "salary_expectation_lpa",
    "salary": "salary_expectation_lpa",
    "notice_period": "notice_period_days",
    "notice_days": "notice_period_days",
    "work_mode": "preferred_work_mode",
    "availability": "availability_status",
}

# --- Fixed values: messages of the pool check, and how many names they show ----------
NO_HEADER = "This file has no header row. Please look at the sample dataset and update your file accordingly."
FEWER_COLUMNS = (
    "Your dataset has fewer or different columns than expected. "
    "Please look at the sample dataset and make the same changes in your file."
)
MORE_COLUMNS = "Your dataset has more fields than expected ({}). Please use only the columns from the sample dataset."
NO_CANDIDATES = (
    "The uploaded file has the correct columns but no valid candidate rows. "
    "Please add candidate data below the header row."
)
SHOWN_NAMES = 6
