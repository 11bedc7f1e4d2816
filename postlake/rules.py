"""Rule tables. Each block of fixed values is stated in the order in which it applies."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: terms that mark a posting as in scope -----------------------------------
POSTING_TERMS = ("postdoc", "post-doc", "postdoctoral", "post-doctoral", "post doctoral")
NEGATING_WORDS = ("no", "not", "without")
EXCLUDED_TITLE_TERMS = (
    r"ph\.?d\.?", "doctoral student", "graduate assistant", "professor", "professorship",
    "faculty", "lecturer", "lectureship", "internship", "master'?s", "undergraduate", "technician",
)
INFORMATIONAL_TITLE_TERMS = (
    "rss feeds?", "subscribe", "subscription", "job channel guide", "how to post",
    "posting guidelines",
)
REASONS = {
    "no_term": "No explicit postdoctoral indicator.",
    "informational": "Item is informational rather than a vacancy.",
    "negated": "Postdoctoral wording is explicitly negated.",
    "excluded": "Title describes a non-postdoctoral role.",
    "accepted": "Explicit postdoctoral opportunity found.",
}

# --- Fixed values: research areas, first match wins ----------------------------------------
RESEARCH_AREAS = (
    ("Artificial Intelligence", "artificial intelligence|machine learning|deep learning|neural network|computer vision|natural language processing"),
    ("Computer Science", "computer science|software|algorithm|cybersecurity|informatics|computing|data science"),
    ("Materials Science", "materials? science|nanomaterial|polymer|composite|metallurgy|semiconductor"),
    ("Engineering", "engineering|mechanics|robotics|aerospace|civil engineer|electrical engineer|mechanical engineer"),
    ("Medicine and Health", "medicine|medical|clinical|health|oncology|neuroscience|epidemiology|pharmacology"),
    ("Environmental Science", "environment|climate|ecology|sustainability|geoscience|oceanography"),
    ("Biology", "biology|biological|genomics|genetics|microbiology|biochemistry|molecular biology"),
    ("Chemistry", "chemistry|chemical|catalysis|spectroscopy"),
    ("Physics", "physics|quantum|photonics|astrophysics|condensed matter"),
    ("Mathematics", "mathematics|mathematical|statistics|probability"),
    ("Economics", "economics|econometrics|economic policy"),
    ("Social Sciences", "social science|sociology|psychology|political science|anthropology|education research"),
)
OTHER_AREA = "Other / Multidisciplinary"
KEYWORD_TAGS = ("AI", "Robotics", "Mechanics", "Biology", "Chemistry", "Physics", "Mathematics")
ALWAYS_TAG = "Postdoctoral"

# --- Fixed values: countries, first match wins ---------------------------------------------
COUNTRIES = (
    "United States", "United Kingdom", "United Arab Emirates", "South Korea", "New Zealand",
    "Saudi Arabia", "South Africa", "Czech Republic", "The Netherlands", "Netherlands",
    "Switzerland", "Australia", "Singapore", "Germany", "France", "Canada", "China", "Japan",
    "India", "Spain", "Italy", "Sweden", "Norway", "Denmark", "Finland", "Belgium", "Austria",
    "Ireland", "Israel", "Portugal", "Poland", "Brazil", "Mexico", "Taiwan", "Hong Kong",
)
#: Institutions recognised by name: name, pattern, country.
KNOWN_INSTITUTIONS = (
    ("UCL – University College London", r"UCL\s*[-–—]\s*University\s+College\s+London", "United Kingdom"),
    ("University of Oxford", r"University\s+of\s+Oxford", "United Kingdom"),
    ("Johns Hopkins University", r"Johns\s+Hopkins\s*University", "United States"),
    ("McGill University", r"McGill\s+University", "Canada"),
    ("Aarhus University", r"Aarhus\s+University", "Denmark"),
)
DOMAIN_COUNTRIES = (
    ("mcgill.ca", "Canada"),
    ("ox.ac.uk", "United Kingdom"),
    ("jhu.edu", "United States"),
    ("ucl.ac.uk", "United Kingdom"),
    ("au.dk", "Denmark"),
)
#: Places that imply a country and a city: phrase, institution it needs, country, city.
KNOWN_PLACES = (
    ("Baltimore, Maryland", None, "United States", "Baltimore"),
    ("central Oxford", "University of Oxford", "United Kingdom", "Oxford"),
    ("Aarhus, Denmark", None, "Denmark", "Aarhus"),
)
#: Other names of countries, as a stated value (without dots) and inside a text.
STATED_COUNTRIES = (
    ("United States", ("USA", "US", "United States", "United States of America")),
    ("United Kingdom", ("UK", "United Kingdom", "Great Britain")),
    ("Netherlands", ("The Netherlands", "Netherlands")),
)
COUNTRIES_IN_TEXT = (
    ("United States", ("United States of America", "United States", "USA", "U.S.A.", "U.S.")),
    ("United Kingdom", ("United Kingdom", "Great Britain", "UK", "U.K.")),
    ("Netherlands", ("Netherlands",)),
)
#: Words before the name of an institution in a text, and how such names begin or end.
INSTITUTION_CUES = ("at", "from", "with")
INSTITUTION_STARTS = ("University of",)
INSTITUTION_ENDS = ("University", "Institute", "Laboratory")
#: Phrases that end the name of an institution.
AFTER_INSTITUTION = (
    "to work", "seeks", "invites", "is looking", "for the", "on the", "within the",
)
NO_INSTITUTION = "See original source"
NO_COUNTRY = "Not specified"
#: City named in an API location text: city, country.
API_CITIES = (
    ("Hinxton", "United Kingdom"),
    ("Cambridge", "United Kingdom"),
    ("Heidelberg", "Germany"),
    ("Hamburg", "Germany"),
    ("Grenoble", "France"),
    ("Barcelona", "Spain"),
    ("Rome", "Italy"),
)

# --- Fixed values: phrases around dates and terms; [x] may be missing, a|b is either ---------
DEADLINE_CUES = (
    "application deadline", "post closing date", "closing date", "application|applications close",
    "application|applications must be received no later than", "last date for applications",
    "apply by", "deadline",
)
DURATION_CUES = (
    "duration :", "duration:", "term is", "initially available|offered for",
    "position|appointment|post|role|positions|appointments|posts|roles is|are [initially] [tentatively] [available|offered] [for]",
    "fixed-term [postdoc] [position] [is] for", "fixed term [postdoc] [position] [is] for",
    "tentatively for",
)
#: What may stand between a length and the word that says what lasts so long.
DURATION_QUALIFIERS = ("fixed-term", "fixed term", "postdoc", "postdoctoral", "research associate")
DURATION_NOUNS = ("appointment", "position", "term", "role")
NUMBER_WORDS = (("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5))
#: Names of a feed that stand before a title.
TITLE_PREFIXES = ("iMechanica Job Channel", "iMechanica")

# --- Fixed values: languages ---------------------------------------------------------------
LANGUAGES = (
    ("de", "German"),
    ("en", "English"),
    ("es", "Spanish"),
    ("fr", "French"),
    ("it", "Italian"),
    ("nl", "Dutch"),
    ("pt", "Portuguese"),
    ("sv", "Swedish"),
    ("unknown", "Unknown"),
)

# --- Fixed values: search filters ----------------------------------------------------------
FILTER_LIMITS = {"keyword": 150, "country": 100, "research_area": 150, "language": 100}
DEADLINE_OPTIONS = ("any", "7", "30", "60", "open", "none")
SEARCHED_COLUMNS = (
    "title", "institution", "country", "city", "research_area", "language", "description", "tags",
)
PAGE_LIMIT, PAGE_LIMIT_MAX, OFFSET_MAX = 50, 100, 10_000

# --- Fixed values: criteria of a preference score and what a match is called, in their order ------
CRITERIA = (
    ("research", "Research terms matched: "),
    ("country", "Preferred country matched: "),
    ("source-language", "Preferred source language matched"),
    ("deadline", "Deadline preference matched"),
    ("direct-application", "Separate direct application is available"),
    ("official-source", "Institution-owned official source"),
    ("completeness", " of 5 comparison details are stated"),
)

# --- Fixed values: rows of a comparison and their labels, in their order ----------------------
COMPARISON = (
    ("position", "Position"), ("institution", "Institution"), ("city", "City"), ("country", "Country"),
    ("research", "Research areas"), ("source-language", "Source language"), ("posted", "Posted date"),
    ("deadline", "Deadline"), ("duration", "Duration"), ("employment", "Employment type"),
    ("salary", "Salary or funding"), ("official", "Official source"),
    ("direct", "Direct application available"), ("sources", "Source count"),
    ("verified", "Last verified"), ("preference", "Preference match"),
    ("source-action", "Source action"), ("apply-action", "Apply action"),
)

# --- Fixed values: page addresses ----------------------------------------------------------
ASSET_PATH = (
    r"(?i)\.(?:7z|avi|css|csv|docx?|eot|gif|gz|ico|jpe?g|js|json|m4a|mov|mp3|mp4|mpeg|pdf|png|pptx?"
    r"|rar|rss|svg|tar|tgz|ttf|wav|webm|webp|woff2?|xlsx?|xml|zip)$"
)
EXCLUDED_DETAIL_PATHS = (
    "/about", "/admin", "/comment", "/contact", "/filter", "/search", "/taxonomy", "/tracker",
    "/user",
)

# --- Fixed values: application links -------------------------------------------------------
NO_LINK_SCHEMES = r"(?i)^(?:blob|data|file|javascript|mailto|tel):"
NO_LINK_PATHS = (
    r"(?i)^/$|^/(?:taxonomy|tag|tags|user|users|profile|login|logout|register|search)(?:/|$)"
    r"|^/comment(?:/|$)"
)
COMMENT_PATHS = r"(?i)(?:^|[#/])comment(?:-|/|$)"
APPLY_TEXT = r"apply(?:\s+now|\s+for\s+(?:this\s+)?position)?"
SUBMIT_TEXT = "submit|recruitment system"
PDF_CONTEXT = "apply|submit"
SOCIAL_HOSTS = r"(?i)(?:^|\.)(?:facebook|instagram|linkedin|tiktok|twitter|x)\.com$"
#: Shared listing page that is never an application link.
REGISTERED_LISTING = r"(?i)^/taxonomy/term/73/?$"
NO_LINK_ASSETS = (
    r"(?i)\.(?:avif|bmp|css|csv|docx?|gif|ico|jpe?g|js|json|png|pptx?|svg|webp|xlsx?|xml|zip)(?:$|/)"
)
TRACKING_SIGNAL = r"(?i)(?:analytics|doubleclick|pixel|tracking?)(?:\.|/|$)"
EXPLICIT_APPLICATION = (
    r"apply(?:\s+now|\s+for\s+(?:this\s+)?position)?|application\s+details?"
    r"|submit\s+(?:an\s+|your\s+)?application|applications?\s+must\s+be\s+submitted"
    r"|recruitment\s+system"
)
DIRECT_APPLICATION = (
    r"apply(?:\s+for\s+(?:this\s+)?position|\s+now)?|submit\s+(?:an\s+|your\s+)?application"
    r"|applications?\s+must\s+be\s+submitted"
)
OFFICIAL_VACANCY = (
    r"vacancy\s+details?|job\s+details?|official\s+job\s+advertisement|official\s+vacancy|recruitment"
)
OFFICIAL_URL = r"(?i)(?:career|jobs?|recruit|vacanc|work-at-|application)"
GENERAL_SITE = r"group|home(?:page)?|laboratory|lab|project|website"
LINK_SCORES = {
    "explicit": 300, "official": 200, "other_host": 30, "job_url": 25, "apply_text": 40,
    "submit": 20, "pdf": -50,
}

# --- Fixed values: requests ----------------------------------------------------------------
UNSAFE_FILTER = r"(?i)(?:<|>|&(?:lt|gt|#0*60|#x0*3c);|https?://|www\.)"
ACTIVE_REUSE_MINUTES = 45
CACHE_HOURS = 12
REFRESH_COOLDOWN_MINUTES = 60
VISITOR_HOURLY_LIMIT, GLOBAL_HOURLY_LIMIT = 3, 20

# --- Fixed values: lifecycle, health, delivery ---------------------------------------------
STALE_DAYS, EXPIRED_DAYS = 45, 75
COLLECTION_HOURS = {"twice_daily": 12, "daily": 24, "every_48_hours": 48, "weekly": 168}
BACKOFF_HOURS = ((4, 72), (3, 24), (2, 12))
POLICY_HOLD = "9999-12-31 23:59:59"
POLICY_CODES = ("ROBOTS_DISALLOWED", "CONTENT_SIGNAL_SEARCH_NO", "SOURCE_NOT_APPROVED")
PERMANENT_CODES = (
    "CONTENT_SIGNAL_SEARCH_NO", "ROBOTS_DISALLOWED", "SOURCE_CONTENT_TYPE", "SOURCE_NOT_APPROVED",
    "SOURCE_SCHEMA_INVALID", "SOURCE_TOO_LARGE", "HTML_BUDGET_EXCEEDED",
)
PERMANENT_MESSAGE = r"(?i)invalid|unsupported|configuration|adapter defect"
MAX_ATTEMPTS = 4
RETRY_SECONDS = (60, 300, 900)
CLOSED_STATUSES = ("success", "partial", "failed", "skipped", "dead_lettered")
NO_PRIORITY = 2**53 - 1

# --- Fixed values: comparison --------------------------------------------------------------
MAX_COMPARED = 3
NOT_STATED = "Not stated"


@dataclass(frozen=True)
class Source:
    """One approved source: how it is named, ranked, reached and read."""

    source_key: str
    name: str
    type: str
    priority: int
    collection_interval: str
    institution_owned: bool
    default_institution: str | None
    default_country: str | None
    default_city: str | None
    hosts: tuple[str, ...]
    listing_url: str
    listing_path: str
    detail_patterns: tuple[str, ...]
    paging_parameters: tuple[str, ...]
    item_pattern: str | None
    closed_signals: tuple[str, ...]
    max_details: int
    default_language: str = "English"
    default_language_code: str = "en"
    enabled: bool = True


_CLOSED = (
    "position closed", "applications closed", "no longer accepting applications",
    "job is no longer available",
)

# --- Fixed values: the approved sources ----------------------------------------------------
SOURCES = (
    Source(
        "imechanica-job-channel", "iMechanica Job Channel", "hybrid", 50, "twice_daily", False,
        None, None, None, ("imechanica.org",), "https://imechanica.org/taxonomy/term/73",
        "/taxonomy/term/73", (r"(?i)^/[a-z0-9][a-z0-9-]{2,180}/?$", r"(?i)^/node/\d+/?$"),
        ("page",), None, (*_CLOSED[:3], "vacancy filled"), 10,
    ),
    Source(
        "ornl-postdoctoral-jobs", "Oak Ridge National Laboratory Postdoctoral Jobs", "html", 10,
        "daily", True, "Oak Ridge National Laboratory", "United States", "Oak Ridge",
        ("jobs.ornl.gov",), "https://jobs.ornl.gov/go/Postdoctoral-Jobs/4537100/",
        "/go/Postdoctoral-Jobs/4537100/", (r"(?i)^/job/[a-z0-9%._~-]+/\d+/?$",), ("startrow",),
        r"/(\d+)/?$", _CLOSED, 10,
    ),
    Source(
        "berkeley-lab-postdoctoral", "Berkeley Lab Postdoctoral Opportunities", "html", 10,
        "every_48_hours", True, "Lawrence Berkeley National Laboratory", "United States",
        "Berkeley", ("jobs.lbl.gov",),
        "https://jobs.lbl.gov/landingpages/postdoctoral-fellow-opportunities-at-lbl-12",
        "/landingpages/postdoctoral-fellow-opportunities-at-lbl-12",
        (r"(?i)^/jobs/[a-z0-9%._~-]+-\d+/?$",), ("page",), r"-(\d+)/?$", _CLOSED, 10,
    ),
    Source(
        "embl-postdoctoral-jobs", "European Molecular Biology Laboratory Jobs", "api", 10, "daily",
        True, "European Molecular Biology Laboratory", None, None,
        ("embl.wd103.myworkdayjobs.com",), "https://embl.wd103.myworkdayjobs.com/EMBL", "/EMBL",
        (r"(?i)^/EMBL/job/[a-z0-9%._~/-]+$",), (), None, _CLOSED, 8,
    ),
)
