"""Fixed values and dimension tables.

Word lists, ratings and needles that decide results are fixed values; the category
lexicon and the gazetteer are parameters that a deployment loads from its own tables
(``load_lexicon`` / ``load_gazetteer``). The lists below the parameters are starters.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: enumerations -----------------------------------------------------
CATEGORIES = [
    "Politics", "Economy", "Conflict and security", "Crime and justice", "Environment",
    "Weather and disasters", "Health", "Science and technology", "Society and education",
    "Travel and transport", "Culture and entertainment", "Sports", "Food and agriculture",
    "Local affairs", "Other",
]
LABELS = ["Very strong", "Strong", "Building", "Early"]
TIE_PRIORITY = [
    "Conflict and security", "Crime and justice", "Weather and disasters", "Health",
    "Science and technology", "Sports", "Culture and entertainment", "Environment",
    "Economy", "Politics", "Travel and transport", "Food and agriculture",
    "Society and education", "Local affairs", "Other",
]
PERSPECTIVE_CATEGORIES = ["Politics", "Economy", "Conflict and security", "Crime and justice"]
CATEGORY_COLORS = {
    "Politics": "#a78bfa", "Economy": "#3b82f6", "Conflict and security": "#fb4d5f",
    "Crime and justice": "#f97316", "Environment": "#22c55e",
    "Weather and disasters": "#f59e0b", "Health": "#ec4899",
    "Science and technology": "#06b6d4", "Society and education": "#818cf8",
    "Travel and transport": "#14b8a6", "Culture and entertainment": "#d946ef",
    "Sports": "#84cc16", "Food and agriculture": "#facc15", "Local affairs": "#38bdf8",
    "Other": "#94a3b8",
}
MAP_BASE_COLOR = "#182333"
COLOR_NO_CATEGORY = "#303a47"
COLOR_UNKNOWN_COUNTRY = "#33495a"
COLOR_NOT_READY = "#5b6b78"
COLOR_NO_EVENT = "#42657a"
COLOR_MARKER_NO_EVENT = "#8aa3b2"

# --- fixed values: token rules ------------------------------------------------------
STOP_WORDS = [
    "a", "about", "after", "against", "amid", "an", "and", "are", "as", "at", "be", "by",
    "extraordinarily", "for", "from", "has", "have", "how", "in", "is", "it", "latest",
    "may", "more", "new", "news", "of", "on", "over", "report", "reports", "says", "still",
    "that", "the", "their", "this", "to", "under", "update", "was", "were", "will", "with",
]
GENERIC_TOKENS = [
    "attack", "dead", "deadly", "injur", "injured", "kill", "killed", "official", "police",
    "shoot", "shooting", "suspect", "victim",
]
SHORT_SIGNALS = ["ai", "eu", "fc", "uk", "un", "us", "vs"]
TOKEN_SYNONYMS = {
    "advisories": "warning", "advisory": "warning", "alerts": "warning", "alert": "warning",
    "american": "usa", "america": "usa", "americans": "usa", "bombard": "attack",
    "canadian": "canada", "chinese": "china", "heatwave": "heat", "hot": "heat",
    "iranian": "iran", "israeli": "israel", "pummel": "attack", "russian": "russia",
    "scorching": "heat", "sweltering": "heat", "taiwanese": "taiwan", "temperature": "heat",
    "temperatures": "heat", "turkish": "turkey", "ukrainian": "ukraine", "us": "usa",
    "warnings": "warning",
}
COVERAGE_STOP_WORDS = [
    "about", "after", "again", "against", "amid", "and", "are", "but", "for", "from", "has",
    "have", "latest", "live", "into", "its", "new", "still", "under", "over", "says",
    "stretch", "the", "their", "this", "that", "with",
]
ENGLISH_SIGNALS = [
    "after", "and", "are", "as", "at", "for", "from", "has", "in", "is", "new", "of", "on",
    "says", "the", "to", "with",
]
NON_ENGLISH_SIGNALS = [
    "al", "avec", "că", "care", "ce", "da", "dal", "dans", "de", "del", "des", "di", "din",
    "do", "donde", "du", "el", "en", "et", "fehér", "für", "gli", "il", "în", "la", "las",
    "le", "les", "los", "mais", "más", "nel", "o", "pe", "pela", "pentru", "por", "pour",
    "que", "qui", "se", "și", "sous", "su", "sur", "un", "una", "une", "va", "zöld", "nemcsak",
]
NICHE_TERMS = [
    "astrology", "bundle", "coupon", "curiosity", "giveaway", "horoscope", "lottery",
    "oddity", "obituary", "shopping", "sweepstakes",
]
SEARCH_STOP_WORDS = [
    "about", "after", "against", "amid", "and", "are", "breaking", "for", "from", "has",
    "have", "into", "its", "live", "news", "over", "says", "that", "the", "their", "this",
    "with",
]
CAMERA_TERMS = [
    "camera", "city cam", "citycam", "downtown", "harbor", "harbour", "skyline",
    "street cam", "traffic cam", "web cam", "webcam",
]
BROADCAST_TERMS = [
    "breaking", "conflict", "election", "headlines", "newscast", "newsroom", "politics", "war",
]

# --- fixed values: publishers -------------------------------------------------------
# (ord, needle, score); the first needle in this order that occurs in the key wins
PROMINENCE = list(
    (i, n, s)
    for i, (n, s) in enumerate(
        [
            ("reuters", 96), ("associated press", 95), ("agence france-presse", 94),
            ("bbc", 91), ("new york times", 90), ("washington post", 89),
            ("the guardian", 87), ("nbc news", 87), ("cbs news", 86), ("al jazeera", 86),
            ("cnn", 85), ("deutsche welle", 84), ("usa today", 84), ("france 24", 83),
            ("cbc", 82), ("abc news", 82), ("newsweek", 81), ("npr", 81), ("un news", 81),
            ("euronews", 80), ("sky news", 80), ("fox news", 80),
            ("washington examiner", 77), ("national review", 76), ("fox weather", 79),
        ]
    )
)
DEFAULT_PROMINENCE = 58
PUBLISHER_ALIASES = {
    "abc news breaking news latest news and videos": "abc news",
    "ap news com": "associated press", "ap news": "associated press",
    "associated press news": "associated press", "bbc": "bbc news",
    "bbc co uk": "bbc news", "bbc com": "bbc news", "cbc ca": "cbc",
    "dw": "deutsche welle", "fox news com": "fox news", "france 24": "france24",
    "npr org": "npr", "reuters com": "reuters", "sky news uk": "sky news",
    "the wall street journal": "wall street journal",
}
# (canonical key, bucket, label)
PUBLISHER_RATINGS = [
    ("reuters", "center", "Center"), ("associated press", "left", "Lean Left"),
    ("bbc news", "center", "Center"), ("cnn", "left", "Lean Left"),
    ("abc news", "left", "Lean Left"), ("nbc news", "left", "Lean Left"),
    ("usa today", "left", "Lean Left"), ("the washington post", "left", "Lean Left"),
    ("washington post", "left", "Lean Left"), ("cbs news", "center", "Center"),
    ("newsweek", "center", "Center"), ("fox news", "right", "Right"),
    ("washington examiner", "right", "Lean Right"), ("national review", "right", "Right"),
    ("al jazeera", "left", "Lean Left"), ("al jazeera english", "left", "Lean Left"),
    ("cbc", "left", "Lean Left"), ("cbc news", "left", "Lean Left"),
    ("deutsche welle", "center", "Center"), ("npr", "left", "Lean Left"),
    ("france24", "center", "Center"), ("euronews", "center", "Center"),
    ("sky news", "center", "Center"), ("cnbc", "left", "Lean Left"),
    ("u s news", "left", "Lean Left"), ("u s news world report", "left", "Lean Left"),
    ("us news", "left", "Lean Left"), ("global news", "left", "Lean Left"),
    ("new york post", "right", "Lean Right"), ("nypost", "right", "Lean Right"),
    ("wall street journal", "center", "Center"), ("wsj", "center", "Center"),
    ("city news", "center", "Center"), ("citynews", "center", "Center"),
    ("stat", "center", "Center"), ("stat news", "center", "Center"),
    ("redstate", "right", "Right"), ("red state", "right", "Right"),
]
NEWSROOMS = [
    "Reuters", "Associated Press", "BBC News", "Sky News", "Al Jazeera English", "DW News",
    "France 24 English", "Euronews", "NBC News", "ABC News", "CBS News", "CNN", "Fox News",
    "Bloomberg Television", "CNBC", "CBC News", "PBS NewsHour", "Guardian News", "WION",
]
EXPECTED_EMPTY_COUNTRIES = ["Fr. S. Antarctic Lands", "Siachen Glacier"]

# --- starter lexicon (a parameter: deployments load their own) ------------------------
STARTER_LEXICON: dict[str, list[str]] = {
    "Conflict and security": ["airstrike", "army", "ceasefire", "civil war", "invasion",
                              "militia", "missile", "troops", "war"],
    "Crime and justice": ["arrest", "burglary", "court", "fraud", "murder", "prison",
                          "robbery", "stabbing", "trial"],
    "Weather and disasters": ["cyclone", "earthquake", "flood", "heat", "hurricane",
                              "landslide", "storm warning", "tornado", "wildfire"],
    "Health": ["cancer", "disease", "hospital", "measles", "outbreak", "public health",
               "vaccine", "virus"],
    "Science and technology": ["ai", "artificial intelligence", "astronomer", "chip",
                               "quantum", "robot", "satellite", "software"],
    "Sports": ["championship", "coach", "cup", "goal", "league", "match", "olympic",
               "tournament", "world cup"],
    "Culture and entertainment": ["album", "box office", "concert", "festival", "film",
                                  "movie", "museum", "series"],
    "Environment": ["biodiversity", "climate", "climate change", "conservation", "emission",
                    "pollution", "species", "wildlife"],
    "Economy": ["bank", "budget", "inflation", "interest rate", "market", "stock", "trade",
                "unemployment"],
    "Politics": ["cabinet", "election", "minister", "parliament", "president",
                 "prime minister", "senate", "vote"],
    "Travel and transport": ["airline", "airport", "ferry", "flight", "passenger",
                             "railway", "train", "tourism"],
    "Food and agriculture": ["agriculture", "crop", "farmer", "food safety", "harvest",
                             "livestock", "recipe", "wheat"],
    "Society and education": ["census", "charity", "education", "school", "student",
                              "teacher", "university"],
}


@dataclasses.dataclass(frozen=True)
class Lexicon:
    """Category -> terms; a bounded parameter that is compiled into column expressions."""

    terms: tuple[tuple[str, tuple[str, ...]], ...]
    max_terms = 50_000

    def __post_init__(self) -> None:
        if sum(len(t) for _, t in self.terms) > self.max_terms:
            raise ValueError("lexicon too large to inline")
        unknown = [c for c, _ in self.terms if c not in TIE_PRIORITY]
        if unknown:
            raise ValueError(f"unknown categories: {unknown}")


def lexicon_from(mapping: dict[str, list[str]]) -> Lexicon:
    return Lexicon(tuple((c, tuple(t)) for c, t in mapping.items()))


def load_lexicon(spark: SparkSession, path: str) -> Lexicon:
    """``category, term`` rows from a CSV with a header."""
    rows = spark.read.csv(path, header=True, schema="category string, term string").limit(
        Lexicon.max_terms + 1
    ).collect()
    mapping: dict[str, list[str]] = {}
    for row in rows:
        mapping.setdefault(row.category, []).append(row.term)
    return lexicon_from(mapping)


def load_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """``country, term`` rows from a CSV with a header."""
    return spark.read.csv(path, header=True, schema="country string, term string")


def prominence_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or PROMINENCE, "ord int, needle string, score int")


def ratings_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or PUBLISHER_RATINGS, "publisher_key string, bucket string, label string")
