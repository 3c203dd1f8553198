"""Column expressions for headlines, descriptions, URLs and dates.

Everything here is a plain Spark expression, so it stays in the JVM and can be pushed
next to the scan. Word boundaries are spelled out as character classes because ``\\b``
means different things in different regex engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import dims

_WORD = "[A-Za-z0-9_]"
_B1 = f"(?!{_WORD})"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; lambdas would re-evaluate it per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_width(c: Column) -> Column:
    """Map full-width ASCII forms to ASCII (the part of NFKC that headlines need)."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　 "
    narrow = "".join(chr(0x21 + i) for i in range(94)) + "  "
    return F.translate(c, wide, narrow)


# --- tokens ---------------------------------------------------------------------------
def stem(t: Column) -> Column:
    n = F.length(t)
    return (
        F.when(t == "games", "game")
        .when(t == "movies", "movie")
        .when(t.isin("warning", "series", "species"), t)
        .when((n > 5) & t.endswith("ies"), F.concat(t.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 6) & t.endswith("ing"), t.substr(F.lit(1), n - 3))
        .when((n > 6) & t.endswith("ed"), t.substr(F.lit(1), n - 2))
        .when((n > 6) & t.endswith("es") & t.rlike("(sses|shes|ches|xes|zes|oes)$"), t.substr(F.lit(1), n - 2))
        .when((n > 5) & t.endswith("s") & ~t.rlike("(is|ss|us)$"), t.substr(F.lit(1), n - 1))
        .otherwise(t)
    )


def stem_py(t: str) -> str:
    """The same rule for dimension terms, which are plain Python strings."""
    n = len(t)
    if t in ("games", "movies"):
        return t[:-1]
    if t in ("warning", "series", "species"):
        return t
    for limit, suffixes, cut_, add in (
        (5, ("ies",), 3, "y"), (6, ("ing",), 3, ""), (6, ("ed",), 2, ""),
        (6, ("sses", "shes", "ches", "xes", "zes", "oes"), 2, ""),
    ):
        if n > limit and t.endswith(suffixes):
            return t[:-cut_] + add
    return t[:-1] if n > 5 and t.endswith("s") and not t.endswith(("is", "ss", "us")) else t


def tokens(c: Column) -> Column:
    """Distinct signal words of a text, in order of first appearance."""
    low = F.lower(F.coalesce(c, F.lit("")))
    # what stands before a word is looked at last, so that most positions fail at their first letter
    low = F.regexp_replace(low, rf"u(?<!{_WORD}u)\.?\s*s{_B1}", " usa ")
    low = F.regexp_replace(low, rf"united(?<!{_WORD}united)\s+states{_B1}", " usa ")
    low = F.regexp_replace(low, rf"united(?<!{_WORD}united)\s+kingdom{_B1}", " uk ")
    words = F.array_except(F.split(low, r"[^\p{L}\p{N}]+"), lit_array(dims.STOP_WORDS))
    words = F.filter(words, lambda t: (F.length(t) > 2) | t.isin(dims.SHORT_SIGNALS))
    same = F.create_map(*[F.lit(x) for kv in dims.TOKEN_SYNONYMS.items() for x in kv])
    words = F.transform(words, stem)
    # a map is searched from its start, a list of literals is hashed
    words = F.transform(words, lambda t: F.when(t.isin(*dims.TOKEN_SYNONYMS), F.try_element_at(same, t)).otherwise(t))
    return F.array_distinct(words)


def identity_tokens(c: Column) -> Column:
    """Tokens without the vocabulary that every incident report shares."""
    return F.array_except(tokens(c), lit_array(dims.GENERIC_TOKENS))


def coverage_tokens(c: Column) -> Column:
    return F.array_except(tokens(c), lit_array(dims.COVERAGE_STOP_WORDS + dims.GENERIC_TOKENS))


def sorted_tokens(c: Column) -> Column:
    return F.sort_array(tokens(c))


def search_tokens(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    words = F.filter(words, lambda t: F.length(t) >= 4)
    return F.array_except(words, lit_array(dims.SEARCH_STOP_WORDS))


def _run(words: Column, n: int):
    return lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, n)])


def word_grams(c: Column, longest: int) -> Column:
    """Distinct runs of 1..longest words, lower case, joined by one blank."""
    def grams(words: Column) -> Column:
        runs = [words] + [
            F.when(
                F.size(words) >= n, F.transform(F.slice(words, 1, F.size(words) - n + 1), _run(words, n))
            ).otherwise(F.array().cast("array<string>"))
            for n in range(2, longest + 1)
        ]
        return F.array_distinct(F.concat(*runs))

    words = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+")
    return let(F.filter(words, lambda t: t != ""), grams)


# --- cleaning -------------------------------------------------------------------------
_PICTOGRAPHS = (
    "[\\x{A9}\\x{AE}\\x{203C}\\x{2049}\\x{2122}\\x{2139}\\x{2194}-\\x{2199}\\x{21A9}\\x{21AA}"
    "\\x{231A}\\x{231B}\\x{2328}\\x{2388}\\x{23CF}\\x{23E9}-\\x{23F3}\\x{23F8}-\\x{23FA}\\x{24C2}"
    "\\x{25AA}\\x{25AB}\\x{25B6}\\x{25C0}\\x{25FB}-\\x{25FE}\\x{2600}-\\x{2605}\\x{2607}-\\x{2612}"
    "\\x{2614}-\\x{2685}\\x{2690}-\\x{2705}\\x{2708}-\\x{2712}\\x{2714}\\x{2716}\\x{271D}\\x{2721}"
    "\\x{2728}\\x{2733}\\x{2734}\\x{2744}\\x{2747}\\x{274C}\\x{274E}\\x{2753}-\\x{2755}\\x{2757}"
    "\\x{2763}-\\x{2767}\\x{2795}-\\x{2797}\\x{27A1}\\x{27B0}\\x{27BF}\\x{2934}\\x{2935}"
    "\\x{2B05}-\\x{2B07}\\x{2B1B}\\x{2B1C}\\x{2B50}\\x{2B55}\\x{3030}\\x{303D}\\x{3297}\\x{3299}"
    "\\x{1F000}-\\x{1F0FF}\\x{1F10D}-\\x{1F10F}\\x{1F12F}\\x{1F16C}-\\x{1F171}\\x{1F17E}\\x{1F17F}"
    "\\x{1F18E}\\x{1F191}-\\x{1F19A}\\x{1F1AD}-\\x{1F1FF}\\x{1F201}-\\x{1F20F}\\x{1F21A}\\x{1F22F}"
    "\\x{1F232}-\\x{1F23A}\\x{1F23C}-\\x{1F23F}\\x{1F249}-\\x{1F3FA}\\x{1F400}-\\x{1F53D}"
    "\\x{1F546}-\\x{1F64F}\\x{1F680}-\\x{1F6FF}\\x{1F774}-\\x{1F77F}\\x{1F7D5}-\\x{1F7FF}"
    "\\x{1F80C}-\\x{1F80F}\\x{1F848}-\\x{1F84F}\\x{1F85A}-\\x{1F85F}\\x{1F888}-\\x{1F88F}"
    "\\x{1F8AE}-\\x{1F8FF}\\x{1F90C}-\\x{1F93A}\\x{1F93C}-\\x{1F945}\\x{1F947}-\\x{1FAFF}"
    "\\x{1FC00}-\\x{1FFFD}]"
)
# The outer class turns most characters away with one comparison; the long one alone tries range after range.
PICTOGRAPHS = rf"[[\x{{A9}}\x{{AE}}\x{{203C}}-\x{{1FFFD}}]&&{_PICTOGRAPHS}]"
DISPLAY_MARKS = rf"[\x{{200D}}\x{{FE0F}}{PICTOGRAPHS}]"


def _code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def decode_entities(c: Column) -> Column:
    """XML/HTML entities of a feed field; numeric ones by code point, ``&amp;`` last."""
    valid = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)

    def numeric(acc: Column, e: Column) -> Column:
        dec = F.regexp_extract(e, r"&#(\d+);", 1)
        n = F.when(dec != "", dec.try_cast("bigint")).otherwise(
            F.conv(F.regexp_extract(e, r"&#[xX]([0-9a-fA-F]+);", 1), 16, 10).try_cast("bigint")
        )
        return F.when(valid(n), F.replace(acc, e, _code_point(n))).otherwise(acc)

    entity = F.lit(r"&#(?:\d{1,7}|[xX][0-9a-fA-F]{1,6});")
    by_number = lambda x: F.when(
        x.contains("&#"),
        F.aggregate(F.array_distinct(F.regexp_extract_all(x, entity, 0)), x, numeric),
    ).otherwise(x)
    c = let(F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), by_number)
    for name, value in (("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(value))
    return F.trim(c)


def strip_markup(c: Column) -> Column:
    """Tags to blanks, entities decoded, pictographs and flags dropped, blanks collapsed."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "), r"\s+", " ")
    c = F.regexp_replace(decode_entities(c), PICTOGRAPHS, "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_display(c: Column) -> Column:
    """Stream titles: pictographs, joiners and repeated blanks removed."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), DISPLAY_MARKS, "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_feed_text(c: Column) -> Column:
    """Text for summaries; here ``&amp;`` is decoded before the other named entities."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")
    for pattern, value in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("(?:&#39;|&apos;)", "'"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.regexp_replace(c, "(?i)" + pattern, value)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def truncate_words(c: Column, longest: int = 180, floor: int = 80, tail: str = "…") -> Column:
    """Cut at the last blank before ``longest`` (never below ``floor``) and add ``tail``."""
    head = F.substring(c, 1, longest - len(tail))
    last = F.length(head) - F.instr(F.reverse(head), " ")
    last = F.when(F.instr(head, " ") > 0, last).otherwise(-1)
    cut_ = head.substr(F.lit(1), F.greatest(F.lit(floor), last))
    return F.when(F.length(c) <= longest, c).otherwise(F.concat(cut_, F.lit(tail)))


# --- keys and ids ---------------------------------------------------------------------
def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def publisher_key(c: Column) -> Column:
    """Canonical publisher key: folded, ``&`` spelled out, aliases resolved."""
    key = F.replace(F.lower(fold_width(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" and "))
    key = F.trim(F.regexp_replace(key, r"[^\p{L}\p{N}]+", " "))
    alias = F.create_map(*[F.lit(x) for kv in dims.PUBLISHER_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(alias, key), key)


def stable_id(c: Column) -> Column:
    """32-bit FNV-1a in base 36, the short public id of an article or event."""
    step = lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("bigint")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    chars = F.filter(F.split(c, ""), lambda ch: ch != "")
    return F.lower(F.conv(F.aggregate(chars, F.lit(2166136261).cast("bigint"), step).cast("string"), 10, 36))


URL_PATTERN = r"(?i)^\s*(https?)://(?:[^/?#@\s]*@)?([^/?#:@\s]+)(:\d+)?([^?#\s]*)([?#]\S*)?\s*$"


def safe_url(c: Column) -> Column:
    """http(s) URL with lower-case scheme and host, or null."""

    def parts(x: Column) -> Column:
        part = lambda i: F.regexp_extract(x, URL_PATTERN, i)
        path = F.when(part(4) == "", F.lit("/")).otherwise(part(4))
        return F.when(
            x.rlike(URL_PATTERN), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3), path, part(5))
        )

    return let(c, parts)


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, URL_PATTERN, 2))


def url_origin(c: Column) -> Column:
    part = lambda i: F.lower(F.regexp_extract(c, URL_PATTERN, i))
    return F.concat(part(1), F.lit("://"), part(2), part(3))


def url_key(url: Column, title: Column) -> Column:
    """Host without ``www.`` plus path; the title key where there is no usable URL."""
    path = F.regexp_extract(url, URL_PATTERN, 4)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    return F.when(url.rlike(URL_PATTERN), F.lower(F.concat(host, path))).otherwise(title_key(title))


def publisher_from_url(c: Column) -> Column:
    """Second-level host label, one further up under ``co.uk``-like suffixes, title-cased."""
    parts = F.split(F.regexp_replace(url_host(c), r"^www\.", ""), r"\.")
    n = F.size(parts)
    at = lambda k: F.when(n >= k, F.try_element_at(parts, -F.lit(k)))
    country_suffix = (F.length(at(1)) == 2) & at(2).isin("co", "com", "net", "org")
    label = F.when(country_suffix, at(3)).otherwise(at(2))
    return F.initcap(F.regexp_replace(F.coalesce(label, F.lit("")), r"[-_]+", " "))


def parse_date(c: Column) -> Column:
    """ISO, RFC-822 or compact ``yyyyMMddTHHmmssZ``; anything else is null."""
    c = F.trim(c)
    bare = F.regexp_replace(c, r"^[A-Za-z]{3,9},?\s+(?=\d)", "")
    compact = F.regexp_replace(c, r"^(\d{8}T\d{6})Z?$", "$1Z")
    attempts = [
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), c.try_cast("timestamp")),
        F.when(c.rlike(r"^\d{8}T\d{6}Z?$"), F.try_to_timestamp(compact, F.lit("yyyyMMdd'T'HHmmssX"))),
        F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))),
        F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [A-Z]{1,4}$"), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z"))),
        F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z"))),
        F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2} [A-Z]{1,4}$"), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm z"))),
    ]
    return F.coalesce(*attempts)


# --- headline tests -------------------------------------------------------------------
# Fixed patterns.
ERROR_TITLE = (
    r"(?i)^(?:access denied|attention required|error|feed unavailable|no feed access"
    r"|service unavailable)(?:[^A-Za-z0-9_]|$)"
)
EVENT_WORDS = (
    "accident|agree(?:d|s)?|announce(?:d|s)?|approve(?:d|s)?|arrest(?:ed|s)?|attack(?:ed|s)?"
    "|ban(?:ned|s)?|battle|blast|block(?:ed|s)?|ceasefire|collapse(?:d|s)?|conflict"
    "|crash(?:ed|es)?|crisis|deal|death|demand(?:ed|s)?|deploy(?:ed|s)?|destroy(?:ed|s)?"
    "|die(?:d|s)?|earthquake|elect(?:ed|ion|ions|s)?|evacuat(?:e|ed|es|ion)|explode(?:d|s)?"
    "|fire|flood(?:ed|ing|s)?|government|hostage|injur(?:ed|ies|y)|investigat(?:e|ed|es|ion)"
    "|kill(?:ed|ing|s)?|launch(?:ed|es)?|law|meet(?:ing|s)?|missile|parliament|peace"
    "|protest(?:ed|ers|ing|s)?|quake|resign(?:ed|s)?|sanction(?:ed|s)?|shoot(?:ing|s)?"
    "|sign(?:ed|s)?|strike(?:s)?|talks|treaty|trial|vote(?:d|s)?|war|wildfire"
)
EVENT_TITLE = rf"(?i)(?:^|[^A-Za-z0-9_])(?:{EVENT_WORDS})s?(?:[^A-Za-z0-9_]|$)"
TOPIC_PAGE = r"(?i)(?:^|[^A-Za-z0-9_])news\s*\|\s*today(?:'|’)?s latest stories\s*\|\s*reuters[.!]?$"
LATEST_PAGE = r"(?i)^(?:latest|breaking)\s+.+\s+news(?:\s+and\s+headlines)?[.!]?$"
SEPARATOR = r"(?i)\s(?:&|and|/|\||·|:)\s"
SECTION_SUFFIX = r"(?i)(?:^|[^A-Za-z0-9_])(?:current affairs|latest headlines|latest news|news|updates)\.?$"
HEADLINE_WORD = r"[\p{L}\p{N}]+(?:['’.-][\p{L}\p{N}]+)*"
FOREIGN_SCRIPT = (
    r"[\p{IsArabic}\p{IsArmenian}\p{IsBengali}\p{IsCyrillic}\p{IsDevanagari}\p{IsGeorgian}"
    r"\p{IsGreek}\p{IsHan}\p{IsHangul}\p{IsHebrew}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
)


def is_error_title(c: Column) -> Column:
    return F.trim(c).rlike(ERROR_TITLE)


def is_non_event_title(c: Column) -> Column:
    """Section labels, error pages and topic indexes rather than reports."""
    title = F.trim(fold_width(F.coalesce(c, F.lit(""))))
    n = F.size(F.regexp_extract_all(title, F.lit(HEADLINE_WORD), 0))
    quiet = ~title.rlike(EVENT_TITLE)
    return (
        (title == "")
        | is_error_title(title)
        | title.rlike(TOPIC_PAGE)
        | title.rlike(LATEST_PAGE)
        | (n == 1)
        | (quiet & title.rlike(SEPARATOR) & (n <= 6))
        | (quiet & title.rlike(SECTION_SUFFIX) & (n <= 8))
    )


def is_english(c: Column) -> Column:
    """False for other scripts and for Latin text dominated by foreign function words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), 0)
    count = lambda vocabulary: F.size(F.filter(words, lambda w: w.isin(vocabulary)))
    en, other = count(dims.ENGLISH_SIGNALS), count(dims.NON_ENGLISH_SIGNALS)
    accented = c.rlike("[À-ʯ]")
    foreign = (other >= 3) | ((other >= 2) & (en == 0)) | (accented & (other >= 1) & (en == 0))
    return ~c.rlike(FOREIGN_SCRIPT) & ~(foreign & (en < other))
