"""DuckDB fragments that state the same semantics independently of Spark."""

from __future__ import annotations

from checks import corpus as c
from newsloom import dims
from newsloom.functions import text as tx
from newsloom.operators import classify as cl

AS_OF = f"TIMESTAMP '{c.AS_OF}'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def values(rows, cols: str) -> str:
    def cell(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else q(v)

    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + f") AS v({cols})"


ART = """art AS (
  SELECT printf('a%08d', d.doc_id) AS id, split_part(d.text, chr(10), 1) AS title,
    substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) AS description,
    'https://www.' || d.source || '.example/' || d.lang || '/n' || d.n_chars AS url,
    d.source AS publisher_name, d.lang AS language, e.ts AS published_at, e.event_type AS feed_name,
    e.user_id, d.doc_id, d.n_chars, 'NATION_' || (e.user_id % 25) AS country_name
  FROM documents d JOIN events e ON e.event_id = d.doc_id)"""

DIRECTORY = """directory AS (
  SELECT n_nationkey::BIGINT AS ord, n_name AS country_name, 'm' || n_nationkey AS map_id,
    CASE WHEN n_regionkey < 3 THEN 'C' || n_nationkey END AS iso2 FROM nation)"""
# the directory and three countries without any data
WIDE = DIRECTORY[:-1] + """ UNION ALL SELECT 100 + i, 'EMPTY_' || i, 'm' || (100 + i), NULL FROM range(3) t(i))"""


def hours(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 3600000000.0::DOUBLE)"


def stem(t: str) -> str:
    return (
        f"CASE WHEN {t} IN ('games', 'movies') THEN left({t}, -1) WHEN {t} IN ('warning', 'series', 'species') THEN {t} "
        f"WHEN length({t}) > 5 AND suffix({t}, 'ies') THEN left({t}, -3) || 'y' "
        f"WHEN length({t}) > 6 AND suffix({t}, 'ing') THEN left({t}, -3) "
        f"WHEN length({t}) > 6 AND suffix({t}, 'ed') THEN left({t}, -2) "
        f"WHEN length({t}) > 6 AND regexp_matches({t}, '(sses|shes|ches|xes|zes|oes)$') THEN left({t}, -2) "
        f"WHEN length({t}) > 5 AND suffix({t}, 's') AND NOT regexp_matches({t}, '(is|ss|us)$') THEN left({t}, -1) ELSE {t} END"
    )


def raw_tokens(x: str) -> str:
    low = f"regexp_replace(lower({x}), '\\bu\\.?\\s*s\\.?\\b', ' usa ', 'g')"
    low = f"regexp_replace({low}, '\\bunited\\s+states\\b', ' usa ', 'g')"
    low = f"regexp_replace({low}, '\\bunited\\s+kingdom\\b', ' uk ', 'g')"
    words = f"string_split_regex({low}, '[^\\p{{L}}\\p{{N}}]+')"
    words = (
        f"list_filter({words}, lambda t: (length(t) > 2 OR list_contains({lst(dims.SHORT_SIGNALS)}, t)) "
        f"AND NOT list_contains({lst(dims.STOP_WORDS)}, t))"
    )
    syn = "CASE s " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in dims.TOKEN_SYNONYMS.items()) + " ELSE s END"
    return f"list_transform(list_transform({words}, lambda t: {stem('t')}), lambda s: {syn})"


def tokens(source: str, text: str, out: str) -> str:
    """A select that adds ``out``: distinct tokens in order."""
    return (
        f"(SELECT * EXCLUDE (_l), list_filter(_l, lambda x, i: list_position(_l, x) = i) AS {out} "
        f"FROM (SELECT *, {raw_tokens(text)} AS _l FROM {source}))"
    )


def token_set(source: str, text: str, out: str) -> str:
    return f"(SELECT *, list_distinct({raw_tokens(text)}) AS {out} FROM {source})"


def identity(tok: str) -> str:
    return f"list_filter({tok}, lambda g: NOT list_contains({lst(dims.GENERIC_TOKENS)}, g))"


def score_list(text: str, toks: str) -> dict[str, str]:
    """category -> points expression."""
    out = {}
    for category, terms in c.LEXICON.items():
        words, phrases = cl._split_terms(tuple(terms))
        parts = [f"len(list_filter({lst(words)}, lambda w: list_contains({toks}, w)))"]
        for p in phrases:
            rx = "(^|[^\\p{L}\\p{N}])" + p.replace(" ", "\\s+") + "([^\\p{L}\\p{N}]|$)"
            parts.append(f"(CASE WHEN regexp_matches(lower({text}), {q(rx)}) THEN 2 ELSE 0 END)")
        if category == "Conflict and security":
            rx = "\\b(strikes?|hits?)\\b.{0,90}\\b(base|bases|border|capital|cities|city|military|site|sites|territory)\\b"
            parts.append(f"(CASE WHEN regexp_matches(lower({text}), {q(rx)}) THEN 2 ELSE 0 END)")
        if category == "Economy":
            rx = "\\btariffs?\\b"
            parts.append(f"(CASE WHEN regexp_matches(lower({text}), {q(rx)}) THEN 2 ELSE 0 END)")
        out[category] = " + ".join(parts)
    return out


def classify(source: str, text: str, toks: str, out: str) -> str:
    pts = score_list(text, toks)
    names = [k for k in dims.TIE_PRIORITY if k in pts]
    cols = ", ".join(f"({pts[k]}) AS s{i}" for i, k in enumerate(names))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(names))) + ")"
    niche = [tx.stem_py(t) for t in dims.NICHE_TERMS]
    case = (
        f"CASE WHEN regexp_matches(lower({text}), '\\b(latest )?news bulletin\\b') THEN 'Other' "
        + f"WHEN {best} = 0 AND len(list_intersect({toks}, {lst(niche)})) > 0 THEN 'Other' "
        + f"WHEN {best} = 0 THEN 'Local affairs' "
        + " ".join(f"WHEN s{i} = {best} THEN {q(k)}" for i, k in enumerate(names)) + " END"
    )
    drop = ", ".join(f"s{i}" for i in range(len(names)))
    return f"(SELECT * EXCLUDE ({drop}), {case} AS {out} FROM (SELECT *, {cols} FROM {source}))"


def clamp(x: str) -> str:
    return f"least(100.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"


def tenth(x: str) -> str:
    return f"(floor(({x}) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE)"


def score_columns(sources: str, countries: str, age: str, rate: str) -> str:
    d = lambda x: f"({x})::DOUBLE"
    return ", ".join([
        tenth(clamp(f"log2({d(sources)} + 1.0::DOUBLE) / log2(9.0::DOUBLE) * 100.0::DOUBLE") + " * 0.45::DOUBLE") + " AS corroboration",
        tenth(clamp(f"{d(rate)} / 3.0::DOUBLE * 100.0::DOUBLE") + " * 0.25::DOUBLE") + " AS reporting_momentum",
        tenth(clamp(f"100.0::DOUBLE - {d(age)} / 168.0::DOUBLE * 100.0::DOUBLE") + " * 0.2::DOUBLE") + " AS freshness",
        tenth(f"CASE WHEN {d(countries)} <= 1 THEN 0.0::DOUBLE ELSE {clamp(f'({d(countries)} - 1.0::DOUBLE) / 5.0::DOUBLE * 100.0::DOUBLE')} END * 0.1::DOUBLE") + " AS geographic_reach",
    ])


def scored(source: str, sources: str = "independent_source_count", countries: str = "affected_country_count", age: str = "age_hours", rate: str = "articles_per_hour") -> str:
    total = clamp("corroboration + reporting_momentum + freshness + geographic_reach")
    label = "CASE WHEN importance_score >= 75 THEN 'Very strong' WHEN importance_score >= 55 THEN 'Strong' WHEN importance_score >= 35 THEN 'Building' ELSE 'Early' END"
    return (
        f"(SELECT *, {label} AS importance_label FROM (SELECT *, floor({total} + 0.5::DOUBLE)::INTEGER AS importance_score "
        f"FROM (SELECT *, {score_columns(sources, countries, age, rate)} FROM {source})))"
    )


STORY_GROUPS = f"""story_groups AS (
  SELECT g.*, f.title AS headline, f.description AS summary,
    'e-' || g.publisher_name || '-' || g.language AS event_id,
    CASE g.language WHEN 'en' THEN 'Politics' WHEN 'fr' THEN 'Economy' WHEN 'de' THEN 'Sports' WHEN 'es' THEN 'Health' END AS category,
    CASE WHEN article_count <= 1 THEN 0.0::DOUBLE
      ELSE (article_count - 1) / greatest(1.0::DOUBLE / 60, {hours('last_updated_at', 'first_seen_at')}) END AS articles_per_hour,
    greatest(0.0::DOUBLE, {hours(AS_OF, 'last_updated_at')}) AS age_hours,
    article_count > 1 AS active
  FROM (SELECT publisher_name, language, min(id) AS first_id, count(*) AS article_count,
      min(published_at) AS first_seen_at, max(published_at) AS last_updated_at,
      count(DISTINCT feed_name) AS independent_source_count, count(DISTINCT country_name) AS affected_country_count
    FROM art GROUP BY ALL) g JOIN art f ON f.id = g.first_id)"""
STORIES = f"{STORY_GROUPS}, stories AS (SELECT * FROM {scored('story_groups')})"
BRIDGE = """bridge AS (SELECT DISTINCT 'e-' || publisher_name || '-' || language AS event_id, country_name AS country_code FROM art)"""

# Headline tests.
ERROR_RX = "^(access denied|attention required|error|feed unavailable|no feed access|service unavailable)(\\b|\\s*[|:-])"
EVENT_RX = "\\b(" + tx.EVENT_WORDS + ")s?\\b"


def non_event(t: str) -> str:
    t = f"trim({t})"
    n = f"len(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}]+([''’.-][\\p{{L}}\\p{{N}}]+)*'))"
    quiet = f"NOT regexp_matches({t}, {q(EVENT_RX)}, 'i')"
    return (
        f"({t} = '' OR regexp_matches({t}, {q(ERROR_RX)}, 'i') "
        f"OR regexp_matches({t}, '^(latest|breaking)\\s+.+\\s+news(\\s+and\\s+headlines)?[.!]?$', 'i') OR {n} = 1 "
        f"OR ({quiet} AND regexp_matches({t}, '\\s(&|and|/|\\||·|:)\\s', 'i') AND {n} <= 6) "
        f"OR ({quiet} AND regexp_matches({t}, '\\b(current affairs|latest headlines|latest news|news|updates)\\.?$', 'i') AND {n} <= 8))"
    )


def english(t: str) -> str:
    words = f"regexp_extract_all(lower({t}), '\\p{{L}}+')"
    en = f"len(list_filter({words}, lambda w: list_contains({lst(dims.ENGLISH_SIGNALS)}, w)))"
    no = f"len(list_filter({words}, lambda w: list_contains({lst(dims.NON_ENGLISH_SIGNALS)}, w)))"
    scripts = "".join(f"\\p{{{s}}}" for s in ("Arabic", "Armenian", "Bengali", "Cyrillic", "Devanagari", "Georgian", "Greek", "Han", "Hangul", "Hebrew", "Hiragana", "Katakana", "Thai"))
    acc = f"regexp_matches({t}, '[À-ʯ]')"
    return (
        f"(NOT regexp_matches({t}, '[{scripts}]') AND NOT (({no} >= 3 OR ({no} >= 2 AND {en} = 0) "
        f"OR ({acc} AND {no} >= 1 AND {en} = 0)) AND {en} < {no}))"
    )


def title_key(t: str) -> str:
    return f"trim(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def url_key(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace({u}, '^https?://', ''), '^www\\.', ''))"


def stable_id(x: str) -> str:
    codes = f"list_transform(list_filter(string_split({x}, ''), lambda ch: ch <> ''), lambda ch: unicode(ch)::BIGINT)"
    return f"lower(to_base(list_reduce(list_prepend(2166136261::BIGINT, {codes}), lambda h, k: (xor(h, k) * 16777619) & 4294967295), 36))"


def rating(key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(b)}" for k, b, _ in c.RATINGS) + " END"


def mentions(source: str, key: str, text: str, overrides: bool = True) -> str:
    """Distinct (key, country): every text against every term pattern."""
    amb = {k for k, _ in c.OVERRIDES} if overrides else set()
    rows = [(k, t) for k, t in c.GAZETTEER if k not in amb] + (list(c.OVERRIDES) if overrides else [])
    parts = []
    for country, term in rows:
        flag = "" if term.isupper() and 2 <= len(term) <= 3 else "(?i)"
        rx = flag + "(^|[^\\p{L}\\p{N}])" + term + "([^\\p{L}\\p{N}]|$)"
        parts.append(f"SELECT {key}, {q(country)} AS country FROM {source} WHERE regexp_matches({text}, {q(rx)})")
    return "(" + " UNION ".join(parts) + ")"


# --- JOIN-7 / CLUSTER-1 by comparing all pairs of distinct contents -------------------------
def containment(common: str, a: str, b: str) -> str:
    return f"({common} / least(len({a}), len({b}))::DOUBLE)"


def analysed(source: str = "art") -> str:
    step = tokens(source, "title", "tt")
    step = classify(step, "title", "tt", "category")
    step = token_set(step, "concat_ws(' ', title, description)", "cc")
    return (
        f"SELECT id, published_at, category, {identity('tt')} AS t, {identity('cc')} AS ctx FROM {step}"
    )


def pair_rule() -> str:
    """similarity of (l.t, l.ctx) and (r.t, r.ctx) joined on two common title tokens."""
    return """CASE WHEN n >= 3 AND phrase THEN 1.0::DOUBLE WHEN n >= 3 AND cont >= 0.38 THEN cont
      WHEN longs >= 2 AND cont >= 0.3 THEN cont
      WHEN n >= 2 AND cn >= 5 AND ccont >= 0.24 THEN greatest(cont, ccont) ELSE 0.0::DOUBLE END"""


def content_pairs(window_hours: int = 72, source: str = "art") -> str:
    """CTEs an, rep, post, met, sim, link: distinct contents and their links."""
    phr = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    return f"""an AS MATERIALIZED ({analysed(source)}),
 keyed AS MATERIALIZED (SELECT *, array_to_string(t, ' ') || '|' || array_to_string(list_sort(ctx), ' ') || '|' || category AS content FROM an),
 rep AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(id)) AS r, content, min(id) AS rid, any_value(category) AS category, any_value(t) AS t,
   any_value(ctx) AS ctx, list(published_at) AS times FROM keyed GROUP BY content),
 post AS MATERIALIZED (SELECT r, unnest(t) AS tok FROM rep),
 met AS MATERIALIZED (SELECT a.r AS ra, b.r AS rb, count(*) AS n, count(*) FILTER (length(a.tok) >= 7) AS longs
   FROM post a JOIN post b ON a.tok = b.tok AND a.r < b.r GROUP BY ALL HAVING count(*) >= 2),
 wide AS MATERIALIZED (SELECT ra, rb, n, longs, {containment('n', 'x.t', 'y.t')} AS cont, x.category = y.category AS same,
   list_has_any({phr.format('x.t')}, {phr.format('y.t')}) AS phrase,
   len(list_intersect(x.ctx, y.ctx)) AS cn, x.rid AS ida, y.rid AS idb, x.times AS ta, y.times AS tb,
   least(len(x.ctx), len(y.ctx)) AS cmin
   FROM met JOIN rep x ON x.r = ra JOIN rep y ON y.r = rb),
 sim AS MATERIALIZED (SELECT *, {pair_rule()} AS similarity FROM (SELECT *, cn / cmin::DOUBLE AS ccont FROM wide)),
 link AS MATERIALIZED (SELECT * FROM sim WHERE similarity > 0 AND (same OR similarity >= 0.6))"""


def cluster_labels(window_hours: int = 72, source: str = "art") -> str:
    """content_pairs + CTEs node, edge, label, assigned(id, cluster_id)."""
    us = window_hours * 3_600_000_000
    return f"""{content_pairs(window_hours, source)},
 node AS MATERIALIZED (SELECT row_number() OVER (ORDER BY published_at DESC, min(id)) AS node, r, published_at, min(id) AS first_id
   FROM keyed JOIN rep USING (content) GROUP BY r, published_at),
 alike AS (SELECT r FROM rep WHERE len(t) >= 3 OR len(list_filter(t, lambda w: length(w) >= 7)) >= 2 OR (len(t) >= 2 AND len(ctx) >= 5)),
 both_ways AS (SELECT ra, rb FROM link UNION ALL SELECT rb, ra FROM link UNION ALL SELECT r, r FROM alike),
 edge AS MATERIALIZED (SELECT DISTINCT x.node AS src, y.node AS dst FROM both_ways b JOIN node x ON x.r = b.ra JOIN node y ON y.r = b.rb
   WHERE x.node < y.node AND abs(epoch_us(x.published_at) - epoch_us(y.published_at)) <= {us}),
 seed AS (SELECT node FROM node WHERE node NOT IN (SELECT dst FROM edge)),
 reach AS (SELECT node AS s, node AS n FROM seed UNION SELECT reach.s, edge.dst FROM reach JOIN edge ON edge.src = reach.n),
 label AS MATERIALIZED (SELECT n AS node, min(s) AS label FROM reach GROUP BY n),
 assigned AS MATERIALIZED (SELECT k.id, k.published_at, k.category, rep.r, sd.first_id AS cluster_id
   FROM keyed k JOIN rep USING (content) JOIN node USING (r, published_at) JOIN label USING (node) JOIN node sd ON sd.node = label.label)"""
