"""DuckDB twins of the queries, over the same tables."""

from __future__ import annotations

from ..functions import html, normalize, urls
from ..functions import vocabulary as v
from ..operators import cleaning, dedup, frontier, index, statistics
from . import fixtures as fx
from . import queries as q
from .policy import POLICIES, Policy, synonym_map

ORACLES: dict[str, str] = {}


def text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], *names: str) -> str:
    def one(x) -> str:
        if isinstance(x, str) or x is None:
            return text(x)
        return f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({', '.join(names)}))"


def strings(words: list[str]) -> str:
    return "[" + ", ".join(map(text, words)) + "]"


def members(words: list[str]) -> str:
    return "(" + ", ".join(map(text, words)) + ")"


def case_map(x: str, pairs: dict[str, str]) -> str:
    return f"coalesce(map_extract_value(MAP {{{', '.join(f'{text(a)}: {text(b)}' for a, b in pairs.items())}}}, {x}), {x})"


BIG = "CAST(sum({}) AS BIGINT)".format
WORDS = f"regexp_extract_all(lower(coalesce(text, '')), '{dedup.WORDS}')"
HASH = r"sha256(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))))"
TITLE = r"trim(split_part(text, chr(10), 1))"
HITS = f"len(list_intersect({WORDS}, {strings(q.TOPIC)}))"

# ---- tokens and postings ----


def token_list(p: Policy, source: str = "coalesce(text, '')") -> str:
    pattern = normalize.token_pattern(p)
    if p.numbers:  # twice, as matches share digits
        once = r"regexp_replace({}, '(\d),(\d{{3}})(\D|$)', '\1\2\3', 'g')"
        source = once.format(once.format(source))
    return f"regexp_extract_all({source}, {text(pattern)})"


def term_list(p: Policy, source: str | None = None) -> str:
    t = source or token_list(p)
    if p.apostrophes == "possessive":
        t = f"[replace(replace(regexp_replace(x, '[''’]s$', ''), '''', ''), '’', '') for x in {t}]"
    if p.lowercase:
        t = f"[lower(x) for x in {t}]"
    if p.accents:
        t = f"[strip_accents(x) for x in {t}]"
    t = f"[x for x in {t} if length(x) BETWEEN 1 AND {normalize.MOST}]"
    if p.stopwords:
        t = f"[x for x in {t} if x NOT IN {members(list(p.stopwords))}]"
    if p.synonyms:
        t = f"[{case_map('x', p.synonyms)} for x in {t}]"
    if p.lemmas and p.reduction == "lemma":
        t = f"[{case_map('x', p.lemmas)} for x in {t}]"
    return t


def toks(policy: str = "A", docs: str = "documents") -> str:
    return f"toks AS (SELECT doc_id, source AS host, {term_list(POLICIES[policy])} AS terms FROM {docs})"


def post(policy: str = "A", docs: str = "documents") -> str:
    return f"""{toks(policy, docs)}, post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM toks) GROUP BY ALL),
dict AS (SELECT term, count(*) AS df, {BIG('tf')} AS cf FROM post GROUP BY term),
idfs AS (SELECT *, log10((SELECT count(*) FROM documents) / df) AS idf FROM dict),
norms AS (SELECT doc_id, CAST(CASE WHEN sum(w * w) > 0 THEN sqrt(sum(w * w)) ELSE 1 END AS FLOAT) AS norm FROM (SELECT doc_id, (1 + log10(tf)) * idf AS w FROM post JOIN idfs USING (term)) GROUP BY doc_id)"""


def joined(t: str) -> str:
    return f"array_to_string({t}, ' ')"


_NAMED = "SELECT source AS host, sha256(text || '#' || doc_id) AS hash FROM documents"
ORACLES["idx1"] = f"SELECT host, hash, row_number() OVER (ORDER BY host, hash) - 1 AS doc_id FROM ({_NAMED})"
_SUM = "CAST(sum(CAST(CAST('0x' || substr(h, {}, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR)".format
ORACLES["idx14"] = f"SELECT sha256({text(f'{index.VERSION}|0|{fx.POLICY_TEXT}|')} || count(*) || '|' || {_SUM(1)} || '|' || {_SUM(13)}) AS fingerprint FROM (SELECT {HASH} AS h FROM documents)"
ORACLES["idx2"] = f"WITH {post()} SELECT term, doc_id, tf FROM post"
ORACLES["idx3"] = f"WITH {toks()} SELECT doc_id, CAST(len(terms) AS BIGINT) AS n_tokens FROM toks"
ORACLES["idx6"] = f"WITH {post()} SELECT term, df, cf FROM dict"
ORACLES["idx7"] = f"WITH {post()} SELECT term, round(idf, 6) AS idf FROM idfs"
ORACLES["idx8"] = f"WITH {post()} SELECT doc_id, CAST(len(terms) AS BIGINT) AS n_tokens, round(CAST(coalesce(norm, 1) AS DOUBLE), 3) AS norm FROM toks LEFT JOIN norms USING (doc_id)"
GAPS = "gaps AS (SELECT *, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM post)"
ORACLES["idx9"] = f"WITH {post()}, {GAPS} SELECT term, doc_id, CAST(gap AS BIGINT) AS gap, doc_id AS decoded FROM gaps"


def varint(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} < {1 << (7 * k)} THEN {k}" for k in range(1, 9)) + " ELSE 9 END"


ORACLES["idx10"] = f"SELECT DISTINCT n, CAST({varint('n')} AS BIGINT) AS bytes FROM (SELECT CAST(1 AS BIGINT) << i AS n FROM range(40) t(i) UNION ALL SELECT (CAST(1 AS BIGINT) << i) - 1 FROM range(40) t(i))"
SIZES = f"""{GAPS}, pay AS (SELECT term, count(*) AS df, CAST(sum({varint('gap')} + {varint('tf')}) AS BIGINT) AS payload_bytes FROM gaps GROUP BY term),
sizes AS (SELECT *, CAST(1 + strlen(term) + {varint('df')} + {varint('payload_bytes')} AS BIGINT) AS entry_bytes FROM pay)"""
ORACLES["idx11"] = f"WITH {post()}, {SIZES} SELECT term, df, payload_bytes, entry_bytes FROM sizes"
_META = index.HEADER_BYTES + 4 + len(fx.POLICY_TEXT.encode())
ORACLES["idx12"] = f"""WITH {post()}, {SIZES}, h AS (SELECT count(*) AS hosts, CAST(4 + sum(strlen(host) + 2) AS BIGINT) AS hb FROM (SELECT DISTINCT host FROM toks)),
d AS (SELECT count(*) AS documents, {BIG('len(terms)')} AS tokens FROM toks), t AS (SELECT count(*) AS terms, {BIG('df')} AS postings, {BIG('entry_bytes')} AS db, {BIG('payload_bytes')} AS pb FROM sizes)
SELECT documents, terms, postings, tokens, hosts, CAST({index.HEADER_BYTES} AS BIGINT) AS at_meta, CAST({_META} AS BIGINT) AS at_hosts, {_META} + hb AS at_docs, {_META} + hb + 42 * documents AS at_dictionary,
{_META} + hb + 42 * documents + db AS at_postings, {_META} + hb + 42 * documents + db + pb AS bytes FROM h, d, t"""

# ---- cleaning ----

_RULES = cleaning.Rules.parse(fx.RULE_TEXT)


def any_of(column: str, patterns: list[str]) -> str:
    return f"regexp_matches(coalesce({column}, ''), {text('|'.join(f'(?:{p})' for p in patterns))}, 'i')"


META = f"meta AS (SELECT doc_id, source AS host, 'http://' || source || '/' || lang AS url, {TITLE} AS title, {HITS} AS hits FROM documents)"
KEEP = f"""(coalesce(host, '') IN {members(_RULES.hosts)} OR {any_of('url', _RULES.urls)} OR {any_of('title', _RULES.titles)}
 OR (coalesce(host, '') NOT IN {members(_RULES.except_hosts)} AND coalesce(hits, 0) >= {_RULES.min_hits} AND {any_of('title', _RULES.hit_titles)}))"""
ORACLES["cln1"] = f"SELECT class, pattern, CAST(least AS BIGINT) AS min_hits FROM {values([('host', 'src1', 0), ('host', 'src12', 0), ('url', '/es$', 0), ('title', chr(92) + 'b(the|der) ' + chr(92) + 'w+', 0), ('title_hits', 'on|en', 4), ('title_hits_except_host', 'src3', 0)], 'class', 'pattern', 'least')}"
ORACLES["cln2"] = f"WITH {META} SELECT doc_id FROM meta WHERE {KEEP}"
ORACLES["cln3"] = f"WITH {META} SELECT doc_id FROM meta WHERE doc_id % 7 <> 0 AND hits >= 3"


def sampled(limit: int) -> str:
    return f"""pos AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents), n AS (SELECT count(*) AS n FROM documents),
want AS (SELECT CAST(floor(CAST(i * n AS DOUBLE) / {limit}) AS BIGINT) AS position FROM range({limit}) t(i), n), samp AS (SELECT pos.* FROM pos, n WHERE n <= {limit} OR position IN (SELECT position FROM want))"""


ORACLES["cln4"] = f"WITH {META}, {sampled(400)} SELECT doc_id FROM samp JOIN meta USING (doc_id) WHERE {KEEP} AND hits >= 3"
ORACLES["src2"] = f"WITH {sampled(128)} SELECT position, doc_id FROM samp"
ORACLES["idx13"] = f"""WITH {META}, kept AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM meta WHERE {KEEP})), {post('D', 'kept')}
SELECT (SELECT count(*) FROM toks) AS documents, (SELECT {BIG('len(terms)')} FROM toks) AS tokens, count(*) AS terms, {BIG('df')} AS postings, (SELECT count(*) FROM documents) AS documents_before FROM dict"""

# ---- sources, sinks ----

ORACLES["src1"] = f"SELECT row_number() OVER (ORDER BY source, {HASH}, doc_id) - 1 AS position, source AS host, {HASH} AS hash, doc_id FROM documents"
ORACLES["src4"] = f"SELECT id, text FROM {values([(1, 'plain'), (2, 'é ü'), (3, 'bad ' + chr(0xFFFD) + ' byte'), (4, ''), (5, None)], 'id', 'text')}"
ORACLES["src3"] = "SELECT doc_id, source, lang, n_chars FROM documents"
ORACLES["src5"] = f"SELECT trim(x) AS line FROM {values([(x,) for x in fx.SEED_LINES], 'x')} WHERE trim(x) <> '' AND trim(x) NOT LIKE '#%'"
ORACLES["src6"] = f"SELECT trim(x) AS line FROM {values([(x,) for x in fx.LIST_LINES], 'x')} WHERE trim(x) NOT IN ('', chr(9)) AND trim(x) NOT LIKE '#%'"
_PAIRS = [("synonym", a, b) for b, a in synonym_map(v.SYNONYM_LINES).items()]
_PAIRS += [("entity", line.split("|")[0].strip(), p.strip()) for line in v.ENTITY_LINES for p in line.split("|")[1:]]
_PAIRS += [("lemma", "goal", "goals"), ("lemma", "score", "scored"), ("query", "q01", "one goal"), ("query", "q02", "two goals"), ("query", "q03", "three")]
ORACLES["src7"] = f"SELECT kind, head, item FROM {values(_PAIRS, 'kind', 'head', 'item')}"
ORACLES["src10"] = f"""WITH u AS {values([(x,) for x in fx.ROBOT_URLS], 'url')}, r AS {values(fx.ROBOT_RULES, 'origin', 'disallow', 'crawl_delay')},
p AS (SELECT url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM u)
SELECT url, NOT coalesce(bool_or(disallow <> '' AND starts_with(path, disallow)), false) AS allowed, greatest(1.5, coalesce(max(crawl_delay), 0)) AS delay FROM p LEFT JOIN r USING (origin) GROUP BY url"""

# ---- URLs and HTML ----

_SCHEME = "[a-zA-Z][a-zA-Z0-9+.-]*"


def host(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_extract({u}, '^{_SCHEME}://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^{_SCHEME}://[^/?#]*([^?#]*)', 1)"


def canonical(u: str) -> str:
    w = f"regexp_replace(trim({u}), '#.*$', '')"
    scheme = f"lower(regexp_extract({w}, '^({_SCHEME})://', 1))"
    port = f"regexp_extract(regexp_extract({w}, '^{_SCHEME}://([^/?]*)', 1), ':([0-9]*)$', 1)"
    flat = f"regexp_replace({path(w)}, '/{{2,}}', '/', 'g')"
    kept = f"array_to_string([p for p in string_split(regexp_extract({w}, '\\?(.*)$', 1), '&') if p <> '' AND NOT regexp_matches(lower(p), '^(?:{'|'.join(v.TRACKING)})')], '&')"
    whole = f"{scheme} || '://' || {host(w)} || CASE WHEN {port} IN ('', '80', '443') THEN '' ELSE ':' || {port} END || CASE WHEN {flat} = '' THEN '/' WHEN length({flat}) > 1 THEN rtrim({flat}, '/') ELSE {flat} END || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"
    return f"CASE WHEN {scheme} IN ('http', 'https') AND regexp_matches({host(w)}, '{urls.HOST}') THEN {whole} END"


def domain(h: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower({h}), ':.*$', ''), '^www\\.', '')"
    labels = f"string_split({bare}, '.')"
    two, three = f"array_to_string({labels}[-2:], '.')", f"array_to_string({labels}[-3:], '.')"
    return f"CASE WHEN len({labels}) <= 2 THEN {bare} WHEN {two} IN {members(v.TWO_LABEL_SUFFIXES)} THEN {three} ELSE {two} END"


def crawlable(u: str) -> str:
    suffixes = "|".join(x.replace(".", r"\.") for x in v.BINARY_SUFFIXES)
    return f"""({domain(host(u))} IN {members(q.ALLOWED)} AND split_part({host(u)}, '.', 1) NOT IN {members(v.SERVICE_HOSTS)} AND NOT regexp_matches(lower({path(u)}), '(?:{suffixes})$')
 AND NOT list_has_any(regexp_split_to_array(lower({path(u)}), '[/_.-]+'), {strings(v.OFF_TOPIC)}))"""


def priority(u: str, depth: str) -> str:
    p = f"lower({path(u)})"
    year = f"CAST(nullif(regexp_extract({p}, '{urls.YEAR}', 1), '') AS INT)"
    fresh = "|".join(v.FRESH)
    return f"""round(10 - 1.5 * {depth} + CASE WHEN regexp_matches({p}, '{fresh}') THEN 3 ELSE 0 END + CASE WHEN {year} IS NULL THEN 0 WHEN {q.YEAR} - {year} <= 1 THEN 3 ELSE greatest(-4.0, -0.4 * ({q.YEAR} - {year})) END
 - CASE WHEN length({p}) - length(replace({p}, '/', '')) > 7 THEN 1 ELSE 0 END, 6)"""


#: What the inline hrefs become against their pages.
_RESOLVED = ["HTTP://WWW.Example.com:80//a//b/?utm_source=x&q=1#f", "http://example.com:443/", "https://example.com/x/", "mailto:a@b.c", "http://localhost/", "https://example.com:8080/a", "https://cdn.example.org/x", "https://example.com/y?page=2", "https://example.com/d/rel/z", "http://user@example.com/q?&&a=1&gclid=2&b", "http://a.example.com/d", "https://example.com/p/q/f?x=/../y", "https://example.com/a/", "https://example.com/up"]
ORACLES["url1"] = f"SELECT page_id, {canonical('url')} AS canonical FROM (SELECT page_id, url FROM pages UNION ALL SELECT id, url FROM {values([(-i, u) for i, u in enumerate(_RESOLVED, 1)], 'id', 'url')})"
ORACLES["url2"] = f"SELECT host, {domain('host')} AS domain FROM (SELECT {host('url')} AS host FROM pages UNION SELECT h FROM {values([(h,) for h in fx.HOSTS], 'h')})"
ORACLES["url3"] = f"SELECT url, {crawlable('url')} AS crawlable FROM (SELECT url FROM pages UNION ALL SELECT u FROM {values([(u,) for u in fx.CRAWL_URLS], 'u')})"
ORACLES["url4"] = f"SELECT url, depth, CAST({priority('url', 'depth')} AS DOUBLE) AS priority FROM (SELECT url, CAST(page_id % 5 AS INT) AS depth FROM pages UNION ALL SELECT u, d FROM {values(fx.PRIORITY_URLS, 'u', 'd')})"
ORACLES["url5"] = f"SELECT DISTINCT {domain(host('url'))} AS domain FROM pages"


def unescape(x: str) -> str:
    for a, b in html.REFERENCES:
        x = f"replace({x}, {text(a)}, {text(b)})"
    return x


def bare(x: str) -> str:
    for tag in v.DROPPED_TAGS:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    return f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"


def page_text(x: str) -> str:
    flat = unescape(f"regexp_replace(regexp_replace({bare(x)}, '(?s)<!.*?>', '', 'g'), '(?s)<[^>]+>', chr(10), 'g')")
    lines = f"[trim(regexp_replace(y, '[ \\t\\r\\f\\v]+', ' ', 'g')) for y in string_split({flat}, chr(10))]"
    return f"array_to_string([y for y in {lines} if y <> ''], chr(10))"


HREFS = f"[regexp_replace(regexp_replace(x, {text(html.BEFORE_HREF)}, ''), {text(html.QUOTES)}, '', 'g') for x in regexp_extract_all(html, {text(html.HREF)})]"
ORACLES["html1"] = f"SELECT page_id, position, list[position + 1] AS href FROM (SELECT page_id, list, unnest(range(len(list))) AS position FROM (SELECT page_id, {HREFS} AS list FROM pages))"
ORACLES["html2"] = f"SELECT page_id, {bare('html')} AS kept FROM pages"
_TITLE = unescape(f"regexp_extract(html, '{html.TITLE}', 1)")
ORACLES["html3"] = f"SELECT page_id, substr(trim({_TITLE}), 1, 300) AS title FROM pages"
ORACLES["html4"] = f"SELECT page_id, {page_text('html')} AS text FROM pages"
_DATES = ", ".join(f"nullif(regexp_extract({bare('html')}, {text(p)}, 1), '')" for p in html.DATE_PATTERNS)
ORACLES["html5"] = f"SELECT page_id, substr(coalesce({_DATES}), 1, 40) AS published_at FROM {values(fx.DATED_PAGES, 'page_id', 'html')}"
ORACLES["txt1"] = f"SELECT doc_id, {joined(WORDS)} AS words FROM documents"
ORACLES["txt2"] = f"SELECT doc_id, CAST({HITS} AS BIGINT) AS hits FROM documents"
ORACLES["txt3"] = f"SELECT doc_id, depth, hits >= {frontier.MIN_HITS} AND length(text) >= {frontier.MIN_CHARS} AS stored, hits >= {frontier.MIN_HITS} OR depth <= 1 AS expands FROM (SELECT doc_id, text, doc_id % 4 AS depth, {HITS} AS hits FROM documents)"
_LINK = f"(regexp_extract(base, '^({_SCHEME}://[^/?#]*)', 1) || href)"
ORACLES["txt4"] = f"""WITH l AS (SELECT page_id, url AS base, CAST(page_id % 8 AS INT) + 1 AS depth, unnest({HREFS}[:{frontier.MAX_LINKS}]) AS href FROM pages WHERE page_id % 8 < {frontier.MAX_DEPTH}),
c AS (SELECT DISTINCT page_id, depth, {canonical(_LINK)} AS url FROM l)
SELECT page_id, url, {host('url')} AS host, depth, CAST({priority('url', 'depth')} AS DOUBLE) AS priority FROM c WHERE url IS NOT NULL AND {crawlable('url')}"""
ORACLES["snk1"] = f"""WITH p AS (SELECT page_id, {canonical('url')} AS url, {page_text('html')} AS text FROM pages), h AS (SELECT *, {HASH} AS hash FROM p)
SELECT page_id, url FROM h WHERE page_id IN (SELECT min(page_id) FROM h GROUP BY hash) AND page_id IN (SELECT min(page_id) FROM h GROUP BY url)"""
ORACLES["fmt1"] = f"""SELECT size, CASE WHEN size < 1048576 THEN printf('%.0fKB', size / 1024) WHEN size < 1073741824 THEN printf('%.1fMB', size / 1048576) ELSE printf('%.2fGB', size / 1073741824) END AS human,
printf('%02d:%02d:%02d', CAST(floor(s / 3600) AS INT), CAST(floor(s % 3600 / 60) AS INT), CAST(s % 60 AS INT)) AS clock FROM (SELECT size, CAST(floor(seconds) AS BIGINT) AS s FROM {values(fx.SIZES, 'size', 'seconds')})"""
ORACLES["fmt2"] = f"""WITH r AS (SELECT *, round(seconds) AS s FROM {values(fx.REPORT, 'id', 'b', 'seconds', 'n', 'base')})
SELECT id, CASE WHEN b IS NULL THEN '-' WHEN b >= 1e9 THEN printf('%.2f GB', b / 1e9) ELSE printf('%.1f MB', b / 1e6) END AS size,
CASE WHEN seconds IS NULL THEN '-' WHEN seconds < 90 THEN printf('%.1f s', seconds) WHEN floor(s / 60) >= 60 THEN printf('%d h %d min', CAST(floor(s / 3600) AS INT), CAST(floor(s / 60) % 60 AS INT)) ELSE printf('%d min %02d s', CAST(floor(s / 60) AS INT), CAST(s % 60 AS INT)) END AS time,
CASE WHEN n IS NULL THEN '-' ELSE replace(format('{{:,}}', CAST(n AS BIGINT)), ',', ' ') END AS number, CASE WHEN n IS NULL OR base = 0 THEN '-' ELSE printf('%.2f', n / base) || '×' END AS ratio,
CASE WHEN n IS NULL OR base = 0 THEN '-' WHEN abs((n - base) / base) < 0.005 THEN '≈ 0 %' ELSE printf('%+.0f', 100 * (n - base) / base) || ' %' END AS change FROM r"""

# ---- duplicates ----

ORACLES["dup1"] = f"SELECT doc_id, {HASH} AS hash FROM documents"
ORACLES["dup2"] = f"SELECT min(doc_id) AS doc_id, {HASH} AS hash FROM documents GROUP BY ALL"
_BITS = ", ".join(f"sum(CASE WHEN {h} & {1 << b} <> 0 THEN 1 ELSE -1 END) AS {h}{b}" for h in ("hi", "lo") for b in range(32))
_WORD = {h: " + ".join(f"CASE WHEN {h}{b} > 0 THEN {1 << b} ELSE 0 END" for b in range(32)) for h in ("hi", "lo")}
SIM = f"""sh AS (SELECT doc_id, md5(array_to_string(w[i : i + {dedup.SHINGLE - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, least(len(w) - {dedup.SHINGLE - 1}, {dedup.MOST_SHINGLES}) + 1)) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) >= {dedup.SHINGLE})),
bits AS (SELECT doc_id, {_BITS} FROM (SELECT doc_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS lo FROM sh) GROUP BY doc_id),
halves AS (SELECT doc_id, CAST({_WORD['hi']} AS BIGINT) AS hi, CAST({_WORD['lo']} AS BIGINT) AS lo FROM bits),
sim AS (SELECT doc_id, coalesce(CAST(CAST(hi - CASE WHEN hi >= 2147483648 THEN 4294967296 ELSE 0 END AS HUGEINT) * 4294967296 + lo AS BIGINT), 0) AS value FROM documents LEFT JOIN halves USING (doc_id))"""
#: Over whole texts.
WHOLE_SIM = SIM.replace(f"least(len(w) - {dedup.SHINGLE - 1}, {dedup.MOST_SHINGLES})", f"len(w) - {dedup.SHINGLE - 1}")
ORACLES["dup3_md5"] = f"WITH {SIM} SELECT doc_id, value FROM sim"
ORACLES["dup4"] = f"""WITH {SIM}, u AS (SELECT doc_id, CAST(value AS HUGEINT) + CASE WHEN value < 0 THEN CAST(18446744073709551616 AS HUGEINT) ELSE 0 END AS x FROM sim WHERE value <> 0)
SELECT doc_id, band, CAST((x // (CAST(1 AS HUGEINT) << CAST(16 * band AS INT))) % 65536 AS BIGINT) AS band_value FROM u, range(4) t(band)"""
ORACLES["dup5"] = f"WITH {SIM} SELECT a.doc_id, CAST(bit_count(xor(a.value, b.value)) AS BIGINT) AS distance FROM sim a JOIN sim b ON b.doc_id = a.doc_id + 1"
ORACLES["dup6"] = f"WITH {SIM} SELECT doc_id, value, CAST(CAST(value AS HUGEINT) + CASE WHEN value < 0 THEN CAST(18446744073709551616 AS HUGEINT) ELSE 0 END AS VARCHAR) AS unsigned FROM sim"
CLOSE = f"close AS (SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.value, b.value)) AS distance FROM sim a JOIN sim b ON a.doc_id < b.doc_id AND a.value <> 0 AND b.value <> 0 AND bit_count(xor(a.value, b.value)) <= {dedup.RADIUS})"
ORACLES["dup7"] = f"""WITH {WHOLE_SIM}, f AS (SELECT value, min(doc_id) AS id FROM sim WHERE value <> 0 GROUP BY value)
SELECT f.id AS a, doc_id AS b, CAST(0 AS BIGINT) AS distance FROM sim JOIN f USING (value) WHERE doc_id > f.id UNION ALL
SELECT a.id, b.id, CAST(bit_count(xor(a.value, b.value)) AS BIGINT) FROM f a JOIN f b ON a.id < b.id AND bit_count(xor(a.value, b.value)) <= {dedup.RADIUS}"""
ORACLES["dup8"] = f"""WITH RECURSIVE {WHOLE_SIM}, {CLOSE}, n AS (SELECT b AS id, list(a) AS smaller, row_number() OVER (ORDER BY b) AS i FROM close GROUP BY b),
k AS (SELECT CAST(0 AS BIGINT) AS i, (SELECT list(doc_id) FROM sim WHERE doc_id NOT IN (SELECT id FROM n)) AS kept UNION ALL
SELECT n.i, CASE WHEN list_has_any(n.smaller, k.kept) THEN k.kept ELSE list_append(k.kept, n.id) END FROM k JOIN n ON n.i = k.i + 1)
SELECT doc_id, list_contains((SELECT kept FROM k ORDER BY i DESC LIMIT 1), doc_id) AS kept FROM sim"""
ORACLES["dup9"] = f"""WITH p AS (SELECT page_id, {canonical('url')} AS url, {page_text('html')} AS text FROM pages), h AS (SELECT *, {HASH} AS hash, {HITS} AS hits FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY hash) AS first_text, min(page_id) OVER (PARTITION BY url) AS first_url FROM h)
SELECT page_id, CASE WHEN page_id % 19 = 0 THEN 'robots_denied' WHEN page_id % 17 = 0 THEN 'fetch_skipped' WHEN page_id % 13 = 0 THEN 'content_type' WHEN NOT coalesce({crawlable('url')}, false) THEN 'redirect_out'
WHEN hits < 1 OR length(text) < 500 THEN 'off_topic' WHEN page_id > first_text THEN 'near_duplicate' WHEN page_id > first_url THEN 'exact_duplicate' ELSE 'stored' END AS outcome FROM m"""

# ---- frontier ----

FRONT = f"front AS (SELECT page_id, url, {host('url')} AS host, depth, CAST({priority('url', 'depth')} AS DOUBLE) AS priority FROM (SELECT page_id, {canonical('url')} AS url, CAST(page_id % 5 AS INT) AS depth FROM pages))"
ORACLES["fro1"] = f"WITH {FRONT} SELECT min(page_id) AS page_id, url FROM front WHERE page_id % 3 <> 1 AND url NOT IN (SELECT url FROM front WHERE page_id % 3 = 0) GROUP BY url"
_BEST = "row_number() OVER (PARTITION BY host ORDER BY priority DESC, url)"
ORACLES["fro2"] = f"WITH {FRONT} SELECT url, host, priority, CAST(1 AS BIGINT) AS status, page_id FROM front QUALIFY {_BEST} <= 3"
ORACLES["fro3"] = f"WITH {FRONT}, u AS (SELECT url, any_value(priority) AS priority FROM front GROUP BY url) SELECT CAST(CASE WHEN priority > 5 THEN {frontier.DONE} ELSE {frontier.PENDING} END AS BIGINT) AS status, count(*) AS n FROM u GROUP BY 1"
ORACLES["fro4"] = f"WITH {FRONT} SELECT url, host, priority, CAST(({_BEST} - 1) * {frontier.DELAY} AS DOUBLE) AS start, page_id FROM front"
ORACLES["fro6"] = "SELECT doc_id, total FROM (SELECT doc_id, CAST(sum(strlen(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM documents) WHERE total >= 200000 ORDER BY doc_id LIMIT 1"

# ---- normalisation ----

ORACLES["nrm1"] = f"SELECT id, terms FROM {values([(1, 'manchester_city vs manchester_united'), (2, 'the champions_league'), (3, 'premier_league cup'), (4, 'brighton'), (5, 'spursy tottenham'), (6, '')], 'id', 'terms')}"
ORACLES["nrm2"] = f"SELECT id, terms FROM {values([(1, 'said Kaizer_Chiefs today'), (2, 'Old_Trafford roof'), (3, 'Alone here'), (4, 'End')], 'id', 'terms')}"
ORACLES["nrm3"] = f"SELECT id, terms FROM {values([(1, '2010-05-06'), (2, '2010-05-06'), (3, '2010-05-06'), (4, '13 13 2010'), (5, 'on 2011-09-03 and 2012-01-01'), (6, '32 May 2010')], 'id', 'terms')}"
_ONCE = r"regexp_replace({}, '(\d),(\d{{3}})(\D|$)', '\1\2\3', 'g')"
ORACLES["nrm4"] = f"SELECT id, {_ONCE.format(_ONCE.format('t'))} AS text FROM {values(fx.NUMBER_TEXTS, 'id', 't')}"
ORACLES["nrm5"] = f"SELECT doc_id, {joined(token_list(Policy('x', numbers=True)))} AS tokens FROM documents"
ORACLES["nrm6"] = f"SELECT id, replace(replace(regexp_replace(t, '[''’]s$', ''), '''', ''), '’', '') AS token FROM {values(fx.POSSESSIVES, 'id', 't')}"
_RAW = token_list(POLICIES["A"])
ORACLES["nrm7"] = f"SELECT doc_id, {joined(f'[lower(x) for x in {_RAW}]')} AS tokens FROM documents"
ORACLES["nrm8"] = "SELECT doc_id, strip_accents(text) AS plain FROM documents"
ORACLES["nrm9"] = f"SELECT doc_id, CAST(len([x for x in t if length(x) BETWEEN 1 AND {normalize.MOST}]) AS BIGINT) AS kept, CAST(len(t) AS BIGINT) AS tokens FROM (SELECT doc_id, {_RAW} AS t FROM documents)"
ORACLES["nrm10"] = f"SELECT doc_id, count(*) AS kept FROM (SELECT doc_id, lower(unnest({_RAW})) AS term FROM documents) WHERE term NOT IN {members(v.STOPWORDS)} GROUP BY doc_id"
ORACLES["nrm11"] = f"SELECT doc_id, {joined(term_list(Policy('x', synonyms=q.SYNONYMS), _RAW))} AS terms FROM documents"
ORACLES["nrm12"] = f"SELECT doc_id, {joined(term_list(Policy('x', reduction='lemma', lemmas=q.LEMMAS), _RAW))} AS terms FROM documents"
ORACLES["nrm13"] = f"SELECT word, stem FROM {values(fx.STEMS, 'word', 'stem')}"
for _p in "ABCDF":
    ORACLES[f"nrm15_{_p.lower()}"] = f"SELECT doc_id, {joined(term_list(POLICIES[_p]))} AS terms FROM documents"

# ---- search and evaluation ----

ASKED = "asked AS (SELECT item_id AS query_id, text FROM benchmark)"


def ranking(policy: str = "A", name: str = "") -> str:
    """CTEs that end in score{name} and top{name}."""
    body = f"""qt AS (SELECT query_id, term, count(*) AS tfq FROM (SELECT query_id, unnest({term_list(POLICIES[policy])}) AS term FROM asked) GROUP BY ALL),
vec AS (SELECT query_id, term, tfq, idf, (1 + log10(tfq)) * idf AS wq FROM qt JOIN idfs USING (term)), qn AS (SELECT query_id, sqrt(sum(wq * wq)) AS qn FROM vec GROUP BY query_id),
dots AS (SELECT query_id, doc_id, sum(wq * (1 + log10(tf)) * idf) AS dot FROM vec JOIN post USING (term) GROUP BY ALL),
score AS (SELECT query_id, doc_id, dot / (CAST(norm AS DOUBLE) * nullif(qn, 0)) AS score FROM dots JOIN norms USING (doc_id) JOIN qn USING (query_id) WHERE dot / (CAST(norm AS DOUBLE) * nullif(qn, 0)) > 0),
top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, doc_id) AS rank, doc_id, round(score, 5) AS score FROM score QUALIFY rank <= {q.K})"""
    whole = f"{post(policy)},\n{body}"
    if name:
        for cte in ("toks", "post", "dict", "idfs", "norms", "qt", "vec", "qn", "dots", "score", "top"):
            whole = whole.replace(f"{cte} AS (", f"{cte}{name} AS (").replace(f"FROM {cte})", f"FROM {cte}{name})").replace(f"FROM {cte} ", f"FROM {cte}{name} ").replace(f"JOIN {cte} ", f"JOIN {cte}{name} ")
    return whole


ORACLES["qry1"] = f"WITH {ASKED} SELECT query_id, {joined(term_list(POLICIES['D']))} AS terms FROM asked"
ORACLES["qry2"] = f"WITH {ASKED}, {ranking()} SELECT query_id, term, tfq, round(wq, 6) AS wq FROM vec"
ORACLES["qry3"] = f"WITH {ASKED}, {ranking()} SELECT query_id, doc_id, round(dot, 6) AS dot FROM dots"
ORACLES["qry4"] = f"WITH {ASKED}, {ranking()} SELECT query_id, doc_id, round(score, 5) AS score FROM score"
ORACLES["qry5"] = f"WITH {ASKED}, {ranking()} SELECT query_id, rank, doc_id, score FROM top"
ORACLES["qry6"] = f"WITH {ASKED}, {ranking()} SELECT query_id, rank, score, source AS host, substr({TITLE}, 1, 80) AS title, doc_id FROM top JOIN documents USING (doc_id) WHERE rank <= 3"
_X = "(n - 24)"
_E = f"greatest(CAST(floor(log2({_X} + 0.5)) AS INT) - 3, 0)"
_LEN = f"CASE WHEN n < 40 THEN CAST(n AS DOUBLE) ELSE 24 + floor({_X} / pow(2.0, {_E})) * pow(2.0, {_E}) END"
ORACLES["qry7"] = f"""WITH {ASKED}, {ranking()}, l AS (SELECT doc_id, len(terms) AS n FROM toks)
SELECT query_id, doc_id, round(sum(tfq * sqrt(tf) * pow(1 + ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 2) / sqrt({_LEN})), 4) AS score
FROM qt JOIN dict USING (term) JOIN post USING (term) JOIN l USING (doc_id) GROUP BY ALL"""
ORACLES["qry8"] = f"WITH {ASKED}, {ranking()} SELECT query_id, rank, source AS host, {HASH} AS hash, score FROM top JOIN documents USING (doc_id)"
ORACLES["qry9"] = "SELECT user_id % 20 AS system, event_type, round(median(value), 6) AS median_ms, round(max(value), 6) AS max_ms FROM events GROUP BY ALL"
SYSTEMS = f"{ASKED}, {ranking('A', 'a')}, {ranking('D', 'd')}, sys AS (SELECT 'A' AS system, * FROM topa UNION ALL SELECT 'D', * FROM topd)"
POOL = "pool AS (SELECT query_id, doc_id, string_agg(system || ':' || rank, ' ' ORDER BY system) AS ranks FROM sys GROUP BY ALL)"
ORACLES["eva1"] = f"WITH {SYSTEMS}, {POOL} SELECT query_id, doc_id, ranks FROM pool"
ORACLES["snk7"] = f"WITH {SYSTEMS}, {POOL} SELECT query_id, pool.doc_id, ranks, CAST(coalesce(CASE WHEN query_id = 3 THEN quality END, -1) AS BIGINT) AS relevant FROM pool LEFT JOIN labels ON labels.doc_id = pool.doc_id"
ORACLES["eva2"] = rf"SELECT doc_id, {TITLE} AS title, substr(trim(regexp_replace(substr(text, length(split_part(text, chr(10), 1)) + 2, 900), '\s+', ' ', 'g')), 1, 260) AS extract FROM documents"
_PREC = f"prec AS (SELECT system, query_id, coalesce(sum(quality), 0) / {q.K} AS p, CAST(sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unjudged FROM sys LEFT JOIN labels USING (doc_id) GROUP BY ALL)"
ORACLES["eva3"] = f"WITH {SYSTEMS}, {_PREC} SELECT system, query_id, round(p, 6) AS p_at_k, unjudged FROM prec"
ORACLES["eva4"] = f"WITH {SYSTEMS}, {_PREC} SELECT s.system, round(avg(coalesce(p, 0)), 6) AS mean_p FROM asked CROSS JOIN (VALUES ('A'), ('D')) s(system) LEFT JOIN prec ON prec.system = s.system AND prec.query_id = asked.query_id GROUP BY ALL"
_OVER = f"o AS (SELECT query_id, sum(CASE WHEN n = 2 THEN 1 ELSE 0 END) / {q.K} AS o, max(CASE WHEN n = 2 AND worst = 1 THEN 1 ELSE 0 END) AS same FROM (SELECT query_id, doc_id, count(*) AS n, max(rank) AS worst FROM sys GROUP BY ALL) GROUP BY query_id)"
ORACLES["eva5"] = f"WITH {SYSTEMS}, {_OVER} SELECT round(coalesce(avg(o), 0), 6) AS overlap, count(*) AS queries FROM o"
ORACLES["eva6"] = f"WITH {SYSTEMS}, {_OVER} SELECT CAST(coalesce(sum(same), 0) AS BIGINT) AS same_first, count(*) AS queries FROM o"
ORACLES["eva7"] = f"SELECT count(*) AS documents, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS equal, round(sum(CASE WHEN a = b THEN 1 ELSE 0 END) / count(*), 6) AS share FROM (SELECT {term_list(POLICIES['D'])} AS a, {term_list(POLICIES['B'])} AS b FROM documents)"
ORACLES["eva7_replacements"] = f"SELECT before, after, CAST(n AS BIGINT) AS n FROM {values([('b', 'x', 2), ('q', '', 1)], 'before', 'after', 'n')}"

# ---- statistics ----

_COUNTS = f"c AS (SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word)"
ORACLES["sta1"] = f"WITH {_COUNTS} SELECT word, n, (SELECT {BIG('n')} FROM c) AS total_words, (SELECT count(*) FROM c) AS distinct_words FROM c ORDER BY n DESC, word LIMIT 50"
ORACLES["sta2"] = "SELECT count(*) AS documents, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM documents"
ORACLES["sta3"] = "SELECT source AS host, count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source"
ORACLES["sta4"] = f"WITH {toks()} SELECT round(avg(n), 6) AS mean, round(median(n), 6) AS median, CAST(max(n) AS BIGINT) AS max, round(avg(CASE WHEN n < 100 THEN 1.0 ELSE 0.0 END) * 100, 6) AS short_pct FROM (SELECT len(terms) AS n FROM toks)"
ORACLES["sta5"] = f"WITH {post()} SELECT round(avg(CASE WHEN df = 1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS single_pct, round((SELECT sum(df) FROM (SELECT df FROM dict ORDER BY df DESC, term LIMIT 100)) / sum(df) * 100, 6) AS top_pct FROM dict"
ORACLES["sta5_top"] = f"WITH {post()} SELECT term, df, round(df / (SELECT count(*) FROM documents) * 100, 6) AS docs_pct FROM dict ORDER BY df DESC, term LIMIT 10"
ORACLES["sta6"] = f"""WITH {post()}, r AS (SELECT df, row_number() OVER (ORDER BY df DESC, term) AS rank FROM dict), n AS (SELECT log10(count(*)) AS l FROM dict)
SELECT rank, df FROM r WHERE rank IN (SELECT CAST(floor(pow(10, l * i / 59)) AS BIGINT) FROM n, range(60) t(i))"""
_NOISE = {
    "iso_date": "regexp_matches(term, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')",
    "year": f"regexp_matches(term, '{statistics.YEAR}')",
    "number_1_3": f"regexp_matches(term, '{statistics.NUMBER}') AND length(term) <= 3",
    "number_4_plus": f"regexp_matches(term, '{statistics.NUMBER}') AND length(term) > 3 AND NOT regexp_matches(term, '{statistics.YEAR}')",
    "letters_and_digits": r"regexp_matches(term, '[0-9]') AND regexp_matches(term, '\p{L}')",
    "df_1": "df = 1",
    "df_2": "df <= 2",
    "one_letter": r"regexp_matches(term, '^\p{L}$')",
}
_PART = "SELECT '{0}' AS category, CAST(sum(CASE WHEN {1} THEN 1 ELSE 0 END) AS BIGINT) AS terms, CAST(sum(CASE WHEN {1} THEN df ELSE 0 END) AS BIGINT) AS postings, CAST(sum(CASE WHEN {1} THEN b ELSE 0 END) AS BIGINT) AS bytes, count(*) AS t_all, sum(df) AS p_all, sum(b) AS b_all FROM z".format
ORACLES["sta7"] = f"""WITH {post()}, {SIZES}, z AS (SELECT term, df, entry_bytes + payload_bytes AS b FROM sizes)
SELECT category, terms, postings, bytes, round(100 * terms / t_all, 6) AS terms_pct, round(100 * postings / p_all, 6) AS postings_pct, round(100 * bytes / b_all, 6) AS bytes_pct FROM ({' UNION ALL '.join(_PART(k, t) for k, t in _NOISE.items())})"""
_CHANGE = "CASE WHEN n.{0} IS NULL OR b.{0} IS NULL OR b.{0} = 0 THEN '-' WHEN abs((n.{0} - b.{0}) / b.{0}) < 0.005 THEN '≈ 0 %' ELSE printf('%+.0f', 100.0 * ((n.{0} - b.{0}) / b.{0})) || ' %' END AS {0}".format
ORACLES["sta8"] = f"WITH s AS {values(fx.BUILDS, 'policy', 'terms', 'postings', 'bytes', 'seconds')}, w AS {values(statistics.PAIRS, 'policy', 'base')} SELECT w.policy, w.base, {', '.join(map(_CHANGE, ('terms', 'postings', 'bytes', 'seconds')))} FROM w LEFT JOIN s n ON n.policy = w.policy LEFT JOIN s b ON b.policy = w.base"
ORACLES["sta9"] = "WITH c AS (SELECT coalesce(event_type, 'total') AS outcome, count(*) AS n FROM events GROUP BY ROLLUP (event_type)) SELECT outcome, n, round(n / (SELECT max(n) FROM c), 6) AS share FROM c"
ORACLES["sta10"] = "WITH w AS (SELECT time_bucket(INTERVAL '10 minutes', ts) AS w, count(*) AS n FROM events GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS events, count(*) AS windows, round(CAST(sum(n) AS DOUBLE) / (count(*) * 600.0), 9) AS per_second FROM w"
ORACLES["sta11"] = "WITH w AS (SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS start, count(*) AS n FROM events GROUP BY 1) SELECT start, n, round(n / 300.0, 6) AS rate, round(n / 300.0 - lag(n / 300.0) OVER (PARTITION BY start // 86400 ORDER BY start), 6) AS change FROM w"
ORACLES["sta12"] = f"SELECT word FROM {values([(w,) for w in ('a', 'also', 'could', 'of', 's', 't', 'the')], 'word')}"
ORACLES["sta13"] = f"SELECT word, lemma FROM {values([('goals', 'goal'), ('scored', 'score'), ('children', 'child'), ('stories', 'story'), ('playing', 'play')], 'word', 'lemma')}"
