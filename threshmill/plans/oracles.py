"""DuckDB SQL of the engine's own queries, over the same tables."""

from __future__ import annotations

#: Fixed values, written out here so that the SQL shares no table with the code that it checks.
GIVEAWAYS = (
    r"\bignore (?:the |this |all )?\w+\b",
    r"\bouts?dated (?:practice|method|procedure|guideline|approach|standard|technique|protocol)\b",
    r"\b(?:rely (?:solely )?on|use (?:only )?)?\s*outdated\b",
    r"\bfocus(?:ing)? (?:solely|only|exclusively|primarily) on\b",
    r"\bfocus(?:ing)? on\b[^.,]{0,40}\b(?:solely|only|exclusively|primarily)\b",
    r"\bonly\s+(?:consider|focus|focus on|address|account for)\b",
    r"\b(?:disregard|dismiss|overlook|ignore) (?:the |any )?\w+",
    r"\bwithout (?:checking|consulting|reviewing|reading|considering|notifying|verifying|documenting|following|adhering to)\b",
    r"\bskip(?:ping)? (?:the |any )?\w+",
    r"\b(?:do|take) (?:nothing|no action|no further action)\b",
    r"\bavoid(?:ing)? (?:the |any |all )?\w+",
    r"\b(?:always|never)\s+(?:do|use|take|require|allow|perform|skip|consult|check)\b",
    r"\b(?:solely|exclusively|only) (?:based on|considering|relying on|on the basis of|on years of)\b",
    r"\bwithout (?:additional|further|prior|proper|written|formal)?\s*(?:consultation|consideration|approval|review|notification)\b",
    r"\bimmediately (?:discard|deposit|delete|remove|terminate)\b",
    r"\bblindly\b",
    r"\b(?:pretend|fake|falsify|fabricate)\b",
)
PRONOUNS = (
    "i", "i'm", "i've", "we", "we're", "our", "ours", "us", "my", "your",
)
SOURCE_NAMES = (
    r"(?i)\b(?:follow|per|according to|in accordance with|as per|comply with|adhere to)\s+(?:the\s+)?(?:[A-Z]{2,}\s+)?(?:guideline|standard|code|manual|handbook|publication|publication\s+\d+|policy\s+\d+|protocol\s+\d+|chapter\s+\d+|section\s+\d+|article\s+\d+|rule\s+\d+|§\s*\d+)\b",
    r"\b(?:AICPA|AORN|AANP|AACN|APNA|NFPA|ASHRAE|ANSI|IEEE|ACM|BCS|OSHA|CDC|BLS|FDA|EPA|FAA|NRC|NIH|HRSA|VA|DOL|DOT|HHS|IRS|SEC|FINRA|SHRM|ABA|NCBE)\s+(?:Guideline|Standard|Code|Manual|Handbook|Bulletin|Practice|Publication)\b",
    r"\bPer (?:the )?[A-Z][A-Za-z]+ (?:Guideline|Standard|Code|Manual|Handbook|Statement|Policy)\b",
)
SOURCE_PHRASES = (
    "per the ", "per aicpa", "per asme", "per nfpa", "per nist", "per osha", "per ieee", "per ncees", "per aota", "per apta", "per asha", "per avma",
    "per usp", "per nabp", "per irs", "per faa", "according to ", "following the ", "as required by ", "in accordance with ", "pursuant to ",
    "under the ",
)
SOURCE_PHRASES_AGAIN = (
    "per the ", "per aicpa", "per asme", "per nfpa", "per nist", "according to ", "following the ", "in accordance with ", "pursuant to ",
)
GENERIC_PHRASES = (
    "adhere to basic", "follow appropriate", "ensure compliance with", "use best practices", "consult an expert", "appropriate procedures",
    "applicable standards", "relevant guidelines",
)
WEAK_PUBLISHERS = (
    "reddit", "wikipedia", "blog", "medium.com", "quora", "answers.com", "wikihow", "wikia", "tumblr",
)
COMMUNITY_SENTENCES = (
    r"has\s+(?:any(?:one|body))\s+(?:ever\s+)?[^.?!]*[.?!]",
    r"have\s+any\s+of\s+(?:you|y'all)\s+[^.?!]*[.?!]",
    r"does\s+any(?:one|body)\s+[^.?!]*[.?!]",
    r"did\s+any(?:one|body)\s+[^.?!]*[.?!]",
    r"any(?:one|body)\s+(?:here|else|have|has|know|knows|dealt|encountered|experienced|familiar)\b[^.?!]*[.?!]",
    r"any\s+(?:tips|advice|thoughts|suggestions|help|insights|ideas|pointers|recommendations|guidance|input|feedback|experiences)\b[^.?!]*[.?!]",
    r"(?:would|i'd)\s+love\s+any\s+[^.?!]*[.?!]",
    r"can\s+some(?:one|body)\s+[^.?!]*[.?!]",
    r"if\s+any(?:one|body)\s+(?:has|knows|can)\s+[^.?!]*[.?!]",
    r"(?:i'm\s+)?looking\s+for\s+(?:advice|tips|input|help|thoughts|suggestions|guidance)[^.?!]*[.?!]",
    r"how\s+do\s+you\s+(?:\w+\s+)?(?:folks|guys|all|everyone|pros|experts|veterans)\b[^.?!]*[.?!]",
    r"how\s+does\s+everyone\s+[^.?!]*[.?!]",
)
ERROR_PHRASES = (
    "page you're looking for was not found", "page not found", "404 not found", "404 error", "http error 404", "this page doesn't exist",
    "this page has been removed", "this page is no longer available", "this page can't be found", "this page cannot be found", "the page has moved",
    "content not available", "access denied", "403 forbidden", "sorry, we couldn't find", "the requested url was not found",
    "page has been archived", "this content has been removed", "bad gateway", "502 bad gateway", "503 service unavailable",
    "500 internal server error", "server error", "no web page was found", "web page not available",
)
GREETING = r"(?i)^(?:[ \t\n\r\f\x0B]*(?:hey|hi|hello|greetings|howdy)[ \t\n\r\f\x0B]*(?:everyone|all|team|guys|folks|y'?all|there|community)?[ \t\n\r\f\x0B]*[,.!:]?[ \t\n\r\f\x0B]+)+"
NAVIGATION_WORDS = (
    "log in", "register", "membership", "search", "cookie", "sign up", "subscribe", "newsletter", "menu", "navigation", "currency", "cart",
    "checkout",
)
COMMUNITY_HOSTS = (
    "reddit.com", "stackexchange.com", "stackoverflow.com", "serverfault.com", "superuser.com", "askubuntu.com", "metafilter.com", "quora.com",
    "allnurses.com", "truckersreport.com", "electriciantalk.com", "plumbingzone.com", "plumbersforums.net", "hvac-talk.com", "weldingweb.com",
    "contractortalk.com", "garagejournal.com", "avsforum.com", "ycombinator.com", "bogleheads.org",
)
FEDERAL_ROOTS = (
    "nih.gov", "fda.gov", "dol.gov", "ssa.gov", "epa.gov", "ftc.gov", "doe.gov", "dot.gov", "faa.gov", "fra.gov", "fmcsa.gov", "fcc.gov", "fbi.gov",
    "ferc.gov", "treasury.gov", "usgs.gov", "nasa.gov", "nrc.gov", "uspto.gov", "uscis.gov", "gao.gov", "noaa.gov", "energy.gov", "labor.gov",
    "commerce.gov", "agriculture.gov", "fdic.gov", "sec.gov", "occ.gov", "cms.gov", "hud.gov", "va.gov", "nist.gov", "ed.gov", "doi.gov",
)
ORG_ALIASES = {
    "stacks.cdc.gov": "cdc.gov",
    "bankingjournal.aba.com": "aba.com",
    "myimanetwork.imanet.org": "imanet.org",
    "queue.acm.org": "acm.org",
    "cacm.acm.org": "acm.org",
    "dl.acm.org": "acm.org",
    "rpc.cfainstitute.org": "cfainstitute.org",
    "storage.aanp.org": "aanp.org",
    "amplify.asce.org": "asce.org",
    "pubs.asce.org": "asce.org",
    "cedb.asce.org": "asce.org",
    "asmedigitalcollection.asme.org": "asme.org",
    "dl.astm.org": "astm.org",
    "store.astm.org": "astm.org",
    "mcsdocs.astm.org": "astm.org",
    "news.awwa.org": "awwa.org",
    "dl.ashrae.org": "ashrae.org",
    "apps.asha.org": "asha.org",
    "pubs.asha.org": "asha.org",
    "archive.cdc.gov": "cdc.gov",
    "obis.osha.gov": "osha.gov",
    "pmc.ncbi.nlm.nih.gov": "ncbi.nlm.nih.gov",
    "research.aota.org": "aota.org",
}
STATE_SUFFIXES = (
    ".ca.gov", ".tx.gov", ".texas.gov", ".fl.gov", ".ny.gov", ".state.gov",
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def below(h: str, roots) -> str:
    return "(" + " OR ".join(f"{h} = {q(r)} OR suffix({h}, {q('.' + r)})" for r in roots) + ")"


HOST = r"regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), '^www[.]', '')"
HOSTS = f"hosts AS (SELECT page_id, url, {HOST} AS host FROM pages)"
ORG = "CASE " + " ".join(f"WHEN {below('host', (b,))} THEN {q(b)}" for b in ("cdc.gov", "bls.gov", "osha.gov")) + " " + " ".join(f"WHEN host = {q(a)} THEN {q(b)}" for a, b in ORG_ALIASES.items()) + " ELSE host END"
CAT1 = (
    "CASE WHEN org IN ('cdc.gov','bls.gov','osha.gov') THEN 'Federal .gov baseline (BLS/OSHA/CDC)' "
    f"WHEN suffix(org, '.gov') AND ({' OR '.join(f'suffix(org, {q(s)})' for s in STATE_SUFFIXES)}) THEN 'State licensing boards' "
    "WHEN suffix(org, '.gov') THEN 'Federal .gov (other)' "
    "WHEN suffix(org, '.edu') OR org = 'arxiv.org' OR regexp_matches(org, 'ncbi[.]nlm[.]nih[.]gov|biomedcentral[.]com|frontiersin[.]org|mdpi[.]com|biorxiv[.]org|medrxiv[.]org|europepmc[.]org') THEN 'Academic / .edu' "
    "ELSE 'Professional societies & associations' END"
)
CAT2 = (
    f"CASE WHEN {below('host', ('cdc.gov', 'bls.gov', 'osha.gov'))} THEN 'Federal .gov baseline (BLS/OSHA/CDC)' "
    "WHEN host IN ('arxiv.org','doi.org','ncbi.nlm.nih.gov','pmc.ncbi.nlm.nih.gov','pubmed.ncbi.nlm.nih.gov') OR regexp_matches(host, '^(ncbi|pmc|pubmed)[.]') OR suffix(host, '.edu') THEN 'Academic / .edu' "
    f"WHEN {below('host', FEDERAL_ROOTS)} THEN 'Federal .gov (other)' WHEN suffix(host, '.gov') THEN 'State licensing boards' ELSE 'Professional societies & associations' END"
)
COLLAPSE = lambda x: f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
CLEAN = COLLAPSE(r"regexp_replace(regexp_replace(regexp_replace(html, '<script[\s\S]*?</script>', '', 'gi'), '<style[\s\S]*?</style>', '', 'gi'), '<[^>]+>', ' ', 'g')")
WORDS = lambda x: f"(CASE WHEN {COLLAPSE(x)} = '' THEN 0 ELSE len(string_split({COLLAPSE(x)}, ' ')) END)"
CHROME = "html"
for _t in ("script", "style", "nav", "footer", "header", "aside"):
    CHROME = rf"regexp_replace({CHROME}, '<{_t}[\s\S]*?</{_t}>', '', 'gi')"
CHROME = rf"regexp_replace(regexp_replace({CHROME}, '<!--[\s\S]*?-->', '', 'g'), '<div[^>]*(?:sidebar|menu|breadcrumb|tag-cloud|related|advert|cookie)[^>]*>[\s\S]*?</div>', '', 'gi')"
NORMAL = lambda x: f"lower({COLLAPSE(x)})"
TOKENS = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
ITEMS = """
wide AS (SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS a, max(text) FILTER (WHERE turn = 1) AS b, max(text) FILTER (WHERE turn = 2) AS c, max(text) FILTER (WHERE turn = 3) AS d
  FROM conversations WHERE turn < 4 GROUP BY conv_id),
items AS (SELECT *, substr('ABCD', (conv_id % 4 + 1)::INT, 1) AS correct FROM wide)"""
RESPONSES = """
grid AS (SELECT (i // 3) AS m, i % 3 AS seed FROM range(9) t(i)),
responses AS (SELECT doc_id, quality, 'm' || m AS model, seed, substr('ABCD', (doc_id % 4 + 1)::INT, 1) AS correct,
  substr('ABCD', (((doc_id * (m + 2) + seed * doc_id % 7) % 5) % 4 + 1)::INT, 1) AS answer FROM labels, grid)"""
PER_QUESTION = RESPONSES + ", pq AS (SELECT doc_id, model, avg((answer = correct)::INT) AS acc FROM responses GROUP BY ALL)"
BY_PLACE = lambda letter: f"CASE {letter} WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d END"
_PRONOUN_LIST = "[" + ", ".join(map(q, PRONOUNS)) + "]"


def _structure() -> str:
    norm = {x: f"lower({COLLAPSE(f'trim(coalesce({x}, {q(str())}))')})" for x in "abcd"}
    out = ["WHEN trim(coalesce(a, '')) = '' OR a IS NULL OR b IS NULL OR c IS NULL OR d IS NULL THEN 'missing_or_invalid_fields'"]
    seen: list[str] = []
    for x in "abcd":
        up = x.upper()
        out += [
            f"WHEN trim({x}) = '' THEN 'option_{up}_empty'",
            f"WHEN suffix(trim({x}), '?') THEN 'option_{up}_trailing_question_mark'",
            f"WHEN list_has_any(list_transform(string_split({norm[x]}, ' '), lambda w: trim(w, '.,;:')), {_PRONOUN_LIST}) THEN 'option_{up}_forbidden_pronoun'",
        ]
        if seen:
            out.append(f"WHEN {norm[x]} IN ({', '.join(seen)}) THEN 'option_{up}_duplicate'")
        seen.append(norm[x])
    return "CASE " + " ".join(out) + " END"


def _giveaway(x: str) -> str:
    return f"regexp_matches({x}, {q('(?i)' + '|'.join(f'(?:{p})' for p in GIVEAWAYS))})"


def _has(x: str, phrases) -> str:
    return f"regexp_matches({x}, {q('|'.join(phrases))})"


_THIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[.*?\]\(.*?\)', '', 'g'), '\[.*?\]\(.*?\)', '', 'g'), 'https?://\S+', '', 'g'), '#{1,6}\s.*', '', 'g')"
_THIN = COLLAPSE(rf"regexp_replace({_THIN}, '[|_*\-=]+', ' ', 'g')")
_PAIRS = f"""
toks AS (SELECT source, doc_id, {TOKENS('text')} AS t FROM documents),
ex AS (SELECT source, doc_id, len(t) AS n, unnest(t) AS w FROM toks),
inter AS (SELECT x.source, x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS c FROM ex x JOIN ex y ON x.source = y.source AND x.w = y.w AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (SELECT source, a, b, c / (na + nb - c) AS jaccard FROM inter WHERE c / (na + nb - c) >= 0.6)"""
_VOICE_SENTENCES = "(?i)" + "|".join(f"(?:{p})" for p in COMMUNITY_SENTENCES)
_SHARE_LIMIT = """CASE WHEN (domain = 'cdc.gov' OR suffix(domain, '.cdc.gov')) AND substr(soc, 1, 2) NOT IN ('21','29','31')
  THEN (CASE WHEN substr(soc, 1, 2) IN ('17','19','33','37','39','45','47','49','51') THEN 0.15 ELSE -1 END)
  WHEN domain = 'bls.gov' THEN 0.10 ELSE 0.30 END"""

ORACLE_SQL: dict[str, str] = {
    "source_category_share": f"WITH {HOSTS}, o AS (SELECT {ORG} AS org FROM hosts), c AS (SELECT {CAT1} AS category FROM o) SELECT category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM c GROUP BY category",
    "source_category_v2": f"WITH {HOSTS} SELECT page_id, {CAT2} AS category FROM hosts",
    "url_host": f"WITH {HOSTS} SELECT page_id, host, ltrim(host, 'w.') AS stripped FROM hosts",
    "url_canonical": r"SELECT page_id, regexp_replace(url, '\?utm_[\s\S]*$', '') AS no_utm, string_split(url, '?')[1] AS no_query, regexp_replace(regexp_replace(url, '\?utm[\s\S]*$', ''), '#[\s\S]*$', '') AS no_fragment FROM pages",
    "url_org_rollup": f"WITH {HOSTS} SELECT {ORG} AS org, count(*) AS n FROM hosts GROUP BY 1",
    "url_classes": f"""WITH {HOSTS} SELECT page_id, regexp_matches(host, '^(docs|support|help|developer|learn)[.].*[.]com$') AS vendor,
      CASE WHEN {below('host', COMMUNITY_HOSTS)} THEN 'community' WHEN regexp_matches(host, '[.]gov$|[.]gov[.]|[.]mil$|[.]edu$|(^|[^a-z0-9_])who[.]int$|(^|[^a-z0-9_])servsafe[.]com$') OR suffix(host, '.org') THEN 'authoritative' ELSE 'other' END AS class,
      CASE WHEN contains(url, 'reddit.com') THEN 'reddit' WHEN regexp_matches(url, 'stackexchange[.]com|stackoverflow[.]com|serverfault[.]com|superuser[.]com|askubuntu[.]com') THEN 'stackexchange' ELSE 'other' END AS platform,
      regexp_matches(url, 'ieeexplore[.]ieee[.]org/iel[0-9]/') AS paywalled, regexp_extract(url, '/(?:articles/)?PMC([0-9]+)', 1) AS pmc FROM hosts""",
    "domain_allowlist": f"WITH {HOSTS}, roots AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') AS root FROM hosts WHERE contains(url, '.org/')) SELECT page_id, host FROM hosts WHERE EXISTS (SELECT 1 FROM roots WHERE host = root OR suffix(host, '.' || root))",
    "soc_codes": "WITH c AS (SELECT c_custkey, (c_custkey % 43 + 11) || '-' || (c_custkey % 9000 + 1000) AS code FROM customer) SELECT c_custkey, string_split(code, '-')[1] AS grp, CASE WHEN string_split(code, '-')[1] IN ('29','31') THEN 'HEALTH' ELSE string_split(code, '-')[1] END AS merged, code || '.00' AS lifted FROM c",
    "html_clean_v1": f"WITH b AS (SELECT page_id, {CLEAN} AS body FROM pages) SELECT page_id, body, {WORDS('body')}::INT AS n_words FROM b",
    "html_clean_v2": f"WITH b AS (SELECT page_id, {CHROME} AS x FROM pages) SELECT page_id, length(x)::INT AS n, md5(x) AS digest FROM b",
    "html_unescaped": f"SELECT page_id, replace(replace(replace(replace(replace({CLEAN}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS body FROM pages",
    "html_article_focus": rf"WITH a AS (SELECT page_id, html, regexp_extract_all(html, '(?i)<article[\s\S]*?</article>') AS x FROM pages) SELECT page_id, substr({COLLAPSE('CASE WHEN len(x) >= 1 THEN array_to_string(x[1:30], chr(10) || chr(10)) ELSE html END')}, 1, 60000) AS body FROM a",
    "html_title": rf"""WITH t AS (SELECT page_id, substr({COLLAPSE("regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)")}, 1, 200) AS title,
      trim(coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+(?:property|name)=["'']' || n || '["''][^>]+content=["'']([^"'']+)["'']', 1), ''), nullif(regexp_extract(html, '(?i)<meta[^>]+content=["'']([^"'']+)["''][^>]+(?:property|name)=["'']' || n || '["'']', 1), ''), nullif(regexp_extract(html, '(?i)<time[^>]+datetime=["'']([^"'']+)["'']', 1), ''), '')) AS raw,
      substr(trim(coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+(?:property|name)=["''](?:version|edition|dc\.version)["''][^>]+content=["'']([^"'']+)["'']', 1), ''), nullif(regexp_extract(html, '(?i)<meta[^>]+content=["'']([^"'']+)["''][^>]+(?:property|name)=["''](?:version|edition|dc\.version)["'']', 1), ''), '')), 1, 64) AS version
      FROM pages, (SELECT '(?:article:published_time|datePublished|publish_date|pubdate|date|dc\.date|dc\.date\.issued)' AS n))
      SELECT page_id, title, coalesce(nullif(regexp_extract(raw, '([0-9]{{4}}(?:-[0-9]{{2}}(?:-[0-9]{{2}})?)?)', 1), ''), substr(raw, 1, 32)) AS published, version FROM t""",
    "content_hash_exact_dedup": "SELECT min(doc_id) AS doc_id, substr(sha256(text), 1, 16) AS hash FROM documents GROUP BY 2",
    "last_wins_dedup": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1",
    "token_sets": f"SELECT doc_id, len({TOKENS('text')})::INT AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')))::INT AS n_long FROM documents",
    "normal_forms": f"SELECT item_id, {NORMAL('text')} AS normal, substr({NORMAL('text')}, 1, 120) AS head FROM benchmark",
    "doc_min_length_reason": "SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 1500 THEN 'too_short_' || length(coalesce(text, '')) END AS reason, CASE WHEN length(text) < 4000 THEN 1 WHEN length(text) < 9000 THEN 2 ELSE 3 END AS quota FROM documents",
    "thin_content": f"""WITH s AS (SELECT doc_id, lower(substr(text, 1, 2000)) AS head, {_THIN} AS s FROM documents)
      SELECT doc_id, CASE {' '.join(f'WHEN contains(head, {q(p)}) THEN {q(p)}' for p in ERROR_PHRASES)} END AS error,
      CASE WHEN length(s) < 500 THEN 'too_thin' WHEN length(s) - length(replace(s, '.', '')) < 3 THEN 'no_sentences' WHEN {' + '.join(f'contains(substr(lower(s), 1, 500), {q(w)})::INT' for w in NAVIGATION_WORDS)} >= 4 THEN 'navigation' END AS reason FROM s""",
    "voice_strip": rf"""WITH c AS (SELECT conv_id, turn, (CASE WHEN turn = 0 THEN 'Hello everyone, hi all! Has anybody ever seen this? ' ELSE '' END) || coalesce(text, '') AS text FROM conversations),
      s AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, {q(GREETING)}, ''), {q(_VOICE_SENTENCES)}, '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'), '[ \t\n\r\f\x0B]+([.,!?;:])', '\1', 'g')) AS t FROM c)
      SELECT conv_id, turn, upper(substr(t, 1, 1)) || substr(t, 2) AS clean FROM s""",
    "first_sentences": rf"""WITH c AS (SELECT conv_id, turn, {COLLAPSE('text')} AS t FROM conversations),
      m AS (SELECT *, length(regexp_extract(substr(t, 61, 220), '^([\s\S]*?)[.!?](?:\s|$)', 1)) AS k, regexp_matches(substr(t, 61, 220), '[.!?](\s|$)') AS hit FROM c)
      SELECT conv_id, turn, CASE WHEN length(t) <= 220 THEN t ELSE rtrim(trim(CASE WHEN hit THEN substr(t, 1, 61 + k) ELSE substr(t, 1, 220) END), '…') END AS head FROM m""",
    "title_terms": "SELECT c_nationkey, string_agg('\"' || c_mktsegment || '\"', ' OR ' ORDER BY c_mktsegment) AS terms FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY 1",
    "benchmark_contamination_quote": f"WITH i AS (SELECT item_id, substr({NORMAL('text')}, 1, 80) AS q FROM benchmark), d AS (SELECT doc_id, {NORMAL('text')} AS t FROM documents) SELECT doc_id, item_id FROM d JOIN i ON contains(t, q)",
    "near_dup_pairs_jaccard": f"WITH {_PAIRS} SELECT source, a, b, round(jaccard, 9) AS jaccard FROM pairs",
    "near_dup_greedy_keep": f"""WITH RECURSIVE {_PAIRS.strip()}, nodes AS (SELECT DISTINCT b AS k FROM pairs),
      numbered AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM nodes),
      fold AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS dropped
        UNION ALL SELECT f.i + 1, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.b = n.k AND NOT list_contains(f.dropped, p.a)) THEN list_append(f.dropped, n.k) ELSE f.dropped END FROM fold f JOIN numbered n ON n.i = f.i + 1)
      SELECT source, doc_id FROM documents WHERE doc_id NOT IN (SELECT unnest(dropped) FROM fold WHERE i = (SELECT max(i) FROM fold))""",
    "mcq_structure_lint": f"WITH {ITEMS} SELECT conv_id, {_structure()} AS reason FROM items",
    "giveaway_lint": f"""WITH {ITEMS}, x AS (SELECT conv_id, correct, {', '.join(f"{c} || CASE WHEN conv_id % 11 = 0 THEN ' Ignore the rules' WHEN conv_id % 13 = 0 THEN ' per the standard' ELSE '' END AS {c}" for c in 'abcd')} FROM items)
      SELECT conv_id, CASE {' '.join(f"WHEN correct <> '{c.upper()}' AND {_giveaway(f'coalesce({c}, {q(str())})')} THEN 'option_{c.upper()}_giveaway_phrase'" for c in 'abcd')} END AS giveaway,
      ({' OR '.join(f"regexp_matches(coalesce({BY_PLACE('correct')}, ''), {q(p)})" for p in SOURCE_NAMES)}) AS names_source FROM x""",
    "rewritten_option_lint": f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') || CASE turn WHEN 1 THEN ' according to the book' WHEN 2 THEN ' use best practices' ELSE '' END AS o FROM conversations)
      SELECT conv_id, turn, CASE WHEN length(trim(o)) < 8 THEN 'too_short' WHEN {_has('lower(o)', SOURCE_PHRASES)} THEN 'source' END AS first,
      CASE WHEN length(trim(o)) < 8 THEN 'too_short' WHEN {_has('lower(o)', GENERIC_PHRASES)} THEN 'generic' WHEN {_has('lower(o)', SOURCE_PHRASES_AGAIN)} THEN 'source' END AS again, {WORDS("o")}::INT AS n_words FROM c""",
    "option_length_imbalance": f"""WITH {ITEMS}, n AS (SELECT conv_id, correct, {', '.join(f"{WORDS(f'coalesce({c}, {q(str())})')} AS {c}" for c in 'abcd')} FROM items),
      m AS (SELECT conv_id, {BY_PLACE('correct')} AS own, (a + b + c + d - {BY_PLACE('correct')}) / 3.0 AS mean FROM n)
      SELECT conv_id, own > 0 AND mean > 0 AND (own < 0.6 * mean OR own > 1.75 * mean) AS imbalanced FROM m""",
    "source_authority": f"""WITH {HOSTS}, h AS (SELECT page_id, url, host, substr('ABCD', (page_id % 4 + 1)::INT, 1) AS tier, CASE WHEN page_id % 5 = 0 THEN 'The Blog' ELSE host END AS publisher FROM hosts)
      SELECT page_id, CASE WHEN tier = 'D' THEN 'tier' WHEN coalesce(url, '') = '' THEN 'missing source_url' WHEN coalesce(publisher, '') = '' THEN 'missing publisher'
      {' '.join(f"WHEN contains(lower(publisher || ' ' || host), {q(w)}) THEN {q(f"publisher/domain contains forbidden substring '{w}'")}" for w in WEAK_PUBLISHERS)} END AS reason FROM h""",
    "options_rendered": f"WITH {ITEMS} SELECT conv_id, md5('A) ' || a || ' | B) ' || b || ' | C) ' || c || ' | D) ' || d) AS digest FROM items WHERE d IS NOT NULL",
    "answer_letters": r"""WITH c AS (SELECT conv_id, turn, (CASE turn % 3 WHEN 0 THEN 'Answer: ' WHEN 1 THEN '(b) ' ELSE '' END) || coalesce(text, '') AS r FROM conversations), u AS (SELECT *, upper(trim(r)) AS s, upper(r) AS p FROM c)
      SELECT conv_id, turn, CASE WHEN regexp_matches(substr(s, 1, 1), '[A-F]') THEN substr(s, 1, 1) ELSE regexp_extract(s, '(?:^|[^A-Z0-9_])([A-F])(?:[^A-Z0-9_]|$)', 1) END AS x1,
      coalesce(nullif(regexp_extract(p, 'ANSWER[^A-F]*([A-F])', 1), ''), regexp_extract(p, '(?:^|[^A-Z])([A-F])(?:[^A-Z]|$)', 1)) AS x2,
      coalesce(nullif(regexp_extract(trim(r), '^[\s(\[]*([A-F])', 1), ''), regexp_extract(trim(r), '(?:^|[^A-Za-z0-9_])([A-F])(?:[^A-Za-z0-9_]|$)', 1)) AS x3 FROM u""",
    "verdict_tokens": r"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS r FROM conversations), s AS (SELECT *, regexp_replace(lower(r), '[^a-z_]', '', 'g') AS k FROM c)
      SELECT conv_id, turn, CASE WHEN contains(k, 'other_half') THEN 'other_half' WHEN contains(k, 'the') THEN 'the' WHEN contains(k, 'und') THEN 'und' WHEN contains(k, 'que') THEN 'que' ELSE 'other' END AS category,
      CASE WHEN contains(upper(r), 'YES') THEN true WHEN contains(upper(r), 'NO') THEN false END AS yes, CASE WHEN turn = 0 THEN 'DIRECT' ELSE 'ERROR' END AS direct,
      regexp_matches(r, '503|UNAVAILABLE|529|overloaded|rate_limit|RateLimitError|Timeout|timed out|ServerError|InternalServerError|502|504|ServiceUnavailable') AS transient FROM s""",
    "tolerant_json": "SELECT event_id, coalesce(json_valid(props) AND prefix(trim(props), '{'), false) AS parsed FROM events",
    "numeric_coercion": "WITH o AS (SELECT *, CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE (o_orderkey % 900 + 100) * 1000.0::DOUBLE END AS n FROM orders) SELECT o_orderkey, n AS number, round(coalesce(CASE WHEN n > 0 THEN n END, CASE WHEN o_totalprice > 0 THEN o_totalprice * 2080 END), 4) AS wage, round(1 / ln(2 + greatest(0, o_orderkey % 9)) + 0.5, 9) AS specificity, o_orderkey * 10000 + o_custkey * 100 + 3 AS score FROM o",
    "label_join_semi_anti": "SELECT source, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS labelled, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled FROM documents GROUP BY source",
    "label_default_fill": "SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "two_key_pivot_join": "WITH w AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem WHERE l_returnflag IN ('A','R') GROUP BY ALL), b AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F') SELECT l_orderkey, l_suppkey, round(a, 4) AS a_qty, round(r, 4) AS r_qty FROM b LEFT JOIN w USING (l_orderkey, l_suppkey)",
    "dictionary_lookup": "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = CASE WHEN c_nationkey = 24 THEN 23 ELSE c_nationkey END JOIN region ON n_regionkey = r_regionkey",
    "wide_votes": f"WITH {RESPONSES} SELECT doc_id, max(answer) FILTER (WHERE model = 'm0') AS m0, max(answer) FILTER (WHERE model = 'm1') AS m1, max(answer) FILTER (WHERE model = 'm2') AS m2 FROM responses WHERE seed = 0 GROUP BY doc_id",
    "items_by_seeds": "SELECT item_id, i AS seed, ((row_number() OVER (ORDER BY item_id, i) - 1) % 4)::INT AS shard FROM benchmark, range(3) t(i)",
    "pick_validation": "WITH pool AS (SELECT s_suppkey AS k, s_name, s_nationkey FROM supplier WHERE s_acctbal > 0), p AS (SELECT DISTINCT l_partkey AS p_partkey, l_suppkey AS k FROM lineitem) SELECT p_partkey, p.k, s_name IS NOT NULL AS valid, CASE WHEN s_name IS NULL THEN NULL WHEN s_nationkey < 8 THEN 'A' WHEN s_nationkey < 16 THEN 'C' ELSE 'B' END AS tier, coalesce(s_name, '#' || p.k) AS publisher FROM p LEFT JOIN pool USING (k)",
    "url_metadata_join": "SELECT page_id, length(string_split(url, '?')[1])::INT AS n FROM pages",
    "group_counts": "SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs, count(*) FILTER (WHERE n_chars > 1500) AS n_long, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source",
    "floor_having": "SELECT doc_id, source, lang FROM documents QUALIFY count(*) OVER (PARTITION BY source, lang) >= 12",
    "above_below_floor": f"WITH {HOSTS} SELECT host, arg_min(url, page_id) AS title, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'above' ELSE 'below' END AS side FROM hosts GROUP BY host",
    "frequency_maps": "WITH c AS (SELECT source, coalesce(lang, '') AS k, count(*) AS c FROM documents GROUP BY ALL) SELECT source, string_agg(k || '=' || c, ',' ORDER BY k) AS counts FROM c GROUP BY source",
    "publisher_concentration": """WITH p AS (SELECT lang, source, count(*) AS c FROM documents GROUP BY ALL), a AS (SELECT lang, sum(c)::BIGINT AS n, max(c) / sum(c) AS s, count(*) AS np FROM p GROUP BY lang), b AS (SELECT lang, count(DISTINCT n_chars) AS nd FROM documents GROUP BY lang)
      SELECT lang, n, round(s, 9) AS top_share, np AS n_publishers, nd AS n_documents, concat_ws('; ', CASE WHEN n < 130 THEN 'under_yield' END, CASE WHEN s > 0.7 THEN 'dominant_source' END, CASE WHEN np < 2 THEN 'one_publisher' END, CASE WHEN nd < 3 THEN 'few_documents' END) AS reasons FROM a JOIN b USING (lang)""",
    "rollup_totals": "SELECT coalesce(l_returnflag, '<TOTAL>') AS flag, coalesce(l_linestatus, '<TOTAL>') AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty, grouping_id(l_returnflag, l_linestatus)::INT AS gid FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "wage_share": "SELECT c_mktsegment, round_even(sum(c_acctbal) / sum(sum(c_acctbal)) OVER (), 4) AS share FROM customer GROUP BY 1",
    "accuracy_mean_se": f"WITH {PER_QUESTION} SELECT model, count(*) AS n, round(avg(acc), 9) AS mean, round(stddev_samp(acc) / sqrt(count(*)), 9) AS se FROM pq GROUP BY model",
    "weighted_accuracy": f"WITH {PER_QUESTION}, x AS (SELECT model, acc, length(text)::DOUBLE AS w FROM pq JOIN documents USING (doc_id)), m AS (SELECT model, sum(w * acc) / sum(w) AS mean, sum(w) AS sw, sum(w * w) AS sww FROM x GROUP BY model) SELECT model, round(any_value(mean), 9) AS mean, round(sqrt(sum(w / sw * (acc - mean) ** 2) * any_value(sww / (sw * sw))), 7) AS se FROM x JOIN m USING (model) GROUP BY model",
    "open_ended_rate": "WITH v AS (SELECT doc_id % 4 AS g, coalesce(CASE WHEN doc_id % 9 = 0 THEN NULL WHEN quality = 1 AND doc_id % 5 <> 0 THEN 1 ELSE 0 END, 0) AS x FROM labels) SELECT g, count(*) AS n, round(avg(x), 9) AS rate, round(stddev_samp(x) / sqrt(count(*)), 9) AS se FROM v GROUP BY g",
    "accuracy_matrix_pivot": f"WITH {PER_QUESTION}, x AS (SELECT source, model, acc FROM pq JOIN documents USING (doc_id)), w AS (SELECT source, count(*) AS n, avg(acc) FILTER (WHERE model = 'm0') AS m0, avg(acc) FILTER (WHERE model = 'm1') AS m1, avg(acc) FILTER (WHERE model = 'm2') AS m2 FROM x GROUP BY source) SELECT source, n, round(m0, 9) AS m0, round(m1, 9) AS m1, round(m2, 9) AS m2, round((m0 + m1 + m2) / 3, 9) AS row_mean FROM w WHERE n >= 3",
    "leaderboard": "SELECT event_type, count(*) AS n, round_even(100 * avg((value > 50)::INT), 2) AS accuracy, round(avg(value), 6) AS avg_value FROM events WHERE event_type <> 'error' GROUP BY 1",
    "label_distribution": "SELECT label, value, count(*) AS n FROM (SELECT 'quality' AS label, quality AS value FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY ALL",
    "count_histogram": "SELECT n_orders, count(*) AS n FROM (SELECT count(*) AS n_orders FROM orders GROUP BY o_custkey) GROUP BY 1",
    "supply_gap": "SELECT source, count(*) FILTER (WHERE lang = 'en') AS have, greatest(51 - count(*) FILTER (WHERE lang = 'en'), 0) AS gap FROM documents GROUP BY source",
    "top_n_per_group": "WITH r AS (SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders JOIN customer ON c_custkey = o_custkey) SELECT c_mktsegment, o_orderkey, rank FROM r WHERE rank <= 5 ORDER BY o_totalprice DESC, o_orderkey LIMIT 12",
    "primary_reserve_split": "WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer) SELECT c_nationkey, c_custkey, rank, CASE WHEN rank <= 3 THEN 'primary' ELSE 'reserve' END AS role FROM r WHERE rank <= 5",
    "round_robin_cap": "WITH z AS (SELECT lang, source, count(*) AS c FROM documents GROUP BY lang, source), s AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY c, source) AS p FROM z), t AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents) SELECT lang, source, doc_id FROM t JOIN s USING (lang, source) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY turn, p) <= 40",
    "k_groups_m_items": "WITH z AS (SELECT lang, source, count(*) AS c, min(doc_id) AS f FROM documents GROUP BY lang, source), s AS (SELECT lang, source FROM z QUALIFY row_number() OVER (PARTITION BY lang ORDER BY c DESC, f) <= 3) SELECT lang, source, doc_id FROM documents JOIN s USING (lang, source) QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) <= 4",
    "top_mid_bottom": "WITH s AS (SELECT source, round(avg(length(text)), 6) AS m FROM documents GROUP BY source), r AS (SELECT source, row_number() OVER (ORDER BY m DESC, source)::INT AS rank, count(*) OVER () AS t FROM s), p AS (SELECT source, rank, CASE WHEN rank <= 5 THEN 'top' WHEN rank > t - 5 THEN 'bottom' WHEN rank > (t - 5) // 2 AND rank <= (t - 5) // 2 + 5 THEN 'middle' END AS part FROM r) SELECT * FROM p WHERE part IS NOT NULL",
    "hashed_sample": "SELECT doc_id FROM documents ORDER BY md5(doc_id || '|7'), doc_id LIMIT 20",
    "share_gate": f"""WITH RECURSIVE {HOSTS}, h AS (SELECT (page_id % 6 * 6 + 17) || '-0000' AS soc, CASE WHEN page_id % 4 = 0 THEN 'www2.cdc.gov' WHEN page_id % 9 = 0 THEN 'bls.gov' ELSE host END AS domain, page_id FROM hosts),
      n AS (SELECT *, {_SHARE_LIMIT} AS lim, row_number() OVER (PARTITION BY soc ORDER BY page_id) AS i FROM h),
      fold AS (SELECT soc, 0::BIGINT AS i, []::VARCHAR[] AS held, NULL::BIGINT AS page_id, false AS accepted FROM (SELECT DISTINCT soc FROM n)
        UNION ALL SELECT soc, i, CASE WHEN ok THEN list_append(held, domain) ELSE held END, page_id, ok FROM (
          SELECT n.soc, n.i, f.held, n.domain, n.page_id, n.lim >= 0 AND NOT (len(f.held) >= 4 AND (len(list_filter(f.held, lambda d: d = n.domain)) + 1) / (len(f.held) + 1) > n.lim) AS ok FROM fold f JOIN n ON n.soc = f.soc AND n.i = f.i + 1))
      SELECT soc, page_id, accepted FROM fold WHERE page_id IS NOT NULL""",
    "budgeted_exit": "WITH r AS (SELECT event_id, coalesce(sum((event_type = 'purchase')::INT) OVER w, 0) AS a, coalesce(sum((event_type = 'error')::INT) OVER w, 0) AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id FROM r WHERE a < 10 AND f < 4",
    "consecutive_failure_cutoff": "WITH e AS (SELECT user_id, event_id, NOT (coalesce(value, 0) > 50) AS f FROM events), i AS (SELECT *, sum((NOT f)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS isl FROM e), r AS (SELECT *, sum(f::INT) OVER (PARTITION BY user_id, isl ORDER BY event_id) AS run FROM i), s AS (SELECT *, coalesce(sum((run >= 3)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM r) SELECT event_id FROM s WHERE stop = 0",
    "reserve_assignment": "WITH p AS (SELECT c_nationkey AS g, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer WHERE c_acctbal < 0), r AS (SELECT s_nationkey AS g, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier WHERE s_acctbal > 0) SELECT c_custkey, s_suppkey AS reserve_s_suppkey FROM p LEFT JOIN r USING (g, k)",
    "replaced_filter": "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "resume_state": "WITH e AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS kept, count(*) AS n, count(*) FILTER (WHERE value < 90) AS bad FROM events GROUP BY user_id) SELECT user_id, CASE WHEN user_id % 2 <> 0 AND kept >= 1 THEN 'done' WHEN n > 5 AND bad / n > 0.95 THEN 'retry_extract' WHEN n > 0 THEN 'skip' ELSE 'retry' END AS state FROM e",
    "thread_top_next_ratio": "WITH l AS (SELECT conv_id, list_sort(list(length(coalesce(text, ''))), 'DESC') AS b FROM conversations GROUP BY conv_id), t AS (SELECT conv_id, b[1]::INT AS top, coalesce(b[2], 0)::INT AS next, len(b) AS n_answers FROM l) SELECT conv_id, top, next, round(top / greatest(1, next), 9) AS ratio, n_answers, CASE WHEN top < 5 OR top / greatest(1, next) < 3 THEN 'no_consensus' ELSE 'consensus' END AS consensus FROM t",
    "consensus_mix": "WITH l AS (SELECT conv_id, list_sort(list(length(coalesce(text, ''))), 'DESC') AS b FROM conversations GROUP BY conv_id) SELECT CASE WHEN b[1] < 5 OR b[1] / greatest(1, coalesce(b[2], 0)) < 2 THEN 'no_consensus' ELSE 'consensus' END AS consensus, count(*) AS n FROM l GROUP BY 1",
    "agreement_filter": """WITH w AS (SELECT doc_id, list_transform([1, 3, 5], lambda i: ['AGREES','CONTRADICTS','OFF_TOPIC','UNCLEAR'][((doc_id * i + doc_id // 4) % 4 + 1)::INT]) AS v, substr('ABCDEF', (doc_id % 6 + 1)::INT, 1) AS c FROM labels), x AS (SELECT *, len(list_filter(v, lambda y: y = 'AGREES')) AS a FROM w),
      y AS (SELECT doc_id, c, CASE WHEN c IN ('E','F') OR doc_id % 5 = 0 OR list_contains(v, 'UNCLEAR') THEN 'drop' WHEN a = 0 THEN 'keep' WHEN a = 3 THEN 'relabel' ELSE 'drop' END AS decision FROM x) SELECT doc_id, decision, CASE WHEN decision = 'relabel' THEN 'E' ELSE c END AS answer FROM y""",
    "cosine_to_centroid": "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label) SELECT vec_id, round(list_cosine_similarity(v, c), 6) AS cosine FROM e JOIN c USING (label)",
    "event_windows_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": "WITH e AS (SELECT user_id, ts, event_id, coalesce((ts - lag(ts) OVER w > INTERVAL 30 MINUTE), true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM e) SELECT user_id, session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, session",
}

ORACLE_SQL |= {
    "bank_rows": f"WITH {ITEMS} SELECT 'u' || conv_id AS source_url, 'o' AS occupation, length(trim(coalesce(a, '')))::INT AS a, length(trim(coalesce(d, '')))::INT AS d, 'All of the above' AS option_E, 'None of the above' AS option_F, correct AS correct_answer FROM items",
    "coverage_map": f"WITH {HOSTS}, u AS (SELECT host, url, min(page_id) AS s, count(*) AS c FROM hosts GROUP BY ALL) SELECT host, sum(c)::BIGINT AS n_items, array_to_string(list(url ORDER BY s)[1:3], '; ') AS urls FROM u GROUP BY host",
    "bank_summary": f"WITH {HOSTS}, t AS (SELECT host, count(*) AS n FROM hosts GROUP BY host ORDER BY n DESC, host LIMIT 5) SELECT (SELECT count(*) FROM hosts) AS n_items, (SELECT count(DISTINCT host) FROM hosts) AS n_hosts, (SELECT string_agg(n || ':' || host, ',' ORDER BY n DESC, host DESC) FROM t) AS top",
    "forum_threads": "WITH p AS (SELECT conv_id, turn FROM conversations WHERE length(trim(text)) >= 40) SELECT conv_id, count(*)::INT AS n, coalesce(max(turn) FILTER (WHERE turn = 1), max(turn)) AS first_score FROM p GROUP BY conv_id HAVING count(*) >= 4",
    "gathered_sources": "WITH p AS (SELECT page_id % 9 AS o, string_split(url, '?')[1] AS url, page_id % 3 AS v, page_id AS s FROM pages), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY o, url ORDER BY v, s) = 1), c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o, v ORDER BY s, url) <= CASE WHEN v = 0 THEN 2 ELSE 9 END), n AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY v, s, url)::INT AS place FROM c) SELECT o AS occupation, url, place FROM n WHERE place <= 5",
    "checkpoint_repair": "SELECT o_orderkey % 200 AS row_id, max(o_orderkey) AS seq, arg_max(o_custkey, o_orderkey) AS o_custkey FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1",
    "page_links": """WITH m AS (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS u, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS n FROM pages) SELECT regexp_replace(trim(u), '/+$', '') AS url, min(trim(n)) AS name FROM m GROUP BY 1""",
    "feed_parsing": rf"""WITH b AS (SELECT item_id, {COLLAPSE("regexp_replace(text, '[<>&" + chr(34) + r"\\]', ' ', 'g')")} AS t FROM benchmark) SELECT 'http://arxiv.org/pdf/' || item_id || '.pdf' AS url, md5(substr(t, 1, 200)) AS title, length(substr(t, 1, 300))::INT AS n, 'arxiv.org' AS domain FROM b""",
    "recorded_provider": "WITH k AS (SELECT DISTINCT url FROM pages WHERE contains(url, '?')) SELECT page_id, CASE WHEN url IN (SELECT url FROM k) THEN length(url)::VARCHAR END AS answer, CASE WHEN regexp_matches(url, '/(?:articles/)?PMC[0-9]+') THEN 'efetch' WHEN page_id % 2 = 0 THEN 'premium,basic,direct' ELSE 'direct,proxy' END AS route FROM pages",
    "answer_sets": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'AC' ELSE 'ABCD' END AS letters, CASE turn % 3 WHEN 0 THEN 'AC' WHEN 1 THEN 'BD' ELSE '' END AS plausible, turn % 3 = 0 AS as_expected FROM conversations",
    "numbered_verdict_map": "SELECT doc_id, 2 AS n, CASE WHEN doc_id % 5 = 0 THEN 'YES' ELSE 'NO' END AS one, CASE WHEN doc_id % 3 = 0 THEN 'YES' ELSE 'NO' END AS two FROM labels",
    "thread_scores": "WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 0 ELSE turn END AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n, max(CASE WHEN conv_id % 2 = 0 THEN 0 ELSE turn END) OVER (PARTITION BY conv_id) AS m FROM conversations) SELECT conv_id, string_agg(CASE WHEN m = 0 THEN greatest(1, n - i + 1) ELSE score END, ',' ORDER BY i) AS scores FROM c GROUP BY conv_id",
    "difficulty_labels": f"WITH {RESPONSES}, n AS (SELECT doc_id, count(*) FILTER (WHERE answer = correct) AS n FROM responses WHERE model = 'm1' GROUP BY doc_id) SELECT doc_id, CASE WHEN n >= 3 THEN 'easy' WHEN n = 2 THEN 'medium' ELSE 'hard' END AS difficulty, CASE WHEN n = 3 THEN 'too_easy' WHEN n = 0 AND doc_id % 2 = 0 THEN 'too_hard' ELSE 'keep' END AS verdict FROM n",
    "jurisdiction_limits": "WITH b AS (SELECT item_id, lower(text || CASE WHEN item_id % 2 = 0 THEN ' texas' ELSE '' END) AS stem FROM benchmark) SELECT item_id, item_id % 3 <> 1 AND item_id % 5 <> 0 AND NOT (item_id % 3 = 0 AND (contains(stem, 'texas') OR contains(stem, '2019'))) AS unfixable FROM b",
    "merge_lint": f"""WITH {ITEMS}, p AS (SELECT conv_id, {WORDS("coalesce(a, '')")} AS n, conv_id % 9 = 0 AS bad, [{', '.join(f"trim(coalesce({c}, ''))" for c in 'abcd')}] AS o FROM items)
      SELECT conv_id, CASE WHEN list_contains(o, '') THEN 'missing_option' WHEN len(list_filter(o, lambda x: suffix(x, '?'))) > 0 THEN 'question_mark'
      WHEN len(list_filter(o, lambda x: regexp_matches(x, '(?i)(^|[^a-z0-9_])(i|i''m|i''ve|we|we''re|our|ours|us|my)([^a-z0-9_]|$)'))) > 0 THEN 'pronoun' WHEN n < 20 THEN 'short_stem' WHEN bad THEN 'bad_answer' END AS reason FROM p""",
    "event_windows_sliding": "SELECT h - INTERVAL (i) HOUR AS start, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS h FROM events WHERE event_type = 'error'), range(3) t(i) GROUP BY 1",
}
