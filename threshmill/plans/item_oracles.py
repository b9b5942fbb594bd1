"""DuckDB SQL of the queries of item_queries. Fixed values are written out here, not taken from the code that they check."""

from __future__ import annotations

from threshmill.plans.oracles import COLLAPSE, HOSTS, ITEMS, RESPONSES, WORDS, q
from threshmill.plans.oracles import ORACLE_SQL as OTHERS_SQL

LETTER = "substr('ABCD', (doc_id % 4 + 1)::INT, 1)"
OWN = f"CASE {LETTER} WHEN 'A' THEN doc_id % 4 = 0 WHEN 'B' THEN doc_id % 6 = 0 WHEN 'C' THEN doc_id % 10 = 0 ELSE doc_id % 14 = 0 END"
OTHERS = " OR ".join(f"({LETTER} <> '{x}' AND doc_id % {n} = 0)" for x, n in (("A", 4), ("B", 6), ("C", 10), ("D", 14)))
VERDICT = f"""v AS (SELECT doc_id, quality, doc_id % 5 IN (0, 4) AS aligned, doc_id % 3 <> 1 AS practical, doc_id % 7 <> 0 OR ({OWN}) AS entailed, doc_id % 11 = 0 OR {OTHERS} AS distractor_entailed,
  doc_id % 13 = 0 OR (doc_id % 9 = 0 AND {LETTER} <> 'A') AS distractor_partial, doc_id % 17 = 0 AS ambiguous, doc_id % 19 = 0 OR doc_id % 23 = 0 AS leaked,
  CASE WHEN doc_id % 19 = 0 THEN 'llm' WHEN doc_id % 23 = 0 THEN 'length_imbalance' END AS leak_signal, doc_id % 29 = 0 AS names_source, 'n' || doc_id AS notes FROM labels)"""
ELIMINABLE_OK = f"(doc_id % 25 = 0 OR NOT (doc_id % 15 = 0 OR (doc_id % 12 = 0 AND {LETTER} <> 'B')))"
SPECIFIC_OK = "(doc_id % 9 NOT IN (0, 1))"
SCORED = "s AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY length(coalesce(text, '')) DESC, turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations)"
#: The first 40 characters of the giveaway patterns, with a pattern that DuckDB can run.
GIVEAWAY_PATTERNS = (
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

SHARE_GATE = OTHERS_SQL["share_gate"]

ORACLE_SQL: dict[str, str] = {
    "verdict_normalisation": f"WITH {VERDICT} SELECT * EXCLUDE (quality) FROM v",
    "verdict_gates": f"SELECT doc_id, {ELIMINABLE_OK} AS eliminable_ok, {SPECIFIC_OK} AS specific_ok FROM labels",
    "quality_ladder": f"""WITH {VERDICT}, r AS (SELECT *, CASE WHEN quality <> 1 THEN 'weak_source' WHEN NOT entailed THEN 'not_entailed' WHEN NOT aligned THEN 'not_aligned' WHEN NOT practical THEN 'not_practical'
      WHEN distractor_entailed THEN 'distractor_entailed' WHEN ambiguous THEN 'ambiguous' WHEN doc_id % 31 = 0 THEN 'unfixable_jurisdiction' WHEN names_source THEN 'names_source' END AS core FROM v),
      f AS (SELECT *, coalesce(core, CASE WHEN NOT {SPECIFIC_OK} THEN 'generic_answer' WHEN NOT {ELIMINABLE_OK} THEN 'eliminable_distractor' END) AS reason FROM r)
      SELECT doc_id, CASE WHEN reason IS NOT NULL THEN NULL WHEN leaked OR distractor_partial THEN 'C' WHEN doc_id % 2 = 1 THEN 'A' WHEN doc_id % 3 = 0 THEN 'C' ELSE 'B' END AS tier, reason, core IS NOT NULL AS skipped FROM f""",
    "last_attempts": """WITH p(i, pass, most) AS (VALUES (0, '6b', 2), (1, '2a', 2), (2, '4', 2), (3, '5', 2), (4, '9', 2), (5, '8', 3)),
      a AS (SELECT doc_id, i, pass, most, t.t AS attempt, (doc_id * 7 + i * 3 + t.t * 5) % 4 = 0 AS ok FROM labels, p, range(5) t(t) WHERE t.t <= most)
      SELECT doc_id, pass, i AS step, coalesce(min(attempt) FILTER (WHERE ok), max(attempt)) AS tries, bool_or(ok) AS ok FROM a GROUP BY doc_id, pass, i""",
    "all_valid_override": f"SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'E' ELSE {LETTER} END AS correct, CASE doc_id % 4 WHEN 0 THEN 'same_thread_judged_wrong' ELSE 'hybrid_same_source+synth(' || (3 - doc_id % 4) || '/3)' END AS mix FROM labels",
    "assembled_items": """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, (turn + conv_id) % 4 <> 0 AS wrong, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations),
      w AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS j FROM t WHERE i > 0 AND wrong AND trim(text) <> '' QUALIFY j < 6),
      n AS (SELECT conv_id, count(*) AS n FROM w GROUP BY conv_id),
      k AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY md5(conv_id || '|wrong|' || j), text) AS place FROM w QUALIFY place <= 3),
      l AS (SELECT conv_id, x.letter, row_number() OVER (PARTITION BY conv_id ORDER BY md5(conv_id || '|letter|' || x.i), x.letter) - 1 AS place FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D')) x(i, letter)),
      s AS (SELECT DISTINCT t.conv_id, CASE WHEN c < 4 THEN 'too_few_responses' WHEN t.conv_id % 5 = 0 THEN 'consensus_reject' WHEN coalesce(n, 0) < 3 THEN 'not_enough_wrong(' || coalesce(n, 0) || ')' ELSE 'item' END AS status FROM t LEFT JOIN n USING (conv_id)),
      o AS (SELECT conv_id, 0 AS place, text FROM t WHERE i = 0 UNION ALL SELECT conv_id, place, text FROM k),
      m AS (SELECT l.conv_id, string_agg(o.text, '|' ORDER BY l.letter) AS all_options, max(l.letter) FILTER (WHERE l.place = 0) AS correct FROM l JOIN o USING (conv_id, place) GROUP BY l.conv_id)
      SELECT s.conv_id, status, CASE WHEN status = 'item' THEN correct END AS correct, md5(CASE WHEN status = 'item' THEN all_options ELSE '' END) AS options FROM s LEFT JOIN m USING (conv_id)""",
    "best_worst_picks": f"""WITH {SCORED}, p AS (SELECT conv_id, c, max(turn) FILTER (WHERE i = 0) AS best, max(turn) FILTER (WHERE i = c - 1) AS worst, max(turn) FILTER (WHERE i = c // 3) AS first_third, max(turn) FILTER (WHERE i = c // 2) AS middle,
      max(n) FILTER (WHERE i = 0) AS top, max(n) FILTER (WHERE i = c - 1) AS low FROM s GROUP BY conv_id, c)
      SELECT conv_id, CASE WHEN c >= 4 THEN best END AS best, CASE WHEN c >= 4 THEN worst END AS worst, CASE WHEN c >= 4 THEN first_third END AS first_third, CASE WHEN c >= 4 THEN middle END AS middle, c >= 4 AND 3 * low <= top AS clear_worst FROM p""",
    "several_correct": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'AC' ELSE 'ABD' END AS letters FROM labels WHERE doc_id % 3 <> 1",
    "reply_blocks": "SELECT item_id, 'first ' || item_id AS m1, 'second goes on ' || item_id AS m2, NULL::VARCHAR AS m3, 'last' AS m4, 'one ' || item_id AS lA, NULL::VARCHAR AS lB, 'four' AS lD FROM benchmark",
    "pick_enrichment": f"""WITH {HOSTS}, p AS (SELECT page_id, host, 'n' || page_id % 50 AS name FROM hosts), a AS (SELECT name, host, min(page_id) % 12 AS rel FROM p WHERE page_id % 3 = 0 GROUP BY ALL), b AS (SELECT DISTINCT name, host, TRUE AS hit FROM p WHERE page_id % 3 = 1),
      j AS (SELECT p.*, CASE WHEN page_id % 9 <> 0 THEN page_id % 9 ELSE coalesce(a.rel, 99) END AS rel, a.name IS NOT NULL AS in_a, coalesce(b.hit, FALSE) AS in_b FROM p LEFT JOIN a USING (name, host) LEFT JOIN b USING (name, host))
      SELECT page_id, 'org_' || lpad((page_id % 9 + 1)::VARCHAR, 6, '0') || '_111021' AS org_id, CASE WHEN in_a THEN 'onet_per_soc_associations' WHEN in_b THEN 'onet_full_xlsx' ELSE 'unknown' END AS source_system, CASE WHEN rel > 5 THEN 'national' ELSE 'specialist' END AS category,
      round(1 / ln(2 + rel) + CASE WHEN contains(host, 'senior') OR (length(string_split(host, '.')[1]) > 4 AND length(host) > 0) THEN 0.1 ELSE 0 END, 4) AS org_specificity FROM j""",
    "diagnostic_flags": f"""WITH x AS (SELECT doc_id % 150 AS k, coalesce(source, '') AS p, doc_id % 4 AS u, doc_id % 11 = 0 AS a, {LETTER} AS l FROM documents), n AS (SELECT k, count(*) AS n, count(DISTINCT p) AS np, count(DISTINCT u) AS nu, count(*) FILTER (WHERE a) AS na FROM x GROUP BY k),
      tp AS (SELECT k, max(c) AS tp FROM (SELECT k, p, count(*) AS c FROM x GROUP BY ALL) GROUP BY k), tl AS (SELECT k, max(c) AS tl FROM (SELECT k, l, count(*) AS c FROM x GROUP BY ALL) GROUP BY k)
      SELECT k, n, array_to_string(list_filter([CASE WHEN n < 5 THEN 'under_5_items' END, CASE WHEN tp / n > 0.5 AND n >= 4 THEN 'single_publisher_dominant' END, CASE WHEN np < 2 AND n >= 3 THEN 'only_one_publisher' END, CASE WHEN nu < 2 AND n >= 3 THEN 'only_one_source_document' END,
      CASE WHEN nu < 3 AND n >= 5 THEN 'under_three_source_documents' END, CASE WHEN na = 0 THEN 'only_tier_B_C' END, CASE WHEN tl / n > 0.4 AND n >= 5 THEN 'answer_letter_imbalanced' END], lambda f: f IS NOT NULL), ',') AS flags FROM n JOIN tp USING (k) JOIN tl USING (k)""",
    "top_up": """WITH s AS (SELECT c_nationkey AS g, c_custkey AS slot, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer WHERE c_acctbal < -900), w AS (SELECT g, count(*) AS wanted FROM s GROUP BY g),
      r AS (SELECT s_nationkey AS g, s_suppkey, -s_acctbal AS r, s_suppkey % 30 >= 15 AS good, coalesce(sum((s_suppkey % 30 >= 15)::INT) OVER (PARTITION BY s_nationkey ORDER BY -s_acctbal, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM supplier),
      t AS (SELECT r.*, b < coalesce(wanted, 0) AS tried FROM r LEFT JOIN w USING (g)), one AS (SELECT t.g, s.slot, s_suppkey, 1 AS phase FROM t JOIN s ON s.g = t.g AND s.k = t.b + 1 WHERE tried AND good),
      two AS (SELECT g, NULL AS slot, s_suppkey, 2 AS phase, row_number() OVER (ORDER BY g, r, s_suppkey) AS n FROM t WHERE NOT tried AND good)
      SELECT * FROM one UNION ALL SELECT * EXCLUDE (n) FROM two WHERE n <= greatest(40 - 2 - (SELECT count(*) FROM one), 0)""",
    "top_up_floor": f"WITH {ITEMS} SELECT conv_id, conv_id % 40 AS k FROM items WHERE conv_id % 7 <> 0 QUALIFY count(*) OVER (PARTITION BY conv_id % 40) >= 4",
    "quota_buckets": f"""WITH {SCORED}, c AS (SELECT conv_id, conv_id % 7 AS g, c >= 4 AND 3 * max(n) FILTER (WHERE i = c - 1) <= max(n) FILTER (WHERE i = 0) AS clear FROM s GROUP BY conv_id, c),
      b AS (SELECT g, 'single' AS bucket, conv_id FROM c WHERE conv_id % 3 <> 0 UNION ALL SELECT g, 'multi', conv_id FROM c WHERE conv_id % 4 = 1 UNION ALL SELECT g, 'sjt', conv_id FROM c WHERE clear)
      SELECT g, bucket, row_number() OVER (PARTITION BY g, bucket ORDER BY md5(conv_id::VARCHAR)) AS place, conv_id FROM b QUALIFY place <= 2""",
    "both_source_kinds": """WITH p AS (SELECT page_id % 41 AS task, page_id % 3 AS kind, page_id, url, length(coalesce(html, '')) AS n, row_number() OVER (PARTITION BY page_id % 41, page_id % 3 ORDER BY page_id, url) AS r FROM pages WHERE page_id % 3 < 2),
      f AS (SELECT * FROM p WHERE r <= 4 AND n > 500 QUALIFY row_number() OVER (PARTITION BY task, kind ORDER BY r) = 1)
      SELECT a.task, a.url AS community_url, b.url AS authoritative_url FROM f a JOIN f b ON a.task = b.task AND a.kind = 0 AND b.kind = 1""",
    "gap_backfill": r"""WITH p AS (SELECT page_id, page_id % 23 AS k, regexp_replace(url, '\?utm_source=openai.*', '') AS u FROM pages), h AS (SELECT * FROM p WHERE page_id % 5 = 0), g AS (SELECT k, greatest(6 - (SELECT count(*) FROM h WHERE h.k = x.k), 0) AS gap FROM (SELECT DISTINCT k FROM p) x),
      c AS (SELECT * FROM p WHERE page_id % 5 <> 0 AND u NOT IN (SELECT u FROM h) QUALIFY row_number() OVER (PARTITION BY u ORDER BY page_id, k) = 1)
      SELECT k, gap, row_number() OVER (PARTITION BY k ORDER BY page_id, u) AS place, u FROM c JOIN g USING (k) WHERE gap > 0 QUALIFY place <= gap""",
    "academic_sources": """WITH p AS (SELECT CASE page_id % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'pmc' ELSE 'crossref' END AS source, (page_id % 4 * 6 + 11) || '-0000' AS soc, string_split(url, '?')[1] AS url FROM pages),
      f AS (SELECT * FROM p WHERE source = 'crossref' OR (source = 'arxiv' AND soc IN ('17-0000', '29-0000')) OR (source = 'pmc' AND substr(soc, 1, 2) IN ('29', '31')))
      SELECT soc, url, arg_min(source, CASE source WHEN 'arxiv' THEN 0 WHEN 'pmc' THEN 1 ELSE 2 END) AS source FROM f GROUP BY soc, url""",
    "venue_texts": "SELECT doc_id, least(length(text), 4000) AS n FROM documents WHERE length(coalesce(text, '')) >= CASE WHEN doc_id % 3 = 2 THEN 100 ELSE 300 END",
    "fallback_sources": """WITH x AS (SELECT doc_id, doc_id % 90 AS g, doc_id % 7 % 3 AS level, length(coalesce(text, '')) AS n FROM documents), l AS (SELECT * FROM x WHERE n >= CASE level WHEN 0 THEN 800 WHEN 1 THEN 500 ELSE 200 END),
      c AS (SELECT g, count(*) FILTER (WHERE level = 0) AS c0, count(*) FILTER (WHERE level = 1) AS c1 FROM l GROUP BY g)
      SELECT doc_id, g, level FROM l JOIN c USING (g) WHERE level = 0 OR (level = 1 AND c0 < 3) OR (level = 2 AND c0 + CASE WHEN c0 < 3 THEN c1 ELSE 0 END < 4)""",
    "source_tiers": f"""WITH {HOSTS}, h AS (SELECT page_id, CASE WHEN page_id % 20 = 0 THEN 'cdc.gov' ELSE host END AS domain, page_id % 2 AS soc FROM hosts), b AS (SELECT soc, domain, min(page_id) AS p FROM h WHERE page_id % 7 = 0 GROUP BY ALL), a AS (SELECT soc, domain, min(page_id) AS p FROM h WHERE page_id % 5 = 0 GROUP BY ALL)
      SELECT h.page_id, CASE WHEN h.domain IN ('cdc.gov', 'bls.gov', 'osha.gov') OR b.p IS NOT NULL THEN 'A' WHEN a.p IS NOT NULL THEN CASE WHEN a.p % 2 = 0 THEN 'A' ELSE 'B' END WHEN suffix(h.domain, '.com') THEN 'C' ELSE 'B' END AS tier,
      CASE h.domain WHEN 'cdc.gov' THEN 'U.S. Centers for Disease Control and Prevention' WHEN 'bls.gov' THEN 'U.S. Bureau of Labor Statistics' WHEN 'osha.gov' THEN 'U.S. Occupational Safety and Health Administration' ELSE coalesce('board ' || b.p, 'assoc ' || a.p, h.domain) END AS publisher
      FROM h LEFT JOIN b ON b.soc = h.soc AND b.domain = h.domain LEFT JOIN a ON a.soc = h.soc AND a.domain = h.domain""",
    "prefix_join": "SELECT s_suppkey, p_partkey FROM supplier JOIN part ON starts_with('11-' || lpad((p_partkey % 500)::VARCHAR, 4, '0') || '.0' || (p_partkey % 3), '11-' || lpad((s_suppkey * 3 % 500)::VARCHAR, 4, '0'))",
    "title_matches": "WITH t AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part) SELECT 'STEEL' AS name, p_partkey FROM t WHERE contains(t, 'steel') UNION ALL SELECT 'nothing Brass', p_partkey FROM t WHERE contains(t, 'brass')",
    "query_product": f"""WITH {HOSTS}, d AS (SELECT DISTINCT page_id % 25 AS n_nationkey, host FROM hosts), j AS (SELECT n_name AS o, host AS d, row_number() OVER (PARTITION BY n_name ORDER BY host) AS r, count(*) OVER (PARTITION BY n_name) AS c FROM d JOIN nation USING (n_nationkey)),
      t(i, w) AS (VALUES (0, 'standard'), (1, 'guideline'), (2, 'manual')), m AS (SELECT o, 'site:' || d || ' "' || o || '" "' || w || '"' AS query, r, i FROM j, t WHERE i < least(greatest(30 // c, 1), 3))
      SELECT o AS occupation, row_number() OVER (PARTITION BY o ORDER BY r, i) AS place, query FROM m QUALIFY place <= 30""",
    "strict_lookup": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "title_wages": "SELECT p_brand, round(avg(coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_size * 1000.0 END, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 2080.0 END)::DOUBLE), 6) AS wage FROM part GROUP BY p_brand",
    "thread_urls": r"""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://www.reddit.com/r/AskReddit/comments/' || page_id WHEN 1 THEN 'https://reddit.com/r/Plumbing/comments/' || page_id || '/' WHEN 2 THEN 'https://diy.stackexchange.com/questions/' || page_id WHEN 3 THEN 'https://www.reddit.com/r/tifu/' ELSE url END AS url FROM pages)
      SELECT page_id, CASE WHEN contains(url, 'reddit.com/r/') AND contains(url, '/comments/') THEN 'reddit' WHEN regexp_matches(url, '\.stackexchange\.com/questions/|(stackoverflow|serverfault|superuser|askubuntu)\.com/questions/') THEN 'stackexchange' END AS kind, regexp_extract(url, 'reddit\.com/r/([^/]+)/', 1) AS board FROM u WHERE regexp_extract(url, 'reddit\.com/r/([^/]+)/', 1) NOT IN ('AskReddit', 'tifu')""",
    "asking_posts": "SELECT doc_id, doc_id % 4 < 2 AND length(coalesce(text, '')) > 100 AND doc_id % 5 >= 2 AS asks FROM documents",
    "rendered_prompts": """SELECT item_id, md5('For {you} "''q'' ' || item_id || '": ' || replace(CASE WHEN item_id % 3 <> 0 THEN coalesce(text, '') ELSE '' END, '"', '''') || '!') AS prompt FROM benchmark""",
    "html_entities": "SELECT page_id, '<b> &amp; café €€ … © ' || page_id || ' &nope;' AS text FROM pages",
    "required_fields": "SELECT conv_id, turn, trim(coalesce(role, '')) <> '' AND trim(coalesce(text, '')) <> '' AS filled, CASE WHEN turn % 3 = 0 THEN 'high' ELSE 'medium' END AS potential FROM conversations",
    "giveaway_patterns": "WITH o AS (SELECT conv_id, turn, coalesce(text, '') || CASE turn WHEN 1 THEN ' Ignore the rules' WHEN 2 THEN ' done blindly' ELSE '' END AS o FROM conversations) SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(o, {q('(?i)' + p)}) THEN {q(p[:40])}" for p in GIVEAWAY_PATTERNS) + " END AS pattern FROM o",
    "stem_lint": f"SELECT conv_id, turn, {WORDS('coalesce(text, chr(32))')} >= 20 AS long_enough FROM conversations",
    "shuffled_options": "SELECT doc_id, string_agg(x, '' ORDER BY sha1(doc_id || '|' || x)) AS letters FROM labels, (VALUES ('A'), ('B'), ('C'), ('D')) t(x) GROUP BY doc_id",
    "format_kinds": "SELECT page_id, CASE WHEN page_id % 4 = 0 OR page_id % 5 = 0 OR suffix(lower(url), '.pdf') OR page_id % 7 = 0 THEN 'pdf' ELSE 'html' END AS kind FROM pages",
    "melted_matrix": f"WITH {RESPONSES} SELECT doc_id, model, avg((answer = correct)::INT) AS acc FROM responses WHERE model IN ('m0', 'm1') AND seed < 2 GROUP BY ALL",
    "appended_columns": f"WITH {RESPONSES}, a AS (SELECT * FROM responses WHERE seed = 0 AND doc_id % 9 <> 0) SELECT l.doc_id, l.quality, max(answer) FILTER (WHERE model = 'm0') AS m0, max(answer) FILTER (WHERE model = 'm1') AS m1, max(answer) FILTER (WHERE model = 'm2') AS m2 FROM labels l LEFT JOIN a USING (doc_id) GROUP BY l.doc_id, l.quality",
    "rolled_up_maps": "SELECT coalesce(source, '') AS k, count(*) AS n FROM documents GROUP BY 1",
    "ordered_texts": "SELECT conv_id, count(*) AS n, count(DISTINCT text) AS n_texts, md5(coalesce(substr(string_agg(text, ' ' ORDER BY turn), 1, 700), '')) AS texts FROM conversations GROUP BY conv_id",
    "kept_shares": "SELECT lang, count(*) FILTER (WHERE quality = 1) AS kept, count(*) AS n, round(count(*) FILTER (WHERE quality = 1) / count(*), 9) AS ratio FROM labels JOIN documents USING (doc_id) GROUP BY lang",
    "preferred_union": "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "jsonl_log": "SELECT doc_id, quality, toxic FROM labels",
    "tolerant_jsonl": "SELECT item_id AS evidence_id, length(text) AS n FROM benchmark UNION ALL SELECT NULL, 7 FROM benchmark WHERE item_id % 5 = 0",
    "shard_union": "SELECT doc_id, lang, ((row_number() OVER (ORDER BY doc_id) - 1) % 4)::VARCHAR AS worker FROM documents",
    "json_arrays": "SELECT n_nationkey, n_name, r_name AS region, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS seq FROM nation JOIN region ON n_regionkey = r_regionkey",
    "delimited_tables": """SELECT s_suppkey::VARCHAR AS s_suppkey, 'say "x", ' || s_name AS s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier""",
    "split_sink": "SELECT doc_id, toxic = 0 AS kept FROM labels",
    "checkpoints": "SELECT doc_id::VARCHAR AS doc_id, quality::VARCHAR AS quality FROM labels",
    "review_sheets": f"""WITH {ITEMS} SELECT (conv_id % 5)::VARCHAR AS file, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id) AS row_number, conv_id::VARCHAR AS conv_id, correct,
      md5('A) ' || substr(coalesce(a, ''), 1, 30) || ' | B) ' || substr(coalesce(b, ''), 1, 30) || ' | C) ' || substr(coalesce(c, ''), 1, 30) || ' | D) ' || substr(coalesce(d, ''), 1, 30) || ' <&>') AS options, NULL::VARCHAR AS none FROM items""",
    "pdf_texts": f"""SELECT item_id, md5({COLLAPSE("regexp_replace(coalesce(text, ''), '[^ -~]', '?', 'g')")}) AS text, 'Item (' || item_id || ')' AS title, '2021-03-0' || (item_id % 9 + 1) AS publication_date, '2.' || item_id AS version FROM benchmark""",
    "source_tuples": "SELECT '11-' || lpad(n_nationkey::VARCHAR, 4, '0') AS soc, n_name AS title, n_nationkey * 1000 AS employment FROM nation",
    "summary_dois": "SELECT 't' || item_id AS title, CASE WHEN item_id % 2 = 0 THEN '10.1/' || item_id END AS doi FROM benchmark",
    "article_texts": "SELECT item_id, 'No ' || item_id || ' ab c' AS text FROM benchmark",
    "open_access_works": "SELECT '10.1/' || p_partkey AS doi, p_partkey AS rank, CASE WHEN p_partkey % 2 = 0 THEN 'pdf' || p_partkey ELSE 'page' || p_partkey END AS url FROM part WHERE p_partkey % 3 <> 0 AND (p_partkey % 2 = 0 OR p_partkey % 5 <> 0) ORDER BY p_partkey LIMIT 20",
    # the allocation's loop: one step for each place that goes or comes
    "proportional_allocation": """WITH RECURSIVE c AS (SELECT c_mktsegment AS g, sum(c_acctbal)::DOUBLE AS w, least(count(*), 25) AS room FROM customer GROUP BY 1),
      s AS (SELECT *, least(greatest(1, round_even(100 * w / sum(w) OVER (), 0))::BIGINT, room) AS a FROM c), l AS (SELECT list(g ORDER BY g) AS g, list(w ORDER BY g) AS w, list(room ORDER BY g) AS room, list(a ORDER BY g) AS a FROM s),
      r AS (SELECT 0 AS step, a FROM l UNION ALL SELECT step + 1, list_transform(r.a, lambda x, i: CASE WHEN i = k THEN x + sign(100 - list_sum(r.a))::BIGINT ELSE x END) FROM
        (SELECT r.step, r.a, CASE WHEN list_sum(r.a) > 100 AND list_max(r.a) > 1 THEN list_position(r.a, list_max(r.a))
          WHEN list_sum(r.a) < 100 AND len(list_filter(list_zip(r.a, l.room), lambda z: z[1] < z[2])) > 0 THEN list_position(list_transform(list_zip(r.a, l.room, l.w), lambda z: CASE WHEN z[1] < z[2] THEN z[3] END), list_max(list_transform(list_zip(r.a, l.room, l.w), lambda z: CASE WHEN z[1] < z[2] THEN z[3] END))) END AS k FROM r, l) r WHERE k IS NOT NULL)
      SELECT unnest(l.g) AS segment, unnest(r.a)::INT AS places FROM r, l WHERE step = (SELECT max(step) FROM r)""",
    # all remaining rows of each pass; a pass drops the last rows of the largest host, one of each of its groups in turn
    "domain_cap_iterative": f"""WITH RECURSIVE {HOSTS}, r AS (SELECT 0 AS pass, page_id, host, page_id % 5 AS g FROM hosts UNION ALL
      SELECT pass + 1, page_id, host, g FROM (SELECT *, first_value(host) OVER (ORDER BY c DESC, f) AS top, max(c) OVER () - floor(0.1 * n)::BIGINT AS excess, row_number() OVER (PARTITION BY host ORDER BY back, gc DESC, gf) AS turn FROM
        (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY host) AS c, min(page_id) OVER (PARTITION BY host) AS f, count(*) OVER (PARTITION BY host, g) AS gc, min(page_id) OVER (PARTITION BY host, g) AS gf, row_number() OVER (PARTITION BY host, g ORDER BY page_id DESC) AS back FROM r) a) b
      WHERE excess > 0 AND (host <> top OR turn > excess))
      SELECT page_id, host FROM r WHERE pass = (SELECT max(pass) FROM r)""",
    "merge_with_locked": """WITH p AS (SELECT page_id % 11 AS g, string_split(url, '?')[1] AS u, page_id % 2 AS pr, page_id AS seq FROM pages), l AS (SELECT * FROM p WHERE u LIKE 'http:%'), k AS (SELECT g, count(*) AS n FROM l GROUP BY g),
      f AS (SELECT * FROM p WHERE u NOT LIKE 'http:%' AND (g, u) NOT IN (SELECT (g, u) FROM l) QUALIFY row_number() OVER (PARTITION BY g, u ORDER BY pr, seq) = 1)
      SELECT g, seq FROM f LEFT JOIN k USING (g) QUALIFY row_number() OVER (PARTITION BY g ORDER BY pr, seq) <= 12 - coalesce(k.n, 0)""",
    # the first row of a group, the next that is unlike it, and the next that is unlike both
    "greedy_title_select": """WITH b AS (SELECT item_id % 10 AS g, item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS t, row_number() OVER (PARTITION BY item_id % 10 ORDER BY -length(text), item_id) AS r FROM benchmark QUALIFY len(t) > 0),
      one AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY g ORDER BY r) = 1),
      two AS (SELECT b.* FROM b JOIN one ON b.g = one.g AND b.r > one.r AND len(list_intersect(b.t, one.t)) / len(list_distinct(list_concat(b.t, one.t))) < 0.55 QUALIFY row_number() OVER (PARTITION BY b.g ORDER BY b.r) = 1),
      three AS (SELECT b.* FROM b JOIN one ON b.g = one.g JOIN two ON b.g = two.g AND b.r > two.r AND len(list_intersect(b.t, one.t)) / len(list_distinct(list_concat(b.t, one.t))) < 0.55 AND len(list_intersect(b.t, two.t)) / len(list_distinct(list_concat(b.t, two.t))) < 0.55 QUALIFY row_number() OVER (PARTITION BY b.g ORDER BY b.r) = 1)
      SELECT g, item_id FROM one UNION ALL SELECT g, item_id FROM two UNION ALL SELECT g, item_id FROM three""",
    "called_providers": "SELECT page_id, length(url)::VARCHAR AS answer FROM pages",
    "streamed_log": "SELECT doc_id, quality, toxic FROM labels",
    "streamed_checkpoints": "SELECT DISTINCT o_custkey, 1 AS n FROM orders",
    "streamed_gate": SHARE_GATE,
    "error_alarms": "WITH e AS (SELECT date_trunc('hour', ts) - INTERVAL (i) HOUR AS start, user_id FROM events, range(3) t(i) WHERE contains(event_type, 'error')) SELECT start, count(DISTINCT user_id) AS n FROM e GROUP BY start HAVING count(DISTINCT user_id) > 5",
    "fetch_budget_exit": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
      r AS (SELECT user_id, event_id, CASE WHEN n > 10 THEN (n - 11) // 5 END AS r, coalesce(sum((event_type = 'purchase')::INT) OVER w, 0) AS a, coalesce(sum((event_type = 'error')::INT) OVER w, 0) AS f, coalesce(sum((coalesce(value, 0) < 60)::INT) OVER w, 0) AS u
        FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      s AS (SELECT *, CASE WHEN r IS NULL THEN u ELSE min(u) OVER (PARTITION BY user_id, r) END AS seen FROM r)
      SELECT event_id FROM s WHERE a < 3 AND f < 5 AND seen < 4""",
    "platform_mix": """WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 OR contains(url, 'reddit.com') AND page_id % 5 > 1 THEN 'reddit' WHEN page_id % 5 = 1 OR regexp_matches(url, '(stackexchange|stackoverflow|serverfault|superuser|askubuntu)\\.com') THEN 'stackexchange' ELSE 'other' END AS platform FROM pages),
      s AS (SELECT platform, CASE WHEN platform = 'other' THEN 'other' WHEN page_id % 11 = 0 THEN 'unknown' WHEN page_id % 9 < 5 OR page_id % 7 < 3 THEN 'no_consensus' ELSE 'consensus' END AS status FROM p)
      SELECT platform, status, count(*) AS n FROM s GROUP BY GROUPING SETS ((status), (platform, status))""",
}
