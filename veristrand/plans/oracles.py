"""DuckDB twins of the queries, written independently of them."""

from __future__ import annotations

from ..constants import CHAR_CAP, KIND_PRIORITY, KINDS, MODEL_TIERS, OVERLAP, SECTIONS, WINDOW

_KINDS = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_SECTIONS = "[" + ", ".join(f"'{s}'" for s in SECTIONS) + "]"
_NORM = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\s+', ' ', 'g'))"
PAGES = "pages_ AS (SELECT doc_id AS paper, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS number, unnest(string_split(text, chr(10))) AS text FROM documents)"
STORED = f"""stored AS (
  SELECT sha256(doc_id::VARCHAR) AS paper_hash, doc_id, '/papers/' || source || '/' || (doc_id % 10)::VARCHAR || '.pdf' AS pdf_path,
         CASE WHEN doc_id % 5 = 0 THEN {_SECTIONS} ELSE list_filter({_SECTIONS}, lambda s: (doc_id + list_position({_SECTIONS}, s)) % 3 <> 0) END AS sections_completed,
         n_chars::VARCHAR AS updated_at
  FROM documents)"""


def chunks(window: int = WINDOW, overlap: int = OVERLAP, cap: int = CHAR_CAP) -> str:
    """CTEs frag and chunk (paper, chunk_index, first, last): one fragment a step, by recursion."""
    slice_ = max(1000, cap - 64)
    return f"""{PAGES},
    cut AS (SELECT paper, number, unnest(range(0, greatest(length(text), 1), {slice_})) AS skip, text FROM pages_),
    frag AS (SELECT paper, row_number() OVER (PARTITION BY paper ORDER BY number, skip) - 1 AS pos, number, skip // {slice_} AS part,
                    substring(text, skip + 1, {slice_}) AS text, length(substring(text, skip + 1, {slice_})) AS n FROM cut),
    walk AS (
      SELECT paper, 1 AS idx, 0::BIGINT AS first, 0::BIGINT AS pos, n + 32 AS chars FROM frag WHERE pos = 0
      UNION ALL
      SELECT paper, CASE WHEN fits THEN idx ELSE idx + 1 END, CASE WHEN fits THEN first ELSE again END,
             CASE WHEN fits THEN pos + 1 ELSE again END, CASE WHEN fits THEN chars + n + 32 ELSE m + 32 END
      FROM (
        SELECT w.*, f.n, g.n AS m, again, w.pos - w.first + 1 < {window} AND w.chars + f.n + 32 <= {cap} AS fits
        FROM (SELECT *, greatest(first + 1, pos + 1 - least({overlap}, pos - first)) AS again FROM walk) w
        JOIN frag f ON f.paper = w.paper AND f.pos = w.pos + 1
        JOIN frag g ON g.paper = w.paper AND g.pos = w.again)
    ),
    chunk AS (SELECT paper, idx AS chunk_index, min(first) AS first, max(pos) AS last FROM walk GROUP BY ALL),
    member AS (SELECT c.paper, c.chunk_index, f.pos, f.number, f.part, f.text, f.n FROM chunk c JOIN frag f ON f.paper = c.paper AND f.pos BETWEEN c.first AND c.last)"""


EVIDENCE = f"""{chunks()},
    proposal AS (
      SELECT paper, chunk_index, number, number * 2 AS ord, {_KINDS}[number % 9 + 1] AS kind, substring(text, 1, 60) AS raw FROM member WHERE number % 3 = 0 AND part = 0
      UNION ALL
      SELECT paper, chunk_index, number, number * 2 + 1, {_KINDS}[number % 9 + 1], 'never said: ' || substring(text, 1, 40) FROM member WHERE number % 6 = 0 AND part = 0
    ),
    page_text AS (SELECT paper, chunk_index, number, string_agg(' ' || text, '' ORDER BY pos) AS text FROM member GROUP BY ALL),
    checked AS (
      SELECT p.paper, p.chunk_index, p.ord, p.kind, 'page ' || p.number AS statement, nullif(trim(p.raw), '') AS support, p.number AS page,
             coalesce(contains({_NORM.format("t.text")}, {_NORM.format("nullif(trim(p.raw), '')")}), false) AS accepted
      FROM proposal p JOIN page_text t USING (paper, chunk_index, number)
    ),
    numbered AS (SELECT *, printf('C%03d-E%03d', chunk_index, row_number() OVER (PARTITION BY paper, chunk_index ORDER BY ord)) AS evidence_id FROM checked WHERE accepted),
    item AS (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY paper, page, {_NORM.format("support")} ORDER BY chunk_index, ord) = 1)"""

#: Positions in coverage order for lists of up to 64: intervals by level, from left to right.
COVERAGE = """tree AS (
      SELECT n::BIGINT AS n, 0 AS level, 0::DOUBLE AS side, 0::BIGINT AS low, n::BIGINT - 1 AS high FROM range(3, 65) t(n)
      UNION ALL
      SELECT n, level + 1, side + d * pow(0.5, level + 1), CASE WHEN d < 0 THEN low + 1 ELSE (low + high) // 2 + 1 END, CASE WHEN d < 0 THEN (low + high) // 2 - 1 ELSE high - 1 END
      FROM tree, (VALUES (-1), (1)) s(d)
      WHERE CASE WHEN d < 0 THEN low + 1 <= (low + high) // 2 - 1 ELSE (low + high) // 2 + 1 <= high - 1 END
    ),
    emitted AS (SELECT n, level, side, unnest([0, 1, 2]) AS k, unnest([low, high, (low + high) // 2]) AS pos FROM tree),
    seen AS (SELECT n, pos, min((level, side, k)) AS seat FROM emitted GROUP BY n, pos),
    coverage AS (SELECT n, pos, row_number() OVER (PARTITION BY n ORDER BY seat) - 1 AS ord FROM seen
                 UNION ALL SELECT * FROM (VALUES (1, 0, 0), (2, 0, 0), (2, 1, 1)))"""

#: Levels that papers of up to 1,024 chunks are reduced by.
_DEPTH = 5


def _in_order(rows: str, by: str) -> str:
    """rows (with page and nth) with ord: their place in coverage order within by."""
    placed = f"SELECT *, CASE WHEN n < 3 THEN row_number() OVER (PARTITION BY {by} ORDER BY nth) ELSE row_number() OVER (PARTITION BY {by} ORDER BY page, nth) END - 1 AS pos FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS n FROM {rows})"
    return f"SELECT * FROM ({placed}) JOIN coverage USING (n, pos)"


def _reduction() -> str:
    """CTEs leaf, then d0, d1, ... : the dossiers that each level leaves, four by four; one alone is carried over."""
    out = f"""{EVIDENCE}, {COVERAGE},
    span AS (SELECT paper, chunk_index, min(number) AS page_start, max(number) AS page_end FROM member GROUP BY ALL),
    d0 AS (SELECT paper, chunk_index - 1 AS idx, page_start, page_end, coalesce(ids, []) AS ids
           FROM span LEFT JOIN (SELECT paper, chunk_index, list(evidence_id ORDER BY ord) AS ids FROM item GROUP BY ALL) USING (paper, chunk_index))"""
    for k in range(_DEPTH):
        out += f""",
    g{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY paper) AS many, (row_number() OVER (PARTITION BY paper ORDER BY idx) - 1) // 4 AS grp FROM d{k}),
    c{k} AS (SELECT paper, grp, idx, unnest(range(1, len(ids) + 1)) AS nth, unnest(ids) AS evidence_id FROM g{k} WHERE many > 1),
    k{k} AS (SELECT c.*, page FROM c{k} c JOIN item USING (paper, evidence_id)),
    m{k} AS MATERIALIZED (SELECT paper, grp, coalesce(list(evidence_id ORDER BY idx, ord) FILTER (ord < 2), []) AS reps, list(evidence_id ORDER BY idx, nth) AS every FROM ({_in_order(f"k{k}", "paper, grp, idx")}) GROUP BY ALL),
    w{k} AS (SELECT paper, grp, reps || list_filter(every[1:4], lambda x: NOT list_contains(reps, x)) AS ids FROM m{k}),
    u{k} AS (SELECT paper, grp, unnest(range(1, len(ids) + 1)) AS nth, unnest(ids) AS evidence_id FROM w{k}),
    v{k} AS (SELECT u.*, page FROM u{k} u JOIN item USING (paper, evidence_id)),
    s{k} AS (SELECT paper, grp, list(evidence_id ORDER BY ord) AS ids FROM ({_in_order(f"v{k}", "paper, grp")}) WHERE ord < 16 GROUP BY ALL),
    d{k + 1} AS MATERIALIZED (
      SELECT paper, idx, page_start, page_end, ids FROM g{k} WHERE many = 1
      UNION ALL
      SELECT paper, grp, a, b, coalesce(ids, []) FROM (SELECT paper, grp, min(page_start) AS a, max(page_end) AS b FROM g{k} WHERE many > 1 GROUP BY ALL) LEFT JOIN s{k} USING (paper, grp))"""
    return f"""{out},
    depth AS (SELECT paper, CASE WHEN count(*) <= 1 THEN 0 WHEN count(*) <= 4 THEN 1 WHEN count(*) <= 16 THEN 2 WHEN count(*) <= 64 THEN 3 WHEN count(*) <= 256 THEN 4 ELSE 5 END AS levels FROM d0 GROUP BY paper),
    root AS MATERIALIZED (SELECT paper, page_start, page_end, ids, levels FROM d{_DEPTH} JOIN depth USING (paper))"""


_ROUTED = f"""{PAGES},
    raw AS (
      SELECT paper, number, trim(text) AS native, length(trim(text)) < 100 AS wants,
             CASE WHEN number % 2 = 0 THEN 'read ' || text ELSE '' END AS ocr,
             CASE WHEN number % 10 = 0 THEN '' WHEN number % 5 = 0 THEN 'cached ' || text END AS hit
      FROM pages_
    ),
    counted AS (SELECT *, wants AND hit IS NOT NULL AS cached, sum(CASE WHEN wants AND hit IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY paper ORDER BY number) AS nth FROM raw),
    got AS (SELECT *, wants AND NOT cached AND nth > 3 AS capped, CASE WHEN cached THEN trim(hit) WHEN wants AND NOT (NOT cached AND nth > 3) THEN ocr END AS got FROM counted),
    routed AS (
      SELECT paper, number, wants, cached, capped, nullif(coalesce(nullif(got, ''), native), '') AS text,
             CASE WHEN cached THEN 'ocr-cache' WHEN got <> '' THEN 'ocr' ELSE 'native' END AS way
      FROM got
    )"""

_RELATIONS = f"""{EVIDENCE},
    own AS (SELECT paper, chunk_index, list(evidence_id ORDER BY ord) AS own FROM item GROUP BY ALL HAVING count(*) > 1),
    relation AS (SELECT paper, chunk_index AS nth, own || own[1:1] || CASE WHEN chunk_index % 3 = 0 THEN ['C999-E999'] ELSE [] END AS ids, ' chunk ' || chunk_index || ' ' AS description, own AS selected FROM own)"""

_FILES = f"""{STORED},
    newest AS (SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY pdf_path ORDER BY updated_at DESC, paper_hash) = 1),
    files AS (SELECT DISTINCT pdf_path FROM stored UNION ALL SELECT DISTINCT '/papers/' || source || '/new.pdf' FROM documents),
    live AS (SELECT DISTINCT 'sha256:' || sha256(doc_id::VARCHAR) AS resource_key FROM documents WHERE doc_id % 7 = 0),
    status AS (
      SELECT f.pdf_path, CASE WHEN n.paper_hash IS NULL THEN 'not started' WHEN len(n.sections_completed) = 5 THEN 'complete' ELSE 'partial' END AS status,
             CASE WHEN n.paper_hash IS NULL THEN '' ELSE array_to_string(list_sort(list_filter({_SECTIONS}, lambda s: NOT list_contains(n.sections_completed, s))), ',') END AS missing,
             l.resource_key IS NOT NULL AS in_progress
      FROM files f LEFT JOIN newest n USING (pdf_path) LEFT JOIN live l ON l.resource_key = 'sha256:' || n.paper_hash
    )"""

_EVENTS = """log AS (
      SELECT user_id AS key, event_id, epoch(ts) AS ts, CASE WHEN event_type IN ('signup', 'error') THEN 'claim' WHEN event_type = 'purchase' THEN 'release' ELSE 'renew' END AS kind,
             CASE WHEN event_type = 'error' THEN 'other' ELSE 'own' END AS owner, event_id % 3 + 1 AS generation
      FROM events)"""

_FOLD = f"""{_EVENTS},
    nth AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS i FROM log),
    state AS (
      SELECT key, 0::BIGINT AS i, 0::BIGINT AS event_id, 0::DOUBLE AS moment, NULL::VARCHAR AS kind, NULL::VARCHAR AS holder, 0::BIGINT AS gen, 0::DOUBLE AS renewed, false AS active, false AS accepted, false AS reclaimed FROM (SELECT DISTINCT key FROM nth)
      UNION ALL
      SELECT s.key, n.i, n.event_id, n.ts, n.kind,
             CASE WHEN n.kind = 'claim' AND ok THEN n.owner ELSE holder END, CASE WHEN n.kind = 'claim' AND ok THEN gen + 1 ELSE gen END,
             CASE WHEN n.kind <> 'release' AND ok THEN n.ts ELSE renewed END, CASE WHEN NOT ok THEN active ELSE n.kind <> 'release' END, ok, ok AND n.kind = 'claim' AND active
      FROM (SELECT s.*, n.event_id AS e, CASE n.kind WHEN 'claim' THEN NOT (s.active AND n.ts - s.renewed < 14400)
                   WHEN 'renew' THEN s.active AND s.holder = n.owner AND s.gen = n.generation AND n.ts - s.renewed < 14400
                   ELSE s.active AND s.holder = n.owner AND s.gen = n.generation END AS ok
            FROM state s JOIN nth n ON n.key = s.key AND n.i = s.i + 1) s JOIN nth n ON n.key = s.key AND n.i = s.i + 1
    )"""

_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KIND_PRIORITY["logic"])) + " ELSE 5 END"
_GRAPH = f"""{_RELATIONS},
    node AS (SELECT sha256(paper::VARCHAR) || ':' || evidence_id AS qid, * FROM item),
    given AS (SELECT paper, nth, description, unnest(range(1, len(ids) + 1)) AS i, ids FROM relation),
    pair AS (SELECT paper, nth, i, j, ids[i] AS a, ids[j] AS b, description FROM (SELECT *, unnest(range(i + 1, len(ids) + 1)) AS j FROM given)),
    edge AS (SELECT sha256(paper::VARCHAR) || ':' || a AS src, sha256(paper::VARCHAR) || ':' || b AS dst, arg_max(description, (nth, i, j)) AS description FROM pair GROUP BY paper, a, b),
    edges_ AS (SELECT src, dst, description FROM edge WHERE src IN (SELECT qid FROM node) AND dst IN (SELECT qid FROM node))"""

#: A context is grown as text, so what is used is its length; entries that don't fit are passed over.
_CONTEXTS = f"""{_reduction()},
    head AS (SELECT paper, ids, '# Hierarchical evidence synthesis' || chr(10) || 'Physical pages: ' || len(string_split(d.text, chr(10))) || chr(10) || 'Evidence records: ' || coalesce(records, 0) || chr(10)
               || 'Reduction levels: ' || levels || chr(10) || chr(10) || '## Root synthesis' || chr(10) || 'pages ' || page_start || ' to ' || page_end || chr(10) AS head
             FROM root JOIN documents d ON d.doc_id = paper LEFT JOIN (SELECT paper, count(*) AS records FROM item GROUP BY paper) USING (paper)),
    line AS (SELECT paper, '- Pages ' || page_start || '–' || page_end || ': pages ' || page_start || ' to ' || page_end || chr(10) AS entry, count(*) OVER (PARTITION BY paper) AS n,
               row_number() OVER (PARTITION BY paper ORDER BY page_start, page_end, chunk_index) - 1 AS pos, row_number() OVER (PARTITION BY paper ORDER BY chunk_index) - 1 AS given FROM span),
    lines AS (SELECT paper, list(entry ORDER BY ord) AS lines FROM line JOIN coverage c ON c.n = line.n AND c.pos = CASE WHEN line.n < 3 THEN given ELSE line.pos END GROUP BY paper),
    fact AS (SELECT paper, evidence_id, kind, page, '[' || evidence_id || '] ' || kind || '; page ' || page || chr(10) || 'Claim: ' || statement || chr(10) || 'Exact support: "' || support || '"' || chr(10) || chr(10) AS entry FROM item),
    first_ AS (SELECT r.*, page, entry FROM (SELECT paper, unnest(range(1, len(ids) + 1)) AS nth, unnest(ids) AS evidence_id FROM root) r JOIN fact USING (paper, evidence_id)),
    facts AS (SELECT paper, list(entry ORDER BY tier, ord) AS facts FROM (
      SELECT paper, 0 AS tier, ord, entry FROM ({_in_order("first_", "paper")})
      UNION ALL
      SELECT paper, 1, row_number() OVER (PARTITION BY paper ORDER BY {_RANK}, page, evidence_id), entry FROM fact f WHERE NOT EXISTS (SELECT 1 FROM first_ g WHERE g.paper = f.paper AND g.evidence_id = f.evidence_id)) GROUP BY paper),
    own AS (SELECT paper, chunk_index AS nth, list(evidence_id ORDER BY ord) AS own FROM item GROUP BY ALL HAVING count(*) > 1),
    said AS (SELECT paper, nth, '- ' || array_to_string(own, ', ') || ': chunk ' || nth || chr(10) AS entry FROM own WHERE nth % 3 <> 0),
    top AS (SELECT paper, head, list_reduce(coalesce(lines, []), lambda a, e: CASE WHEN length(a) + length(e) <= 2520 THEN a || e ELSE a END, head || chr(10) || '## Chunk coverage' || chr(10)) AS top FROM head LEFT JOIN lines USING (paper)),
    body AS (SELECT paper, head, list_reduce(coalesce(facts, []), lambda a, e: CASE WHEN length(a) + length(e) <= 6000 THEN a || e ELSE a END, top || chr(10) || '## Verified evidence' || chr(10)) || chr(10) || '## Supported relationships' || chr(10) AS body FROM top LEFT JOIN facts USING (paper)),
    run AS (SELECT paper, nth, entry, sum(length(entry)) OVER (PARTITION BY paper ORDER BY nth) AS upto FROM said),
    told AS (SELECT paper, string_agg(entry, '' ORDER BY nth) AS told FROM run JOIN body USING (paper) WHERE length(body) + upto <= 6000 GROUP BY paper),
    context AS (SELECT paper, CASE WHEN length(head) < 6000 THEN body || coalesce(told, '') END AS context FROM body LEFT JOIN told USING (paper))"""

ORACLES = {
    "reduce_root": f"WITH RECURSIVE {_reduction()} SELECT paper, page_start::BIGINT AS page_start, page_end::BIGINT AS page_end, array_to_string(ids, ',') AS ids, levels::BIGINT AS levels FROM root",
    "section_contexts": f"WITH RECURSIVE {_CONTEXTS} SELECT paper, length(context)::BIGINT AS chars, sha256(context) AS digest, CASE WHEN context IS NULL THEN 'the root synthesis fills the context' END AS error FROM context",
    "page_explode": f"WITH {PAGES} SELECT paper, number, length(text)::BIGINT AS chars, sha256(text) AS digest FROM pages_",
    "page_ocr_route": f"WITH {_ROUTED} SELECT paper, number, wants, cached, capped, text, CASE WHEN text IS NOT NULL THEN way END AS method FROM routed",
    "ocr_budget": f"WITH {_ROUTED} SELECT paper, count(*) FILTER (wants AND NOT cached)::BIGINT AS fresh, count(*) FILTER (capped)::BIGINT AS capped FROM routed GROUP BY paper",
    "ocr_stats": f"""WITH {_ROUTED}, s AS (
        SELECT paper, count(*)::BIGINT AS total_pages, count(*) FILTER ((NOT wants OR capped) AND text IS NOT NULL)::BIGINT AS native_pages, count(*) FILTER (wants AND NOT cached AND NOT capped)::BIGINT AS ocr_pages,
               count(*) FILTER (cached)::BIGINT AS cached_pages, count(*) FILTER (text IS NULL)::BIGINT AS skipped_blank, count(*) FILTER (capped)::BIGINT AS ocr_capped
        FROM routed GROUP BY paper)
        SELECT *, CASE WHEN ocr_pages = 0 AND cached_pages = 0 THEN printf('%d/%d pages had native text (no OCR needed)', native_pages, total_pages)
          ELSE printf('%d pages → ', total_pages) || concat_ws(', ', native_pages || ' native', CASE WHEN ocr_pages > 0 THEN ocr_pages || ' OCR''d' END, CASE WHEN cached_pages > 0 THEN cached_pages || ' cached' END,
               CASE WHEN skipped_blank > 0 THEN skipped_blank || ' still-blank' END, CASE WHEN ocr_capped > 0 THEN ocr_capped || ' budget-capped' END) END AS summary FROM s""",
    "paper_identity": "SELECT doc_id AS paper, sha256(text) AS paper_hash, 'sha256:' || sha256(text) AS resource_key FROM documents",
    "identity_check": """WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN upper(sha256(text)) WHEN 2 THEN substring(sha256(text), 1, 16) END AS paper_hash FROM documents)
        SELECT doc_id, paper_hash, coalesce(regexp_matches(paper_hash, '^[0-9a-f]{64}$'), false) AS valid FROM t""",
    "content_dedupe": "SELECT sha256(text) AS paper_hash, min(doc_id) AS paper, count(*)::BIGINT AS copies FROM documents GROUP BY 1",
    "tier_route": f"""SELECT doc_id AS paper, len(string_split(text, chr(10)))::BIGINT AS page_count,
        CASE WHEN source = 'src0' THEN 'own-model' WHEN len(string_split(text, chr(10))) BETWEEN 36 AND 200 THEN '{MODEL_TIERS["reasoning"]}' ELSE '{MODEL_TIERS["default"]}' END AS model FROM documents""",
    "tier_sort": f"""WITH t AS (SELECT doc_id AS path, CASE WHEN len(string_split(text, chr(10))) BETWEEN 36 AND 200 THEN '{MODEL_TIERS["reasoning"]}' ELSE '{MODEL_TIERS["default"]}' END AS model FROM documents)
        SELECT path, model, row_number() OVER (ORDER BY model, path)::BIGINT AS ord FROM t""",
    "missing_models": f"""SELECT DISTINCT CASE WHEN source = 'src0' THEN 'src1' WHEN source = 'src1' THEN 'own-src1' WHEN len(string_split(text, chr(10))) BETWEEN 36 AND 200 THEN '{MODEL_TIERS["reasoning"]}' ELSE '{MODEL_TIERS["default"]}' END AS model
      FROM documents EXCEPT SELECT source FROM documents""",
    "language_fingerprint": """WITH c AS (SELECT doc_id, lang, n_chars, list_sort(CASE WHEN doc_id % 3 = 0 THEN [lang] ELSE [lang, 'osd', 'eng'] END) AS codes FROM documents)
      SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'no-tessdata' ELSE substring(sha256(array_to_string(list_transform(codes, lambda x: x || ':' || CASE x WHEN lang THEN n_chars || ':' || doc_id WHEN 'eng' THEN '7:8' ELSE 'missing' END), '|')), 1, 10) END AS fingerprint FROM c""",
    "fragment_pages": "SELECT doc_id AS paper, skip // 1000 AS part, length(substring(text, skip + 1, 1000))::BIGINT AS chars, sha256(substring(text, skip + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1000)) AS skip FROM documents)",
    "chunk_bounds": f"WITH RECURSIVE {chunks(12, 2, 3000)} SELECT paper, chunk_index::BIGINT AS chunk_index, min(number)::BIGINT AS page_start, max(number)::BIGINT AS page_end, count(*)::BIGINT AS fragments, sum(n)::BIGINT AS chars FROM member GROUP BY paper, chunk_index",
    "chunk_render": f"WITH RECURSIVE {chunks()} SELECT paper, chunk_index::BIGINT AS chunk_index, sha256(string_agg('[PAGE ' || number || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY pos)) AS digest FROM member GROUP BY paper, chunk_index",
    "evidence_verify": f"WITH RECURSIVE {EVIDENCE} SELECT paper, chunk_index::BIGINT AS chunk_index, ord::BIGINT AS ord, kind, support, page::BIGINT AS page, accepted FROM checked",
    "evidence_page_types": f"""WITH RECURSIVE {EVIDENCE},
      told AS (SELECT paper, chunk_index, number, row_number() OVER (PARTITION BY paper, chunk_index ORDER BY number) - 1 AS ord, nullif(trim(substring(text, 1, 60)), '') AS support FROM member WHERE part = 0)
      SELECT paper, chunk_index::BIGINT AS chunk_index, ord::BIGINT AS ord, CASE WHEN number % 6 NOT IN (3, 4) THEN number END::BIGINT AS page, number % 6 NOT IN (3, 4) AND support IS NOT NULL AS accepted FROM told""",
    "merge_on_read": """WITH base AS (SELECT sha256(doc_id::VARCHAR) AS paper_hash, doc_id FROM documents)
      SELECT paper_hash, CASE WHEN doc_id % 7 = 0 THEN 'second ' WHEN doc_id % 5 IN (1, 2) THEN 'first ' ELSE 'base ' END || doc_id AS paper_name
      FROM base WHERE doc_id % 7 <> 1 AND (doc_id % 7 = 0 OR doc_id % 5 IN (1, 2) OR doc_id % 3 > 0)""",
    "commit_conflicts": f"""WITH {_EVENTS}, t AS (SELECT event_id, key, greatest(event_id - 1 - event_id % 400, 0) AS base FROM log WHERE kind = 'renew')
      SELECT event_id AS write_id, EXISTS (SELECT 1 FROM log l WHERE l.key = t.key AND l.event_id > base AND l.event_id < t.event_id) AS conflict FROM t""",
    "evidence_reject": f"WITH RECURSIVE {EVIDENCE} SELECT paper, chunk_index::BIGINT AS chunk_index, count(*) FILTER (accepted)::BIGINT AS accepted_items, count(*) FILTER (NOT accepted)::BIGINT AS rejected_items FROM checked GROUP BY paper, chunk_index",
    "evidence_ids": f"WITH RECURSIVE {EVIDENCE} SELECT paper, evidence_id, kind, support, page::BIGINT AS page FROM numbered",
    "evidence_dedupe": f"WITH RECURSIVE {EVIDENCE} SELECT paper, evidence_id, kind, support, page::BIGINT AS page FROM item",
    "evidence_by_kind": f"WITH RECURSIVE {EVIDENCE} SELECT paper, kind, count(*)::BIGINT AS items, count(DISTINCT page)::BIGINT AS pages FROM item GROUP BY paper, kind",
    "kind_rank_order": f"WITH RECURSIVE {EVIDENCE} SELECT paper, evidence_id, row_number() OVER (PARTITION BY paper ORDER BY {_RANK}, page, evidence_id)::BIGINT AS ord FROM item",
    "coverage_order": f"""WITH RECURSIVE {chunks()}, {COVERAGE}, c AS (SELECT paper, chunk_index, count(*) OVER (PARTITION BY paper) AS n, row_number() OVER (PARTITION BY paper ORDER BY chunk_index) - 1 AS pos FROM chunk)
        SELECT paper, chunk_index::BIGINT AS chunk_index, ord::BIGINT AS ord FROM c JOIN coverage USING (n, pos)""",
    "reduce_groups": f"""WITH RECURSIVE {chunks()}, c AS (SELECT paper, chunk_index, min(number) AS s, max(number) AS e FROM member GROUP BY ALL)
        SELECT paper, ((chunk_index - 1) // 4)::BIGINT AS grp, min(s)::BIGINT AS page_start, max(e)::BIGINT AS page_end, count(*)::BIGINT AS children FROM c GROUP BY paper, 2""",
    "reduce_levels": f"""WITH RECURSIVE {chunks()}, c AS (SELECT paper, count(*) AS n FROM chunk GROUP BY paper)
        SELECT paper, n::BIGINT AS chunks, CASE WHEN n <= 1 THEN 0 WHEN n <= 4 THEN 1 WHEN n <= 16 THEN 2 WHEN n <= 64 THEN 3 ELSE 4 END::BIGINT AS levels FROM c""",
    "relationship_validate": f"""WITH RECURSIVE {_RELATIONS}
        SELECT paper, nth::BIGINT AS nth, array_to_string(selected, ',') AS ids, trim(description) AS description FROM relation WHERE NOT list_contains(ids, 'C999-E999')""",
    "relationship_pairs": f"WITH RECURSIVE {_GRAPH} SELECT src, dst, description FROM edge",
    "graph_nodes": f"WITH RECURSIVE {_GRAPH} SELECT qid, sha256(paper::VARCHAR) AS paper_hash, evidence_id, kind, page::BIGINT AS page FROM node",
    "chunk_retry": f"""WITH RECURSIVE {chunks()},
      c AS (SELECT paper, chunk_index, arg_min(text, pos) AS line FROM member GROUP BY ALL),
      r AS (SELECT paper, chunk_index, (chunk_index % 5 <> 3 AND trim(substring(line, 1, 60)) <> '')::BIGINT AS ok FROM c)
      SELECT paper, chunk_index::BIGINT AS chunk_index, CASE WHEN ok = 0 THEN 'all proposed evidence failed source verification' END AS error, ok AS accepted_items, 1 - ok AS rejected_items FROM r""",
    "cache_profiles": f"""WITH {PAGES}, raw AS (SELECT paper, number, trim(text) AS native, CASE WHEN number % 3 = 0 THEN 'b ' || text END AS hit FROM pages_)
      SELECT paper, number, hit IS NOT NULL AS cached, nullif(coalesce(nullif(trim(hit), ''), native), '') AS text FROM raw""",
    "heartbeat_loss": f"""WITH {_EVENTS}, g AS (SELECT key, ts, lead(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS after FROM log)
      SELECT key, min(ts + 7200) AS lost_at FROM g WHERE after - ts >= 7200 GROUP BY key""",
    "lease_silence_stream": f"""WITH {_EVENTS}, g AS (SELECT key, ts, coalesce(lead(ts) OVER (PARTITION BY key ORDER BY ts, event_id), max(ts) OVER ()) AS after FROM log WHERE key IS NOT NULL)
      SELECT key, min(ts + 7200) AS lost_at FROM g WHERE after - ts >= 7200 GROUP BY key""",
    "synced_stream": "SELECT sha256(text) AS paper_hash, min(doc_id) AS paper, count(*)::BIGINT AS copies FROM documents GROUP BY 1",
    "answers_source": "SELECT conv_id AS request, string_agg(text, '' ORDER BY turn) AS text, sum(length(role))::BIGINT AS thinking_chars FROM conversations GROUP BY conv_id",
    "graph_sync": """WITH p AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS paper_hash, doc_id % 6 AS r FROM documents WHERE doc_id % 7 <> 0)
      SELECT paper_hash, CASE r WHEN 0 THEN 'gone' WHEN 1 THEN 'changed' WHEN 2 THEN 'new' END AS change, CASE WHEN r = 1 THEN 'renamed' WHEN r > 0 THEN 'paper ' || doc_id END AS label,
             CASE WHEN r > 0 THEN 3 + (doc_id % 3 = 1)::BIGINT END AS nodes, CASE WHEN r > 0 THEN 2 + (doc_id % 3 = 1)::BIGINT + (doc_id % 4 > 0)::BIGINT END AS edges FROM p""",
    "graph_edges": f"WITH RECURSIVE {_GRAPH} SELECT src, dst, description FROM edges_",
    "graph_endpoints": f"WITH RECURSIVE {_GRAPH} SELECT qid AS id, evidence_id AS label FROM node WHERE qid IN (SELECT src FROM edges_ UNION ALL SELECT dst FROM edges_)",
    "context_prefix_fit": f"WITH {PAGES}, r AS (SELECT paper, number, sum(length(text)) OVER (PARTITION BY paper ORDER BY number) AS used FROM pages_) SELECT paper, number, used::BIGINT AS used FROM r WHERE used <= 1500",
    "context_skip_fit": f"""WITH RECURSIVE {PAGES}, walk AS (
          SELECT paper, 0::BIGINT AS number, 0::BIGINT AS used, false AS kept FROM (SELECT DISTINCT paper FROM pages_)
          UNION ALL
          SELECT p.paper, p.number, CASE WHEN used + length(p.text) <= 1500 THEN used + length(p.text) ELSE used END, used + length(p.text) <= 1500 FROM walk w JOIN pages_ p ON p.paper = w.paper AND p.number = w.number + 1)
        SELECT paper, count(*)::BIGINT AS entries, sum(number)::BIGINT AS numbers, max(used)::BIGINT AS used FROM walk WHERE kept GROUP BY paper""",
    "section_status": f"""WITH {STORED}, s AS (SELECT paper_hash, sections_completed, unnest([0, 1, 2, 3, 4]) AS ord, unnest({_SECTIONS}) AS section FROM stored)
        SELECT paper_hash, section, ord::BIGINT AS ord FROM s WHERE section = 'logic' OR NOT list_contains(sections_completed, section)""",
    "missing_sections": f"WITH {STORED} SELECT paper_hash, len(sections_completed) = 5 AS complete, array_to_string(list_sort(list_filter({_SECTIONS}, lambda s: NOT list_contains(sections_completed, s))), ',') AS missing FROM stored",
    "latest_by_path": f"WITH {STORED} SELECT pdf_path, paper_hash, updated_at FROM stored QUALIFY row_number() OVER (PARTITION BY pdf_path ORDER BY updated_at DESC, paper_hash) = 1",
    "upsert_merge": """WITH t AS (SELECT sha256(doc_id::VARCHAR) AS paper_hash, 'old-' || doc_id AS paper_name, CASE WHEN doc_id % 2 = 0 THEN 'corpus' END AS source_corpus, '2024-01-01T00:00:00Z' AS created_at FROM documents WHERE doc_id % 3 <> 0),
        n AS (SELECT sha256(doc_id::VARCHAR) AS paper_hash, 'new-' || doc_id AS paper_name, 'fresh' AS source_corpus FROM documents WHERE doc_id % 3 <> 1)
        SELECT paper_hash, coalesce(n.paper_name, t.paper_name) AS paper_name, coalesce(t.source_corpus, n.source_corpus) AS source_corpus, coalesce(created_at, '2024-02-01T00:00:00Z') AS created_at,
               CASE WHEN n.paper_hash IS NOT NULL THEN '2024-02-01T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS updated_at
        FROM t FULL JOIN n USING (paper_hash)""",
    "clear_section": f"WITH {STORED} SELECT paper_hash, array_to_string(list_filter(sections_completed, lambda s: s <> 'summary'), ',') AS sections_completed, NULL::VARCHAR AS summary_md, 'logic text' AS symbolic_logic_md, 'corpus' AS source_corpus FROM stored",
    "cache_first_wins": f"""WITH {PAGES}, c AS (SELECT paper, number AS page_idx, text FROM pages_ WHERE number % 3 = 0),
        n AS (SELECT paper, number AS page_idx, 'first ' || text AS text FROM pages_ WHERE number % 2 = 0)
        SELECT paper, page_idx, sha256(text) AS digest FROM (SELECT * FROM c UNION ALL SELECT * FROM n WHERE page_idx % 3 <> 0)""",
    "paper_status": f"WITH {_FILES} SELECT * FROM status",
    "batch_progress": f"WITH {_FILES} SELECT count(*)::BIGINT AS total, count(*) FILTER (status = 'complete')::BIGINT AS complete, count(*) FILTER (status = 'partial')::BIGINT AS partial, count(*) FILTER (status = 'not started')::BIGINT AS not_started FROM status",
    "entity_report": f"""WITH {STORED}
        SELECT 'papers' AS entity, 'total' AS metric, count(*)::VARCHAR AS value FROM stored UNION ALL SELECT 'papers', 'complete', (count(*) FILTER (len(sections_completed) = 5))::VARCHAR FROM stored
        UNION ALL SELECT 'diagrams', 'total', count(*)::VARCHAR FROM documents UNION ALL SELECT 'diagrams', 'rendered', (count(*) FILTER (doc_id % 4 <> 0))::VARCHAR FROM documents UNION ALL SELECT 'diagrams', 'failed', (count(*) FILTER (doc_id % 4 = 0))::VARCHAR FROM documents
        UNION ALL SELECT 'ocr_cache', 'total', count(*)::VARCHAR FROM pages UNION ALL SELECT 'processing_leases', 'total', count(*)::VARCHAR FROM documents UNION ALL SELECT 'processing_leases', 'active', (count(*) FILTER (doc_id % 7 = 0))::VARCHAR FROM documents
        UNION ALL SELECT 'schema_meta', 'version', '4' UNION ALL SELECT 'schema_meta', 'identity', 'sha256-full-v1'""",
    "status_histogram": """SELECT (doc_id % 5 + 1)::BIGINT AS ord, ['COMPLETE', 'PARTIAL', 'ALREADY_COMPLETE', 'CLAIMED_ELSEWHERE', 'INTERRUPTED'][doc_id % 5 + 1] AS status, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2""",
    "changed_papers": "SELECT sha256(doc_id::VARCHAR) AS paper_hash, doc_id FROM documents WHERE doc_id % 4 <> 0",
    "in_progress_leases": f"WITH {_EVENTS}, l AS (SELECT key, max(ts) AS renewed_at, arg_max(kind, (ts, event_id)) AS kind FROM log GROUP BY key) SELECT key, renewed_at FROM l WHERE kind <> 'release' AND renewed_at >= (SELECT max(renewed_at) FROM l) - 120",
    "lease_generations": f"WITH {_EVENTS}, g AS (SELECT key, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id) < 14400 THEN 0 ELSE 1 END AS new FROM log) SELECT key, sum(new)::BIGINT AS generations FROM g GROUP BY key",
    "lease_replay": f"WITH RECURSIVE {_FOLD} SELECT key, event_id, kind, accepted, reclaimed, holder, gen AS now_generation, renewed AS renewed_at, active FROM state WHERE i > 0",
    "fenced_writes": f"""WITH RECURSIVE {_FOLD}, w AS (SELECT key, event_id AS write_id, ts + 1 AS ts, owner, generation FROM log WHERE kind = 'renew')
        SELECT w.key, write_id, coalesce(active AND holder = owner AND gen = generation AND w.ts - renewed < 14400, false) AS accepted
        FROM w ASOF LEFT JOIN (SELECT * FROM state WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY key, moment ORDER BY i DESC) = 1) s ON s.key = w.key AND s.moment <= w.ts""",
    "normalise_text": f"SELECT doc_id, sha256({_NORM.format('text')}) AS digest FROM documents",
    "text_formats": """SELECT doc_id, printf('schema=1|dpi=%d|lang=%s|tess=none|pymupdf=1|td=x', n_chars, lang) AS profile_parts, substring(sha256(printf('schema=1|dpi=%d|lang=%s|tess=none|pymupdf=1|td=x', n_chars, lang)), 1, 12) AS profile,
        printf('hierarchical-evidence-v1 (%d chunks, %d reduce levels, %d records)', doc_id % 9, doc_id % 3, n_chars) AS strategy,
        CASE WHEN n_chars >= 3600 THEN printf('%dh%dm%ds', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) ELSE printf('%dm%ds', n_chars // 60, n_chars % 60) END AS took,
        '# Symbolic logic' || chr(10) || chr(10) || lang || chr(10) AS section FROM documents""",
    "stream_answer": "SELECT conv_id AS request, string_agg(text, '' ORDER BY turn) AS text, sum(length(role))::BIGINT AS thinking_chars FROM conversations GROUP BY conv_id",
    "diagram_parse": """SELECT doc_id, unnest([1, 2])::BIGINT AS idx, unnest(['First ' || lang, 'Second']) AS title, unnest(['digraph g' || doc_id || ' { a -> b }', 'graph { c -- d }']) AS dot FROM documents""",
    "diagram_style": """WITH t AS (SELECT doc_id, unnest(['First ' || lang, 'Second']) AS title, unnest(['digraph g' || doc_id || ' {', 'graph {']) AS head, unnest([' a -> b }', ' c -- d }']) AS tail FROM documents)
        SELECT doc_id, title, head || chr(10) || '  graph [bgcolor="black" fontcolor="#00FF41" fontname="Courier New"];' || chr(10) || '  node  [style=filled fillcolor="#0a0a0a" color="#00FF41" fontcolor="#00FF41" fontname="Courier New"];'
          || chr(10) || '  edge  [color="#FF00FF" penwidth=2.0];' || tail AS dot FROM t""",
    "dot_repair": """SELECT doc_id, 'A [label="' || lang || ' \\\\n \\"x\\""]; B [label="y"]; C [label="z"];' AS dot FROM documents""",
    "json_repair": """SELECT doc_id, lang || ' \\dot{u} A' AS summary, '{"chunk_summary":"' || lang || ' \\\\dot{u} A","evidence":[]}' AS object FROM documents""",
    "bundle_reusable": "SELECT doc_id, doc_id % 5 = 0 AND doc_id % 7 <> 0 AS reusable FROM documents",
    "import_totals": "SELECT sha256(doc_id::VARCHAR) AS paper_hash, 2::BIGINT AS evidence, (doc_id % 4 * 3)::BIGINT AS relations FROM documents WHERE doc_id % 7 <> 0",
    "papers_with_diagrams": "SELECT sha256(doc_id::VARCHAR) AS paper_hash, ['', '1', '1,2'][doc_id % 3 + 1] AS diagrams FROM documents",
    "incomplete_papers": f"WITH {STORED} SELECT paper_hash FROM stored WHERE len(sections_completed) < 5",
    "owned_leases": f"""WITH RECURSIVE {_FOLD}, l AS (SELECT * FROM state WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1)
        SELECT key, coalesce(active AND holder = 'own' AND (SELECT max(moment) FROM state) + 3600 - renewed < 14400, false) AS owned FROM l""",
    "display_formats": f"""WITH t AS (SELECT *, 'folder/' || repeat('p', (doc_id % 70)::INT) || '.pdf' AS path, n_chars * 1000 AS n FROM documents)
        SELECT doc_id, CASE WHEN length(path) > 58 THEN '…' || right(path, 57) ELSE path END AS path,
          CASE WHEN n < 1024 THEN printf('%.0fB', n::DOUBLE) WHEN n < 1048576 THEN printf('%.0fKB', n / 1024) WHEN n < 1073741824 THEN printf('%.0fMB', n / 1048576) ELSE printf('%.0fGB', n / 1073741824) END AS bytes,
          CASE WHEN source = 'src1' THEN 'coder' ELSE '{MODEL_TIERS["default"]}' END AS code_model, 'Write logic of ' || lang || ': logic.' AS prompt FROM t""",
}
