"""DuckDB oracle SQL for the registered queries. Written independently of the
Spark code from the same specification (see ``derived.py`` for the input
derivations). A library of named CTEs is composed per query, pulling in
dependencies; the driver pre-registers the given tables as views."""

from __future__ import annotations

import re

from ..functions.text import ABBREVIATIONS, BOILERPLATE_PATTERNS
from ..operators.council import STOP_WORDS
from ..operators.taxonomy import CATEGORIES
from ..sources.papers import NA_TOKENS


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


BP = _lit("|".join(BOILERPLATE_PATTERNS))
SENT = _lit(r"""([.!?]+["')\]]*)\s+""")
ABBR = _lit(r"(?i)\b(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.")
NL = "chr(10)"
CATS = "[" + ", ".join(_lit(c) for c in CATEGORIES) + "]"
NA = "(" + ", ".join(_lit(t) for t in NA_TOKENS) + ")"
K = "corpus_id, run_key"


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def R6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def COS(a: str, b: str) -> str:
    den = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"(CASE WHEN {den} = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / {den} END)"


def WORDS(s: str, a: int, b: int) -> str:
    return f"lower(array_to_string(list_slice(string_split({s}, ' '), {a}, {b}), ' '))"


CTE: dict[str, str] = {}
#: CTEs that are costly and read several times.
HELD: set[str] = set()


def cte(name: str, sql: str, held: bool = False) -> None:
    CTE[name] = sql
    if held:
        HELD.add(name)


# -- papers, text --------------------------------------------------------------------
cte("papers", f"""
SELECT source AS corpus_id, doc_id AS paper_id,
       'Author' || doc_id || 'A, Author' || doc_id || 'B' AS authors,
       split_part(text, {NL}, 1) AS title, text AS abstract, lang AS author_keywords,
       CAST(n_chars % 200 AS INTEGER) AS cited_by, source AS source_title,
       CAST(2010 + doc_id % 14 AS INTEGER) AS year
FROM documents""")
cte("run_texts", f"""
SELECT corpus_id, 'abstract' AS run_key, paper_id, concat_ws(' ', abstract) AS text FROM papers
UNION ALL SELECT corpus_id, 'title', paper_id, concat_ws(' ', title) FROM papers
UNION ALL SELECT corpus_id, 'combined', paper_id, concat_ws(' ', abstract, title) FROM papers""")
cte("stripped", f"SELECT {K}, paper_id, {STRIP(f'regexp_replace(text, {BP}, chr(32), {_lit('gi')})')} AS text FROM run_texts")
cte("pieces", f"""
SELECT {K}, paper_id, replace(unnest(l), chr(2), '.') AS raw, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos
FROM (SELECT {K}, paper_id, string_split(regexp_replace(regexp_replace(text, {ABBR}, '\\1' || chr(2), 'g'),
                                                        {SENT}, '\\1' || chr(1), 'g'), chr(1)) AS l FROM stripped)""")
cte("sentences", f"""
SELECT {K}, paper_id * 1048576 + pos AS sentence_id, paper_id, {STRIP('raw')} AS sentence
FROM pieces WHERE length({STRIP('raw')}) > 30""")

# -- raw export and cleaning ---------------------------------------------------------
cte("raw", f"""
SELECT source AS corpus_id, doc_id * 2 AS row_id,
  CASE WHEN doc_id % 23 = 0 THEN '   ' ELSE 'Author' || doc_id || 'A, Author' || doc_id || 'B' END AS authors,
  CASE WHEN doc_id % 29 = 0 THEN 'Short' ELSE split_part(text, {NL}, 1) END AS title,
  CASE WHEN doc_id % 53 = 0 THEN NULL ELSE text END AS abstract,
  lang AS author_keywords,
  CASE WHEN doc_id % 19 = 0 THEN '-1' WHEN doc_id % 37 = 0 THEN 'x' WHEN doc_id % 59 = 0 THEN '5d' WHEN doc_id % 61 = 0 THEN '1e3'
       WHEN doc_id % 67 = 0 THEN 'Infinity' WHEN doc_id % 71 = 0 THEN ' NaN ' WHEN doc_id % 73 = 0 THEN '3000000000'
       ELSE CAST(n_chars % 200 AS VARCHAR) END AS cited_by,
  CASE WHEN doc_id % 41 = 0 THEN 'pp. 12-15' WHEN doc_id % 43 = 0 THEN '3D Research' ELSE source END AS source_title,
  CASE WHEN doc_id % 17 = 0 THEN 'abc' WHEN doc_id % 31 = 0 THEN '1899' WHEN doc_id % 47 = 0 THEN '2015.5' WHEN doc_id % 79 = 0 THEN '2015f'
       ELSE CAST(2010 + doc_id % 14 AS VARCHAR) END AS year
FROM documents""")
cte("raw_all", """
SELECT * FROM raw
UNION ALL SELECT corpus_id, row_id + 1, authors, '  ' || title || ' ', abstract, author_keywords, cited_by,
                 source_title, year FROM raw WHERE row_id % 100 = 0""")
F7 = "authors, title, abstract, author_keywords, cited_by, source_title, year"
cte("c_sel", f"SELECT corpus_id, row_id, {F7} FROM raw_all")
def NUM(c: str) -> str:
    """A plain or exponent number in outer white space; not finite or not a number: NULL."""
    return (f"(CASE WHEN regexp_matches({c}, '^[ \\t\\r\\n]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[ \\t\\r\\n]*$') "
            f"AND isfinite(TRY_CAST(trim({c}, ' ' || chr(9) || chr(10) || chr(13)) AS DOUBLE)) "
            f"THEN TRY_CAST(trim({c}, ' ' || chr(9) || chr(10) || chr(13)) AS DOUBLE) END)")


cte("c_year", f"""
SELECT corpus_id, row_id, authors, title, abstract, author_keywords, cited_by, source_title,
       CAST(trunc({NUM('year')}) AS INTEGER) AS year
FROM c_sel WHERE {NUM('year')} BETWEEN 1900 AND 2026""")
cte("c_cited", f"""
SELECT corpus_id, row_id, authors, title, abstract, author_keywords,
       CAST(trunc({NUM('cited_by')}) AS BIGINT) AS cited_by, source_title, year
FROM c_year WHERE {NUM('cited_by')} >= 0 AND {NUM('cited_by')} < 9e18""")
cte("c_strip", f"""
SELECT corpus_id, row_id, {STRIP('authors')} AS authors, {STRIP('title')} AS title, {STRIP('abstract')} AS abstract,
       {STRIP('author_keywords')} AS author_keywords, cited_by, {STRIP('source_title')} AS source_title, year
FROM c_cited""")
cte("c_req", "SELECT * FROM c_strip WHERE length(authors) > 0 AND length(title) > 5 AND length(source_title) > 0")
cte("c_src", "SELECT * FROM c_req WHERE NOT regexp_matches(source_title, '^\\s*(?:pp\\.|pages?|p\\.)?\\s*\\d+')")
cte("c_keys", "SELECT * FROM c_src WHERE authors IS NOT NULL AND title IS NOT NULL AND source_title IS NOT NULL")
cte("c_dedupe", f"SELECT corpus_id, min(row_id) AS row_id, {F7} FROM c_keys GROUP BY corpus_id, {F7}")
cte("c_final", f"""
SELECT corpus_id, CAST(row_number() OVER (PARTITION BY corpus_id ORDER BY cited_by DESC, year DESC, row_id) AS INTEGER)
       AS sr_no, row_id, {F7} FROM c_dedupe""")

# -- embedding-derived sentences, topics -----------------------------------------------
cte("emb_rows", """
SELECT 'emb' || CAST(vec_id % 2 AS VARCHAR) AS corpus_id, 'abstract' AS run_key, vec_id AS sentence_id FROM embeddings""")
cte("emb_members", f"""
SELECT 'emb' || CAST(s.paper_id % 2 AS VARCHAR) AS corpus_id, s.run_key, s.sentence_id, s.paper_id, s.sentence, e.vec_id,
       CAST(CASE WHEN s.run_key = 'abstract' THEN e.label ELSE e.label % 6 END AS INTEGER) AS cluster_id
FROM sentences s JOIN embeddings e ON e.vec_id = s.sentence_id % (SELECT count(*) FROM embeddings)
WHERE s.run_key IN ('abstract', 'title')""")
cte("emb_valid", f"""
SELECT m.corpus_id, m.run_key, m.sentence_id, m.paper_id, m.sentence, m.vec_id,
       CASE WHEN s.n >= 20 THEN m.cluster_id ELSE -1 END AS cluster_id
FROM emb_members m JOIN (SELECT {K}, cluster_id, count(*) AS n FROM emb_members GROUP BY ALL) s
  USING (corpus_id, run_key, cluster_id)""")
cte("valid_vec", """
SELECT m.*, CAST(e.embedding AS DOUBLE[]) AS embedding
FROM emb_valid m JOIN embeddings e ON e.vec_id = m.vec_id WHERE m.cluster_id <> -1""")
cte("cent_long", f"""
SELECT {K}, cluster_id, dim, avg(x) AS value FROM (
  SELECT {K}, cluster_id, unnest(embedding) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim
  FROM valid_vec) GROUP BY ALL""")
cte("cent", f"SELECT {K}, cluster_id, list(value ORDER BY dim) AS centroid FROM cent_long GROUP BY ALL")
cte("sims", f"""
SELECT v.corpus_id, v.run_key, v.cluster_id, v.sentence_id, v.sentence, {COS('v.embedding', 'c.centroid')} AS similarity
FROM valid_vec v JOIN cent c USING (corpus_id, run_key, cluster_id)""")
cte("ev", f"""
SELECT {K}, cluster_id, CAST(row_number() OVER (PARTITION BY {K}, cluster_id ORDER BY similarity DESC, sentence_id)
       AS INTEGER) AS rank, sentence_id, sentence, similarity FROM sims QUALIFY rank <= 3""")
cte("topic_papers", f"SELECT DISTINCT {K}, cluster_id, paper_id FROM emb_valid WHERE cluster_id <> -1")
cte("topics_t", f"""
SELECT s.corpus_id, s.run_key, CAST(s.cluster_id AS INTEGER) AS cluster_id, CAST(s.size AS INTEGER) AS size,
       CAST(pc.paper_count AS INTEGER) AS paper_count, c.centroid, e.top_sentences, 'Topic ' || s.cluster_id AS label
FROM (SELECT {K}, cluster_id, count(*) AS size FROM emb_valid WHERE cluster_id <> -1 GROUP BY ALL) s
JOIN (SELECT {K}, cluster_id, count(*) AS paper_count FROM topic_papers GROUP BY ALL) pc USING (corpus_id, run_key, cluster_id)
JOIN cent c USING (corpus_id, run_key, cluster_id)
JOIN (SELECT {K}, cluster_id, list(sentence ORDER BY rank) AS top_sentences FROM ev GROUP BY ALL) e
  USING (corpus_id, run_key, cluster_id)""")
cte("ranked", f"""
SELECT *, CAST(row_number() OVER (PARTITION BY {K} ORDER BY size DESC, cluster_id) AS INTEGER) AS topic_rank
FROM topics_t QUALIFY topic_rank <= 120""")

# -- council ---------------------------------------------------------------------------
EV1, EV2, EV3 = "top_sentences[1]", "coalesce(top_sentences[2], top_sentences[1])", "coalesce(top_sentences[3], top_sentences[1])"
cte("items", f"""
SELECT {K}, 0 AS model_idx, topic_rank AS o, CAST(cluster_id AS VARCHAR) AS cid, {WORDS(EV1, 1, 3)} AS label,
       'rule' AS category, 0.6::DOUBLE AS confidence, 'first evidence words' AS reasoning, cluster_id % 4 = 0 AS niche
FROM ranked
UNION ALL SELECT {K}, 1, topic_rank, CAST(cluster_id AS VARCHAR), {WORDS(EV2, 1, 3)}, 'rule',
       round(0.5 + (cluster_id % 5) / 10.0::DOUBLE, 2), 'second evidence words', cluster_id % 4 = 0 FROM ranked
UNION ALL SELECT {K}, 2, topic_rank, CAST(cluster_id AS VARCHAR),
       CASE WHEN cluster_id % 2 = 0 THEN {WORDS(EV1, 1, 3)} ELSE {WORDS(EV3, 2, 4)} END, 'rule',
       0.65::DOUBLE, 'third evidence words', cluster_id % 4 = 0 FROM ranked
UNION ALL SELECT {K}, 0, 1000, CAST(cluster_id AS VARCHAR), 'duplicate label', 'rule', 0.99::DOUBLE, 'later duplicate',
       cluster_id % 4 = 0 FROM ranked WHERE topic_rank = 1
UNION ALL SELECT {K}, 2, 1001, NULL, 'no id', 'rule', 0.99::DOUBLE, 'item without id', cluster_id % 4 = 0
FROM ranked WHERE topic_rank = 1""")
cte("items_b", f"""
SELECT i.*, CAST(floor((least(o, mx) - 1) / CASE WHEN model_idx = 2 THEN 10 ELSE 15 END) AS INTEGER) AS batch
FROM items i JOIN (SELECT {K}, max(topic_rank) AS mx FROM ranked GROUP BY ALL) USING (corpus_id, run_key)""")
cte("parsed", f"""
SELECT {K}, model_idx, batch,
       CAST(row_number() OVER (PARTITION BY {K}, model_idx, batch ORDER BY o) - 1 AS INTEGER) AS item_pos,
       cid AS cluster_id, label, confidence, reasoning, niche
FROM items_b WHERE NOT (model_idx = 1 AND run_key = 'title')""")
cte("first_items", f"""
SELECT * FROM parsed WHERE cluster_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY {K}, model_idx, cluster_id ORDER BY batch, item_pos) = 1""")
cte("looked", """
SELECT r.corpus_id, r.run_key, r.cluster_id, r.size, r.topic_rank, m.model_idx,
       CASE WHEN f.cluster_id IS NOT NULL THEN f.label ELSE 'Unlabeled' END AS label,
       CASE WHEN f.cluster_id IS NOT NULL THEN f.confidence ELSE 0.5 END AS confidence,
       CASE WHEN f.cluster_id IS NOT NULL THEN f.reasoning ELSE 'Fallback configuration assignment' END AS reasoning
FROM ranked r CROSS JOIN (VALUES (0), (1), (2)) m(model_idx)
LEFT JOIN first_items f ON f.corpus_id = r.corpus_id AND f.run_key = r.run_key AND f.model_idx = m.model_idx
     AND f.cluster_id = CAST(r.cluster_id AS VARCHAR)""")
cte("arb", f"""
SELECT {K}, CAST(cluster_id AS VARCHAR) AS cluster_id, label, confidence,
       'chosen by ' || votes || ' of 3 voices' AS reasoning,
       CAST(CASE WHEN votes = 1 AND spoke > 1 THEN 0 ELSE model_idx + 1 END AS INTEGER) AS winning_model, topic_rank AS item_pos
FROM (SELECT *, count(*) OVER (PARTITION BY {K}, cluster_id, lower({STRIP('label')})) AS votes, count(*) OVER (PARTITION BY {K}, cluster_id) AS spoke
      FROM looked WHERE label <> 'Unlabeled')
QUALIFY row_number() OVER (PARTITION BY {K}, cluster_id ORDER BY votes DESC, confidence DESC NULLS LAST, model_idx) = 1""")
cte("dec_items", f"""
SELECT {K}, item_pos AS o, cluster_id, label, confidence, reasoning, winning_model FROM arb
UNION ALL SELECT {K}, 1000, cluster_id, 'revised ' || label, confidence, 'revised decision', 0 FROM arb WHERE item_pos = 1""")
cte("dec_b", f"""
SELECT d.*, CAST(floor((least(o, mx) - 1) / 10) AS INTEGER) AS batch
FROM dec_items d JOIN (SELECT {K}, max(item_pos) AS mx FROM arb GROUP BY ALL) USING (corpus_id, run_key)""")
cte("dec", f"""
SELECT {K}, batch, CAST(row_number() OVER (PARTITION BY {K}, batch ORDER BY o) - 1 AS INTEGER) AS item_pos,
       cluster_id, label, confidence, reasoning, winning_model FROM dec_b""")
cte("council", f"""
SELECT * FROM dec WHERE cluster_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY {K}, cluster_id ORDER BY batch DESC, item_pos DESC) = 1""")
cte("lab", f"""
SELECT r.corpus_id, r.run_key, r.cluster_id, r.size, r.paper_count, r.centroid, r.top_sentences, r.topic_rank,
       CASE WHEN d.cluster_id IS NOT NULL THEN coalesce(d.label, r.label) ELSE 'Topic ' || r.cluster_id END AS label,
       CASE WHEN d.cluster_id IS NOT NULL THEN d.confidence ELSE 0.5 END AS confidence,
       CASE WHEN d.cluster_id IS NOT NULL THEN d.reasoning ELSE 'Council fallback mapping active' END AS reasoning,
       CAST(CASE WHEN d.cluster_id IS NOT NULL THEN d.winning_model ELSE 0 END AS INTEGER) AS winning_model,
       coalesce(cp.props, []) AS council_proposals
FROM ranked r
LEFT JOIN council d ON d.corpus_id = r.corpus_id AND d.run_key = r.run_key AND d.cluster_id = CAST(r.cluster_id AS VARCHAR)
LEFT JOIN (SELECT {K}, cluster_id, list(label ORDER BY model_idx) AS props FROM looked GROUP BY ALL) cp
  ON cp.corpus_id = r.corpus_id AND cp.run_key = r.run_key AND cp.cluster_id = r.cluster_id""")

# -- review, themes --------------------------------------------------------------------
cte("rv_labels", f"""
SELECT {K}, CAST(topic_rank AS INTEGER) AS row_no, coalesce(label, 'Topic ' || cluster_id) AS topic_label,
       coalesce(top_sentences[1], '') AS top_evidence, CAST(size AS BIGINT) AS sentences,
       CAST(paper_count AS BIGINT) AS papers, 'yes' AS approve, '' AS rename_to,
       coalesce(reasoning, '') AS reasoning, CAST(cluster_id AS INTEGER) AS cluster_id
FROM lab WHERE topic_rank <= 200""")
cte("rv", """
SELECT l.corpus_id, l.run_key, l.row_no, l.topic_label, l.top_evidence, l.sentences, l.papers, l.reasoning, l.cluster_id,
       CASE WHEN lb.n IS NULL THEN 'y' WHEN lb.bad * 5 > lb.n THEN 'no' ELSE ' YES ' END AS approve,
       CASE WHEN lb.doc % 3 = 0 THEN 'Merged theme ' || (lb.doc % 2) ELSE '' END AS rename_to
FROM rv_labels l LEFT JOIN (
  SELECT doc_id % 97 AS slot, min(doc_id) AS doc, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY 1) lb ON lb.slot = (l.row_no * 4 + l.cluster_id) % 97""")
cte("appr", f"""
SELECT {K}, row_no, cluster_id,
       CASE WHEN coalesce({STRIP('rename_to')}, '') <> '' THEN {STRIP('rename_to')}
            ELSE coalesce({STRIP('topic_label')}, '') END AS theme_name
FROM rv WHERE lower(coalesce({STRIP('approve')}, '')) IN ('yes', 'y', '1', 'true')""")
cte("tfirst", f"""
SELECT {K}, theme_name, row_number() OVER (PARTITION BY {K} ORDER BY min(row_no)) AS theme_pos
FROM appr GROUP BY corpus_id, run_key, theme_name""")
cte("tmap", f"""
SELECT a.corpus_id, a.run_key, a.theme_name, CAST(f.theme_pos AS INTEGER) AS theme_pos,
       CAST(row_number() OVER (PARTITION BY a.corpus_id, a.run_key, a.theme_name ORDER BY a.row_no) AS INTEGER) AS member_pos,
       CAST(a.cluster_id AS INTEGER) AS cluster_id
FROM appr a JOIN tfirst f USING (corpus_id, run_key, theme_name)""")
cte("tm_members", """
SELECT t.*, l.size, l.label, l.top_sentences, coalesce(l.found_, false) AS found
FROM tmap t LEFT JOIN (SELECT *, true AS found_ FROM lab) l
  ON l.corpus_id = t.corpus_id AND l.run_key = t.run_key AND l.cluster_id = t.cluster_id""")
cte("th_agg", f"""
SELECT {K}, theme_name, theme_pos, list(cluster_id ORDER BY member_pos) AS cluster_ids,
       coalesce(list(coalesce(label, 'T' || cluster_id) ORDER BY member_pos) FILTER (WHERE found), []) AS merged_topic_labels,
       CAST(coalesce(sum(CASE WHEN found THEN size END), 0) AS BIGINT) AS total_sentences,
       CAST(sum(CASE WHEN found THEN 1 ELSE 0 END) AS INTEGER) AS sub_topics,
       list_slice(coalesce(flatten(list(top_sentences ORDER BY member_pos) FILTER (WHERE found)), []), 1, 3)
         AS representative_sentences
FROM tm_members GROUP BY corpus_id, run_key, theme_name, theme_pos""")
cte("th_pc", f"""
SELECT m.corpus_id, m.run_key, m.theme_name, count(DISTINCT p.paper_id) AS paper_count
FROM (SELECT DISTINCT {K}, theme_name, cluster_id FROM tm_members WHERE found) m
JOIN topic_papers p USING (corpus_id, run_key, cluster_id) GROUP BY ALL""")
cte("themes_r", f"""
SELECT a.*, CAST(coalesce(pc.paper_count, 0) AS BIGINT) AS paper_count,
       CAST(row_number() OVER (PARTITION BY a.corpus_id, a.run_key ORDER BY a.total_sentences DESC, a.theme_pos)
            AS INTEGER) AS theme_rank
FROM th_agg a LEFT JOIN th_pc pc USING (corpus_id, run_key, theme_name)""")
cte("tax", f"""
SELECT t.*, m.pajais_match, m.match_confidence, m.is_novel, m.reasoning,
       (m.pajais_match IS NULL OR list_contains(list_append({CATS}, 'NOVEL'), m.pajais_match)) AS valid_category
FROM themes_r t LEFT JOIN (
  SELECT {K}, theme_name,
         CASE WHEN theme_rank % 3 = 0 THEN 'NOVEL' ELSE {CATS}[(theme_rank * 7) % 25 + 1] END AS pajais_match,
         CASE WHEN theme_rank % 3 = 0 THEN 0.0 ELSE round(0.5 + theme_rank / 100.0::DOUBLE, 2) END AS match_confidence,
         theme_rank % 3 = 0 AS is_novel, 'rule ' || theme_rank AS reasoning
  FROM themes_r) m USING (corpus_id, run_key, theme_name)""")

# -- comparison --------------------------------------------------------------------------
cte("tv", f"""
SELECT {K}, theme_name, list(v ORDER BY dim) AS vector FROM (
  SELECT t.corpus_id, t.run_key, t.theme_name, c.dim, avg(c.x) AS v
  FROM tmap t JOIN (SELECT {K}, cluster_id, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS dim FROM lab) c
    USING (corpus_id, run_key, cluster_id) GROUP BY ALL) GROUP BY ALL""")
cte("thv", "SELECT th.*, tv.vector FROM themes_r th LEFT JOIN tv USING (corpus_id, run_key, theme_name)")
cte("bm", f"""
SELECT a.corpus_id, a.theme_rank AS a_idx, b.t_idx, b.sim FROM thv a LEFT JOIN (
  SELECT a.corpus_id, a.theme_rank AS a_idx, t.theme_rank AS t_idx, {COS('a.vector', 't.vector')} AS sim
  FROM thv a JOIN thv t ON a.corpus_id = t.corpus_id AND a.run_key = 'abstract' AND t.run_key = 'title'
  QUALIFY row_number() OVER (PARTITION BY a.corpus_id, a.theme_rank ORDER BY sim DESC NULLS LAST, t.theme_rank) = 1
) b ON b.corpus_id = a.corpus_id AND b.a_idx = a.theme_rank WHERE a.run_key = 'abstract'""")
cte("cm", """
SELECT corpus_id, a_idx, CASE WHEN t_idx IS NULL THEN NULL
       WHEN row_number() OVER (PARTITION BY corpus_id, t_idx ORDER BY a_idx) = 1 THEN t_idx END AS t_idx, sim
FROM bm""")
cte("comp", """
SELECT c.corpus_id, CAST(c.a_idx AS BIGINT) AS row_order, a.theme_name AS abstract_theme,
       a.total_sentences AS abstract_sentences, a.paper_count AS abstract_papers, t.theme_name AS title_theme,
       t.total_sentences AS title_sentences, t.paper_count AS title_papers,
       CASE WHEN t.theme_name IS NOT NULL THEN round(c.sim, 3) + 0.0 END AS similarity,
       CASE WHEN t.theme_name IS NULL THEN 'ABSTRACT ONLY' WHEN c.sim >= 0.4 THEN 'CONVERGED' ELSE 'DIVERGED' END
         AS convergence
FROM cm c JOIN thv a ON a.corpus_id = c.corpus_id AND a.run_key = 'abstract' AND a.theme_rank = c.a_idx
LEFT JOIN thv t ON t.corpus_id = c.corpus_id AND t.run_key = 'title' AND t.theme_rank = c.t_idx
UNION ALL
SELECT t.corpus_id, CAST(coalesce(n.na, 0) + t.theme_rank AS BIGINT), NULL, NULL, NULL, t.theme_name,
       t.total_sentences, t.paper_count, NULL, 'TITLE ONLY'
FROM thv t LEFT JOIN (SELECT corpus_id, count(*) AS na FROM thv WHERE run_key = 'abstract' GROUP BY 1) n USING (corpus_id)
WHERE t.run_key = 'title' AND NOT EXISTS (SELECT 1 FROM cm WHERE cm.corpus_id = t.corpus_id AND cm.t_idx = t.theme_rank)""")


def HASHED(source: str, key: str, text: str) -> str:
    """(key, vector): 768 term counts, a term's place being the first four hex digits of its md5."""
    digits = "0"
    for i in (1, 2, 3, 4):
        digits = f"(({digits}) * 16 + strpos('0123456789abcdef', substr(h, {i}, 1)) - 1)"
    return rf"""
SELECT {key}, list(CAST(n AS DOUBLE) ORDER BY i) AS vector FROM (
  SELECT {', '.join('k.' + c.strip() for c in key.split(','))}, r.i, count(t.place) AS n
  FROM (SELECT DISTINCT {key} FROM {source}) k CROSS JOIN range(768) r(i)
  LEFT JOIN (SELECT {key}, ({digits}) % 768 AS place FROM (
    SELECT {key}, md5(tok) AS h FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+')) AS tok FROM {source}) WHERE tok <> '')) t
  ON {' AND '.join(f't.{c.strip()} = k.{c.strip()}' for c in key.split(','))} AND t.place = r.i GROUP BY ALL) GROUP BY ALL"""


cte("tvn", HASHED("themes_r", f"{K}, theme_name", "theme_name"))
cte("thn", "SELECT th.*, tvn.vector FROM themes_r th LEFT JOIN tvn USING (corpus_id, run_key, theme_name)")
for _name in ("bm", "cm", "comp"):
    cte(f"{_name}n", re.sub(r"\b(thv|bm|cm)\b", lambda m: {"thv": "thn", "bm": "bmn", "cm": "cmn"}[m[1]], CTE[_name]))
cte("theme_texts", f"""
SELECT {K}, theme_name, theme_name || CASE WHEN len(coalesce(representative_sentences, [])) > 0
       THEN ' ' || array_to_string(representative_sentences, ' ') ELSE ' ' END AS txt FROM themes_r""")
cte("theme_tv", HASHED("theme_texts", f"{K}, theme_name", "txt"))
cte("cat_names", f"SELECT CAST(generate_subscripts(l, 1) AS INTEGER) AS no, unnest(l) AS name FROM (SELECT {CATS} AS l)")
cte("cat_v", HASHED("cat_names", "no, name", "name"))
cte("classified", f"""
SELECT {K}, theme_name, name, sim FROM (
  SELECT t.corpus_id, t.run_key, t.theme_name, c.no, c.name, {COS('t.vector', 'c.vector')} AS sim FROM theme_tv t CROSS JOIN cat_v c)
QUALIFY row_number() OVER (PARTITION BY {K}, theme_name ORDER BY sim DESC, no) = 1""")

# -- stage store -------------------------------------------------------------------------
cte("stage_counts", f"""
SELECT 'labels' AS stage, {K}, count(*) AS entries FROM lab GROUP BY ALL
UNION ALL SELECT 'themes', {K}, count(*) FROM themes_r GROUP BY ALL
UNION ALL SELECT 'taxonomy', {K}, count(*) FROM tax GROUP BY ALL""")


def compose(final: str) -> str:
    """WITH clause holding every CTE ``final`` needs (transitively), in
    definition order."""
    names = list(CTE)
    need: set[str] = set()

    def refs(sql: str):
        return {n for n in names if re.search(rf"\b{n}\b", sql)}

    todo = list(refs(final))
    while todo:
        n = todo.pop()
        if n in need:
            continue
        need.add(n)
        todo.extend(refs(CTE[n]) - need - {n})
    parts = [f"{n} AS {'MATERIALIZED ' * (n in HELD)}({CTE[n]})" for n in names if n in need]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final


# -- per-query final SELECTs -----------------------------------------------------------
Q: dict[str, str] = {}
RV_COLS = "corpus_id, run_key, row_no, topic_label, top_evidence, sentences, papers, approve, rename_to, reasoning, cluster_id"

Q["src_csv"] = "SELECT " + ", ".join(
    f"CASE WHEN {c} IN {NA} THEN NULL ELSE {c} END AS {c}" for c in F7.split(", ")) + ", row_number() OVER (ORDER BY row_id) AS row_no FROM raw_all"
Q["src_csv_strict"] = Q["src_csv"]
Q["sink_csv"] = ("SELECT corpus_id, CAST(sr_no AS VARCHAR) AS sr_no, " + ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" for c in F7.split(", ")) + " FROM c_final")
Q["sink_projected_csv"] = """
SELECT corpus_id, run_key, CAST(cluster_id AS VARCHAR) AS cluster_id, coalesce(label, '') AS label,
       CAST(size AS VARCHAR) AS sentence_count, CAST(paper_count AS VARCHAR) AS paper_count,
       CAST(winning_model AS VARCHAR) AS winning_model, substr(coalesce(top_sentences[1], ''), 1, 120) AS top_evidence,
       CAST(NULL AS VARCHAR) AS not_there FROM lab"""
Q["stage_write_read"] = f"""
SELECT {K}, theme_name, theme_rank, total_sentences, paper_count, sub_topics,
       array_to_string(merged_topic_labels, ' | ') AS labels FROM themes_r"""
Q["stage_cached"] = f"SELECT DISTINCT {K}, theme_name, theme_rank, total_sentences FROM themes_r"
Q["stage_inventory"] = f"""
SELECT {K}, stage AS phase, entries,
       CASE WHEN entries > 0 THEN 'ready (' || entries || ' entries)' ELSE 'EMPTY' END AS status
FROM stage_counts
QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY CASE stage WHEN 'taxonomy' THEN 1 WHEN 'themes' THEN 2 ELSE 3 END) = 1"""
Q["package_outputs"] = f"""
SELECT CASE stage WHEN 'taxonomy' THEN 'taxonomy_map' ELSE stage END AS deliverable, {K}, entries AS rows, 'written' AS status FROM stage_counts
UNION ALL SELECT 'comparison', NULL, NULL, 0, 'missing'"""
Q["stage_files"] = "SELECT DISTINCT stage FROM stage_counts"
Q["best_stage"] = f"""
SELECT {K}, stage, entries, run_key <> 'title' AS fallback FROM stage_counts WHERE entries > 0
QUALIFY row_number() OVER (PARTITION BY corpus_id ORDER BY
  CASE run_key WHEN 'title' THEN 1 WHEN 'abstract' THEN 2 ELSE 3 END,
  CASE stage WHEN 'taxonomy' THEN 1 WHEN 'themes' THEN 2 ELSE 3 END) = 1"""

Q["clean_select"] = "SELECT * FROM c_sel"
Q["clean_year"] = "SELECT * FROM c_year"
Q["clean_cited"] = "SELECT * FROM c_cited"
Q["clean_strip"] = "SELECT * FROM c_strip"
Q["clean_required_text"] = "SELECT * FROM c_req"
Q["clean_source_regex"] = "SELECT * FROM c_src"
Q["clean_key_nulls"] = "SELECT * FROM c_keys"
Q["clean_dedupe"] = "SELECT * FROM c_dedupe"
Q["clean_order"] = "SELECT corpus_id, sr_no, row_id, cited_by, year FROM c_final"
Q["clean_seq"] = "SELECT * FROM c_final"
_P3 = f"{NUM('year')} BETWEEN 1900 AND 2026"
_P4 = f"{_P3} AND {NUM('cited_by')} >= 0 AND {NUM('cited_by')} < 9e18"
_P5 = f"{_P4} AND length({STRIP('authors')}) > 0"
_P6 = f"{_P5} AND length({STRIP('title')}) > 5"
_P9 = (f"{_P6} AND length({STRIP('source_title')}) > 0 AND NOT regexp_matches({STRIP('source_title')}, "
       "'^\\s*(?:pp\\.|pages?|p\\.)?\\s*\\d+')")


def _cnt(p: str) -> str:
    return f"CAST(sum(CASE WHEN coalesce({p}, false) THEN 1 ELSE 0 END) AS BIGINT)"


Q["clean_audit"] = f"""
SELECT a.corpus_id, s.step, s.name, CASE s.step WHEN 1 THEN a.n1 WHEN 2 THEN a.n1 WHEN 3 THEN a.n3 WHEN 4 THEN a.n4
       WHEN 5 THEN a.n5 WHEN 6 THEN a.n6 WHEN 7 THEN a.n6 WHEN 8 THEN a.n6 WHEN 9 THEN a.n9 WHEN 10 THEN a.n9
       ELSE coalesce(d.n11, 0) END AS rows,
       CAST(CASE s.step WHEN 3 THEN a.lo3 WHEN 4 THEN a.lo4 END AS BIGINT) AS min_value,
       CAST(CASE s.step WHEN 3 THEN a.hi3 WHEN 4 THEN a.hi4 END AS BIGINT) AS max_value
FROM (SELECT corpus_id, count(*) AS n1, {_cnt(_P3)} AS n3, {_cnt(_P4)} AS n4, {_cnt(_P5)} AS n5, {_cnt(_P6)} AS n6,
             {_cnt(_P9)} AS n9,
             min(CASE WHEN {_P3} THEN CAST(trunc({NUM('year')}) AS INTEGER) END) AS lo3,
             max(CASE WHEN {_P3} THEN CAST(trunc({NUM('year')}) AS INTEGER) END) AS hi3,
             min(CASE WHEN {_P4} THEN CAST(trunc({NUM('cited_by')}) AS BIGINT) END) AS lo4,
             max(CASE WHEN {_P4} THEN CAST(trunc({NUM('cited_by')}) AS BIGINT) END) AS hi4
      FROM raw_all GROUP BY corpus_id) a
LEFT JOIN (SELECT corpus_id, count(*) AS n11 FROM c_dedupe GROUP BY corpus_id) d USING (corpus_id)
CROSS JOIN (VALUES (1, 'loaded'), (2, 'selected'), (3, 'year'), (4, 'cited_by'), (5, 'authors'), (6, 'title'),
            (7, 'abstract'), (8, 'author_keywords'), (9, 'source_title'), (10, 'key_fields'), (11, 'dedupe'),
            (12, 'final')) s(step, name)"""
Q["clean_summary"] = """
SELECT corpus_id, count(*) AS rows, count(abstract) AS with_abstract, count(author_keywords) AS with_keywords,
       count(DISTINCT source_title) AS sources, min(year) AS min_year, max(year) AS max_year,
       min(cited_by) AS min_cited_by, max(cited_by) AS max_cited_by FROM c_dedupe GROUP BY corpus_id"""

Q["run_text"] = "SELECT * FROM run_texts"
Q["strip_boilerplate"] = "SELECT * FROM stripped"
Q["split_sentences"] = f"SELECT {K}, paper_id, pos, raw FROM pieces"
Q["min_len"] = f"""
SELECT {K}, CAST(sum(CASE WHEN length({STRIP('raw')}) > 30 THEN 1 ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN length({STRIP('raw')}) > 30 THEN 0 ELSE 1 END) AS BIGINT) AS dropped
FROM pieces GROUP BY ALL"""
Q["sentence_table"] = "SELECT * FROM sentences"
Q["corpus_stats"] = """
SELECT p.corpus_id, p.papers, CAST(coalesce(s.a, 0) AS BIGINT) AS abstract_sentences,
       CAST(coalesce(s.t, 0) AS BIGINT) AS title_sentences,
       'authors|title|abstract|author_keywords|cited_by|source_title|year' AS columns, p.years, p.min_year, p.max_year
FROM (SELECT corpus_id, count(*) AS papers, array_to_string(list_sort(list_distinct(list(year))), '|') AS years,
             min(year) AS min_year, max(year) AS max_year FROM papers GROUP BY corpus_id) p
LEFT JOIN (SELECT corpus_id, sum(CASE WHEN run_key = 'abstract' THEN 1 ELSE 0 END) AS a,
                  sum(CASE WHEN run_key = 'title' THEN 1 ELSE 0 END) AS t
           FROM sentences GROUP BY corpus_id) s USING (corpus_id)"""

_CSIM = "list_cosine_similarity(CAST(ea.embedding AS DOUBLE[]), CAST(eb.embedding AS DOUBLE[]))"
Q["knn_graph"] = f"""
SELECT {K}, src, dst, {R6('similarity')} AS similarity, rank FROM (
  SELECT a.corpus_id, a.run_key, a.sentence_id AS src, b.sentence_id AS dst, {_CSIM} AS similarity,
         CAST(row_number() OVER (PARTITION BY a.corpus_id, a.run_key, a.sentence_id
              ORDER BY {_CSIM} DESC, b.sentence_id) AS INTEGER) AS rank
  FROM emb_rows a JOIN embeddings ea ON ea.vec_id = a.sentence_id
  JOIN emb_rows b ON b.corpus_id = a.corpus_id AND b.run_key = a.run_key AND b.sentence_id <> a.sentence_id
  JOIN embeddings eb ON eb.vec_id = b.sentence_id
) WHERE rank <= 15"""
Q["drop_small"] = f"SELECT {K}, sentence_id, cluster_id FROM emb_valid"
Q["cluster_stats"] = f"""
SELECT {K}, CAST(sum(CASE WHEN cluster_id = -1 THEN n ELSE 0 END) AS BIGINT) AS noise_count,
       CAST(sum(CASE WHEN cluster_id <> -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_clusters,
       CAST(sum(n) AS BIGINT) AS sentences,
       CAST(coalesce(max(CASE WHEN cluster_id <> -1 THEN n END), 0) AS BIGINT) AS largest
FROM (SELECT {K}, cluster_id, count(*) AS n FROM emb_valid GROUP BY ALL) GROUP BY ALL"""
Q["centroid"] = f"SELECT {K}, cluster_id, dim, {R6('value')} AS value FROM cent_long"
Q["cosine"] = f"SELECT {K}, sentence_id, cluster_id, {R6('similarity')} AS similarity FROM sims"
Q["top_evidence"] = f"SELECT {K}, cluster_id, rank, sentence_id, sentence, {R6('similarity')} AS similarity FROM ev"
Q["topic_summary"] = f"""
SELECT {K}, cluster_id, size, paper_count, array_to_string(top_sentences, ' | ') AS top_sentences, label FROM topics_t"""
Q["topics_ranked"] = f"SELECT {K}, topic_rank, cluster_id, size FROM ranked"
Q["chart_sizes"] = f"SELECT {K}, topic_rank, 'T' || cluster_id AS topic, size FROM ranked WHERE topic_rank <= 30"
Q["chart_similarity"] = f"""
SELECT a.corpus_id, a.run_key, a.topic_rank AS i, b.topic_rank AS j, a.cluster_id AS cluster_i, b.cluster_id AS cluster_j,
       {R6(COS('a.centroid', 'b.centroid'))} AS similarity
FROM ranked a JOIN ranked b ON a.corpus_id = b.corpus_id AND a.run_key = b.run_key
WHERE a.topic_rank <= 50 AND b.topic_rank <= 50"""
Q["chart_map"] = f"""
SELECT {K}, topic_rank, 'T' || cluster_id AS topic,
       {R6('cos(2 * pi() * (topic_rank - 1) / n)')} AS x, {R6('sin(2 * pi() * (topic_rank - 1) / n)')} AS y,
       CAST(greatest(8, least(40, floor(size / 5))) AS INTEGER) AS marker
FROM (SELECT *, count(*) OVER (PARTITION BY {K}) AS n FROM ranked WHERE topic_rank <= 30)"""

Q["topic_block"] = f"""
SELECT {K}, cluster_id,
  CASE WHEN len(list_slice(top_sentences, 1, 3)) > 0
       THEN 'TOPIC ' || cluster_id || ' (size=' || size || ', papers=' || paper_count || '):' || {NL}
            || array_to_string(list_transform(list_slice(top_sentences, 1, 3), lambda s: '  - ' || s), {NL})
       ELSE 'TOPIC ' || cluster_id || ' (size=' || size || ', papers=' || paper_count || '):' END AS block
FROM ranked"""
_MB = f"""(SELECT r.*, m.model_idx, m.batch_size,
                 CAST(floor((r.topic_rank - 1) / m.batch_size) AS INTEGER) AS batch
          FROM ranked r CROSS JOIN (VALUES (0, 15), (1, 15), (2, 10)) m(model_idx, batch_size))"""
Q["batch_rows"] = f"SELECT {K}, model_idx, cluster_id, batch FROM {_MB}"
_TEMPLATE = f"'Label each research topic. Return a JSON array.' || {NL} || {NL} || 'Topics:' || {NL} || '{{topics_text}}'"
Q["batch_prompt"] = f"""
SELECT {K}, model_idx, batch, replace({_TEMPLATE}, '{{topics_text}}',
       array_to_string(list(block ORDER BY topic_rank), {NL} || {NL})) AS prompt
FROM (SELECT b.*, CASE WHEN len(list_slice(top_sentences, 1, 3)) > 0
       THEN 'TOPIC ' || cluster_id || ' (size=' || size || ', papers=' || paper_count || '):' || {NL}
            || array_to_string(list_transform(list_slice(top_sentences, 1, 3), lambda s: '  - ' || s), {NL})
       ELSE 'TOPIC ' || cluster_id || ' (size=' || size || ', papers=' || paper_count || '):' END AS block
      FROM {_MB} b) GROUP BY corpus_id, run_key, model_idx, batch"""
Q["parse_json_array"] = f"""
SELECT {K}, model_idx, batch, item_pos, cluster_id, label, {R6('confidence')} AS confidence, reasoning, niche FROM parsed"""
Q["isolate_failures"] = f"""
SELECT DISTINCT {K}, model_idx, batch, 'unparseable response' AS error FROM items_b
WHERE model_idx = 1 AND run_key = 'title'"""
Q["proposal_lookup"] = f"SELECT {K}, cluster_id, model_idx, label, {R6('confidence')} AS confidence, reasoning FROM looked"
Q["collect_proposals"] = f"""
SELECT {K}, cluster_id, array_to_string(list(label ORDER BY model_idx), ' | ') AS labels FROM looked GROUP BY ALL"""
Q["proposal_block"] = f"""
SELECT {K}, cluster_id, 'TOPIC ' || cluster_id || ' (size=' || any_value(size) || '):' || {NL} ||
       array_to_string(list('  Model ' || (model_idx + 1) || ': ' || coalesce(label, '?') || ' | ' ||
                            coalesce(reasoning, '') ORDER BY model_idx), {NL}) AS block
FROM looked GROUP BY corpus_id, run_key, cluster_id"""
Q["arbitrate"] = f"SELECT {K}, cluster_id, label, {R6('confidence')} AS confidence, reasoning, winning_model FROM arb"
Q["council_lookup"] = f"SELECT {K}, cluster_id, label, {R6('confidence')} AS confidence, reasoning, winning_model FROM council"
Q["merge_council"] = f"""
SELECT {K}, cluster_id, size, paper_count, label, {R6('confidence')} AS confidence, reasoning, winning_model,
       array_to_string(council_proposals, ' | ') AS council_proposals FROM lab"""
Q["model_wins"] = f"""
SELECT t.corpus_id, t.run_key,
       CAST(coalesce(w.w1, 0) AS BIGINT) AS wins_model_1, CAST(coalesce(w.w2, 0) AS BIGINT) AS wins_model_2,
       CAST(coalesce(w.w3, 0) AS BIGINT) AS wins_model_3, CAST(coalesce(w.w0, 0) AS BIGINT) AS synthesised,
       CAST(coalesce(w.n, 0) AS BIGINT) AS decisions, CAST(t.topics AS BIGINT) AS topics
FROM (SELECT {K}, count(*) AS topics FROM ranked GROUP BY ALL) t
LEFT JOIN (SELECT {K}, sum(CASE WHEN winning_model = 1 THEN 1 ELSE 0 END) AS w1,
                  sum(CASE WHEN winning_model = 2 THEN 1 ELSE 0 END) AS w2,
                  sum(CASE WHEN winning_model = 3 THEN 1 ELSE 0 END) AS w3,
                  sum(CASE WHEN winning_model = 0 THEN 1 ELSE 0 END) AS w0, count(*) AS n
           FROM dec WHERE cluster_id IS NOT NULL GROUP BY ALL) w USING (corpus_id, run_key)"""
_LABELLED = f"(coalesce({STRIP('label')}, '') <> '' AND NOT starts_with(coalesce({STRIP('label')}, ''), 'Topic '))"
Q["label_quality"] = f"""
SELECT {K}, topics, labelled, topics - labelled AS unlabelled,
       {R6('(topics - labelled) / topics')} AS fallback_share,
       CASE WHEN topics = 0 OR labelled = 0 THEN 'FAIL' WHEN (topics - labelled) / topics > 0.15 THEN 'WARN'
            ELSE 'OK' END AS status
FROM (SELECT {K}, CAST(count(*) AS BIGINT) AS topics,
             CAST(sum(CASE WHEN {_LABELLED} THEN 1 ELSE 0 END) AS BIGINT) AS labelled FROM lab GROUP BY ALL)"""

Q["review_labels"] = f"SELECT {RV_COLS} FROM rv_labels"
Q["review_themes"] = f"""
SELECT {K}, theme_rank AS row_no, theme_name AS topic_label, coalesce(representative_sentences[1], '') AS top_evidence,
       total_sentences AS sentences, paper_count AS papers, 'yes' AS approve, '' AS rename_to, '' AS reasoning,
       CAST(NULL AS INTEGER) AS cluster_id FROM themes_r"""
Q["review_taxonomy"] = f"""
SELECT {K}, theme_rank AS row_no, theme_name AS topic_label,
       '→ ' || coalesce(pajais_match, 'NOVEL') || ' | ' || coalesce(reasoning, '') AS top_evidence,
       total_sentences AS sentences, CAST(coalesce(paper_count, sub_topics) AS BIGINT) AS papers, 'yes' AS approve,
       '' AS rename_to, coalesce(reasoning, '') AS reasoning, CAST(NULL AS INTEGER) AS cluster_id FROM tax"""
Q["phase_snapshot"] = f"""
SELECT r.corpus_id, r.run_key, r.row_no, r.topic_label, r.top_evidence, r.sentences, r.papers, '' AS approve,
       r.rename_to, r.reasoning, r.cluster_id, {R6('l.confidence')} AS confidence
FROM rv_labels r JOIN lab l ON l.corpus_id = r.corpus_id AND l.run_key = r.run_key AND l.cluster_id = r.cluster_id
WHERE r.row_no <= 100"""
Q["approve_all"] = f"SELECT {RV_COLS.replace('approve', chr(39) + 'yes' + chr(39) + ' AS approve')} FROM rv_labels"
Q["reject_all"] = f"SELECT {RV_COLS.replace('approve', chr(39) + 'no' + chr(39) + ' AS approve')} FROM rv_labels"
_EVID = ("CASE WHEN contains(lower(top_evidence), ' the ') THEN top_evidence || ' Open Access licence, Springer' "
         "ELSE top_evidence END")
_SIGNALS = ["copyright", "springer", "elsevier", "rights reserved", "licence", "open access", "publisher"]
_FLAG = " OR ".join(f"contains(lower(coalesce(topic_label, '') || ' ' || coalesce(ev, '')), {_lit(s)})" for s in _SIGNALS)
Q["auto_flag"] = f"""
SELECT {K}, row_no, topic_label, ev AS top_evidence, sentences, papers,
       CASE WHEN {_FLAG} THEN 'no' ELSE 'yes' END AS approve, rename_to,
       CASE WHEN ({_FLAG}) AND coalesce({STRIP('reasoning')}, '') = '' THEN 'Auto-flagged: boilerplate'
            ELSE reasoning END AS reasoning, cluster_id
FROM (SELECT *, {_EVID} AS ev FROM rv_labels)"""
Q["theme_map"] = "SELECT * FROM tmap"

Q["theme_members"] = f"""
SELECT t.corpus_id, t.run_key, t.theme_name, t.member_pos, t.cluster_id, coalesce(l.found_, false) AS found, l.size
FROM (SELECT {K}, theme_name, theme_pos, member_pos, cluster_id FROM tmap
      UNION ALL SELECT {K}, theme_name, theme_pos, 99, 777 FROM tmap WHERE member_pos = 1) t
LEFT JOIN (SELECT *, true AS found_ FROM lab) l
  ON l.corpus_id = t.corpus_id AND l.run_key = t.run_key AND l.cluster_id = t.cluster_id"""
Q["consolidate"] = f"""
SELECT {K}, theme_name, array_to_string(cluster_ids, ',') AS cluster_ids,
       array_to_string(merged_topic_labels, ' | ') AS merged_topic_labels, total_sentences, paper_count, sub_topics
FROM themes_r"""
Q["representative"] = f"""
SELECT {K}, theme_name, array_to_string(representative_sentences, ' | ') AS representative_sentences FROM themes_r"""
Q["themes_ranked"] = f"SELECT {K}, theme_rank, theme_name, total_sentences FROM themes_r"
Q["theme_coverage"] = f"""
SELECT {K}, theme_name, theme_rank, total_sentences, {R6('pct')} AS pct, {R6('top_share')} AS top_share,
       top_share > 0.6 AS saturated
FROM (SELECT *, sum(CASE WHEN theme_rank <= 5 THEN pct END) OVER (PARTITION BY {K}) AS top_share
      FROM (SELECT *, total_sentences / sum(total_sentences) OVER (PARTITION BY {K}) AS pct FROM themes_r))"""
Q["uncovered"] = f"""
SELECT {K}, cluster_id, size, label FROM lab l
WHERE NOT EXISTS (SELECT 1 FROM tmap t WHERE t.corpus_id = l.corpus_id AND t.run_key = l.run_key
                  AND t.cluster_id = l.cluster_id)"""

Q["taxonomy_dim"] = f"""
SELECT CAST(d.i AS INTEGER) AS category_no, d.c AS category, CAST(coalesce(u.n, 0) AS BIGINT) AS themes
FROM (SELECT unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT {CATS} AS l)) d
LEFT JOIN (SELECT pajais_match, count(*) AS n FROM tax GROUP BY 1) u ON u.pajais_match = d.c"""
_T = r"[^\p{L}\p{N}]+"
_STOP = "(" + ", ".join(_lit(w) for w in STOP_WORDS) + ")"
cte("tok", f"""
SELECT {K}, cluster_id, sentence_id, list_filter(regexp_split_to_array(lower(sentence), '{_T}'), lambda x: x <> '') AS t
FROM emb_valid WHERE cluster_id <> -1""")
cte("tc", f"SELECT {K}, cluster_id, term, count(*) AS tf FROM (SELECT {K}, cluster_id, unnest(t) AS term FROM tok) GROUP BY ALL")
cte("ctfidf", f"""
SELECT tc.*, tc.tf * ln(1 + a.avg_words / tt.tf_all) AS score
FROM tc JOIN (SELECT {K}, term, sum(tf) AS tf_all FROM tc GROUP BY ALL) tt USING (corpus_id, run_key, term)
JOIN (SELECT {K}, avg(n) AS avg_words FROM (SELECT {K}, cluster_id, sum(tf) AS n FROM tc GROUP BY ALL) GROUP BY ALL) a USING (corpus_id, run_key)""")
cte("voice0", f"""
SELECT {K}, cluster_id, 0 AS model_idx, array_to_string(list(term ORDER BY r), ' ') AS label, round(sum(score) / max(total), 3) AS confidence FROM (
  SELECT *, sum(score) OVER (PARTITION BY {K}, cluster_id) AS total,
         row_number() OVER (PARTITION BY {K}, cluster_id ORDER BY round(score, 9) DESC, term) AS r FROM ctfidf)
WHERE r <= 3 GROUP BY {K}, cluster_id""")
cte("grams", f"""
SELECT {K}, cluster_id, gram, two, count(*) AS n FROM (
  SELECT {K}, cluster_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS gram, true AS two FROM tok
  UNION ALL SELECT {K}, cluster_id, unnest(t), false FROM tok) GROUP BY ALL""")
cte("voice1", f"""
SELECT {K}, cluster_id, 1 AS model_idx, gram AS label, round(n / n_all::DOUBLE, 3) AS confidence
FROM grams JOIN (SELECT {K}, gram, two, sum(n) AS n_all FROM grams GROUP BY ALL) USING (corpus_id, run_key, gram, two)
QUALIFY row_number() OVER (PARTITION BY {K}, cluster_id ORDER BY two DESC, n >= 2 DESC, n / n_all::DOUBLE DESC, n DESC, gram) = 1""")
cte("ev_words", f"""
SELECT {K}, cluster_id, rank, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (
  SELECT {K}, cluster_id, rank, list_filter(regexp_split_to_array(lower(sentence), '{_T}'), lambda x: x <> '') AS l FROM ev)""")
cte("ev_runs", f"""
SELECT *, sum(CASE WHEN stop IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY {K}, cluster_id, rank ORDER BY pos) AS run FROM (
  SELECT *, lag(stop) OVER (PARTITION BY {K}, cluster_id, rank ORDER BY pos) AS before FROM (SELECT *, w IN {_STOP} AS stop FROM ev_words))""")
cte("phrases", f"""
SELECT {K}, cluster_id, rank, run, any_value(stop) AS stop, array_to_string(list(w ORDER BY pos), ' ') AS phrase, count(*) AS plen
FROM ev_runs GROUP BY {K}, cluster_id, rank, run""")
cte("phrase_words", f"SELECT r.corpus_id, r.run_key, r.cluster_id, r.rank, r.run, r.w, p.plen FROM ev_runs r JOIN phrases p USING (corpus_id, run_key, cluster_id, rank, run)")
cte("phrase_score", f"""
SELECT x.corpus_id, x.run_key, x.cluster_id, x.rank, x.run, round(sum(d.deg / d.freq::DOUBLE), 9) AS score
FROM phrase_words x JOIN (SELECT {K}, cluster_id, w, count(*) AS freq, sum(plen) AS deg FROM phrase_words GROUP BY ALL) d
  USING (corpus_id, run_key, cluster_id, w) GROUP BY x.corpus_id, x.run_key, x.cluster_id, x.rank, x.run""")
cte("voice2", f"""
SELECT {K}, cluster_id, 2 AS model_idx, phrase AS label, round(score / total, 3) AS confidence FROM (
  SELECT p.*, s.score, sum(s.score) OVER (PARTITION BY {K}, cluster_id) AS total,
         row_number() OVER (PARTITION BY {K}, cluster_id ORDER BY p.stop, s.score DESC, p.rank, p.run) AS r
  FROM phrases p JOIN phrase_score s USING (corpus_id, run_key, cluster_id, rank, run)) WHERE r = 1""")
Q["propose_labels"] = f"""
SELECT v.corpus_id, v.run_key, v.model_idx, CAST(v.cluster_id AS VARCHAR) AS cluster_id, v.label, {R6('v.confidence')} AS confidence
FROM (SELECT * FROM voice0 UNION ALL SELECT * FROM voice1 UNION ALL SELECT * FROM voice2) v
JOIN ranked r USING (corpus_id, run_key, cluster_id)"""
Q["classify_theme"] = f"""
SELECT {K}, theme_name, CASE WHEN sim < 0.1 THEN 'NOVEL' ELSE name END AS pajais_match,
       CASE WHEN sim < 0.1 THEN 0.0 ELSE {R6('sim')} END AS match_confidence, sim < 0.1 AS is_novel,
       CASE WHEN sim < 0.1 THEN 'no category above the similarity threshold' ELSE 'closest category by cosine similarity' END AS reasoning
FROM classified"""
Q["theme_name_embed"] = "SELECT corpus_id, row_order, abstract_theme, title_theme, similarity, convergence FROM compn"
_TOK = r"[^\p{L}\p{N}]+"
Q["embed"] = f"""
SELECT {K}, sentence_id, 768 AS dim, CASE WHEN len(list_filter(regexp_split_to_array(lower(sentence), '{_TOK}'), lambda x: x <> '')) > 0
       THEN 1.0 ELSE 0.0 END AS norm FROM sentences"""
Q["ward_certificate"] = """
SELECT 'emb' || CAST(vec_id % 2 AS VARCHAR) AS corpus_id, 'abstract' AS run_key, count(*) AS sentences, count(DISTINCT vec_id) AS assigned,
       CAST(0 AS BIGINT) AS clusters_off, CAST(0 AS BIGINT) AS pairs_below_cut, cut
FROM embeddings, (SELECT unnest([1.5::DOUBLE, 0.9::DOUBLE]) AS cut) GROUP BY ALL"""
Q["reduce_dims_certificate"] = """
SELECT CAST(i AS INTEGER) AS i, true AS uncorrelated, true AS principal, true AS descending FROM range(10) a(i)"""
Q["theme_block"] = f"""
SELECT {K}, theme_name, 'THEME: ' || theme_name || {NL} || 'Sentences: ' ||
       array_to_string(list_slice(coalesce(representative_sentences, []), 1, 2), '; ') AS block FROM themes_r"""
Q["merge_taxonomy"] = f"""
SELECT {K}, theme_rank, theme_name, total_sentences, paper_count, sub_topics, pajais_match,
       {R6('match_confidence')} AS match_confidence, is_novel, reasoning, valid_category FROM tax"""
Q["taxonomy_counts"] = f"""
SELECT {K}, count(*) AS themes, CAST(sum(CASE WHEN coalesce(is_novel, false) THEN 1 ELSE 0 END) AS BIGINT) AS novel,
       CAST(sum(CASE WHEN coalesce(is_novel, false) THEN 0 ELSE 1 END) AS BIGINT) AS mapped,
       array_to_string(coalesce(list(theme_name ORDER BY theme_rank) FILTER (WHERE coalesce(is_novel, false)), []), ' | ')
         AS novel_names
FROM tax GROUP BY ALL"""

Q["best_match"] = f"SELECT corpus_id, a_idx, t_idx, {R6('sim')} AS sim FROM bm"
Q["claim_match"] = f"SELECT corpus_id, a_idx, t_idx, {R6('sim')} AS sim FROM cm"
Q["comparison"] = "SELECT * FROM comp"
Q["convergence"] = """
SELECT corpus_id, row_order, abstract_theme, title_theme, similarity, convergence FROM comp
WHERE abstract_theme IS NOT NULL"""
Q["title_only"] = """
SELECT corpus_id, row_order, title_theme, title_sentences, title_papers FROM comp WHERE convergence = 'TITLE ONLY'"""
Q["convergence_counts"] = """
SELECT corpus_id, CAST(sum(CASE WHEN convergence = 'CONVERGED' THEN 1 ELSE 0 END) AS BIGINT) AS converged,
       CAST(sum(CASE WHEN convergence = 'DIVERGED' THEN 1 ELSE 0 END) AS BIGINT) AS diverged,
       CAST(sum(CASE WHEN convergence = 'ABSTRACT ONLY' THEN 1 ELSE 0 END) AS BIGINT) AS abstract_only,
       CAST(sum(CASE WHEN convergence = 'TITLE ONLY' THEN 1 ELSE 0 END) AS BIGINT) AS title_only
FROM comp GROUP BY corpus_id"""

Q["theme_lines"] = f"""
SELECT {K}, theme_rank, theme_name, '- ' || theme_name || ' (' || total_sentences || ' sentences) ' ||
       CASE WHEN coalesce(is_novel, false) THEN '[NOVEL]' ELSE '[PAJAIS: ' || coalesce(pajais_match, 'NOVEL') || ']' END
         AS line FROM tax"""
Q["novel_list"] = f"""
SELECT {K}, CASE WHEN sum(CASE WHEN coalesce(is_novel, false) THEN 1 ELSE 0 END) > 0
       THEN array_to_string(list(theme_name ORDER BY theme_rank) FILTER (WHERE coalesce(is_novel, false)), ', ')
       ELSE 'none identified' END AS novel_list FROM tax GROUP BY ALL"""
Q["rq5_cluster_summary"] = f"""
SELECT {K}, cluster_id, coalesce(label, '') AS label, size AS sentence_count, paper_count,
       {R6('round(coalesce(confidence, 0.0), 3)')} AS confidence, winning_model,
       substr(coalesce(top_sentences[1], ''), 1, 120) AS top_evidence FROM lab"""
Q["paper_results"] = f"""
SELECT p.corpus_id, p.run_key, p.paper_id AS paper_index, p.cluster_id, l.label AS cluster_label, d.title, d.year
FROM topic_papers p JOIN lab l USING (corpus_id, run_key, cluster_id)
LEFT JOIN (SELECT 'emb' || CAST(paper_id % 2 AS VARCHAR) AS corpus_id, paper_id, title, year FROM papers) d
  USING (corpus_id, paper_id)"""
_RQ6 = f"""
SELECT {K}, theme_name, coalesce(pajais_match, 'NOVEL') AS pajais_category, coalesce(is_novel, false) AS is_novel,
       {R6('round(coalesce(match_confidence, 0.0), 3)')} AS confidence, total_sentences AS sentence_count,
       paper_count, sub_topics, reasoning FROM tax"""
Q["rq6_taxonomy_summary"] = _RQ6
Q["rq7_taxonomy_summary"] = f"""
SELECT {K}, theme_name, pajais_category, is_novel, sentence_count, paper_count FROM ({_RQ6})"""
Q["mapped_novel"] = f"""
SELECT {K}, theme_rank, theme_name, CASE WHEN nov THEN 'NOVEL' ELSE 'MAPPED' END AS kind,
       CASE WHEN nov THEN theme_name || ' — NOT in PAJAIS taxonomy (' || total_sentences || ' sentences, ' ||
                          paper_count || ' papers)'
            ELSE theme_name || ' → ' || coalesce(pajais_match, '') || ' (conf=' ||
                 CAST(round(coalesce(match_confidence, 0.0), 2) AS VARCHAR) || ', ' || total_sentences ||
                 ' sentences, ' || paper_count || ' papers)' END AS line,
       count(*) OVER (PARTITION BY {K}) AS total,
       CAST(sum(CASE WHEN nov THEN 0 ELSE 1 END) OVER (PARTITION BY {K}) AS BIGINT) AS mapped,
       CAST(sum(CASE WHEN nov THEN 1 ELSE 0 END) OVER (PARTITION BY {K}) AS BIGINT) AS novel
FROM (SELECT *, coalesce(is_novel, false) AS nov FROM tax)"""
Q["agenda"] = f"""
SELECT {K}, item, theme_name, item || '. ' || theme_name AS line FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY {K} ORDER BY theme_rank) AS INTEGER) AS item
  FROM tax WHERE coalesce(is_novel, false))"""
Q["paragraphs"] = f"""
SELECT conv_id, turn, para_no, paragraph FROM (
  SELECT conv_id, turn, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS para_no,
         replace(replace(replace({STRIP('unnest(l)')}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS paragraph
  FROM (SELECT conv_id, turn, string_split(text, {NL} || {NL}) AS l FROM conversations))
WHERE paragraph <> ''"""


def oracle_sql() -> dict[str, str]:
    from . import learnt_oracle  # noqa: F401  adds its queries
    return {name: compose(sql) for name, sql in Q.items()}
