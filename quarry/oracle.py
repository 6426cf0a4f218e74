"""DuckDB oracle SQL for the registered queries (correctness check only).

Tables are the pre-registered views over the driver parquet files.  Each
statement computes the same result as the Spark query with plain SQL
(nested loops and global sorts are fine here - it runs at sf0.01).
Literals are typed DOUBLE so DuckDB does not switch to DECIMAL math.
"""

from __future__ import annotations

import functools

from quarry.functions.stopwords import stop_words

TOKEN = r"'[\p{L}\p{N}]+'"
SENT = r"'[^.!?\n]+[.!?]*'"
WORD = r"'\S+'"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {TOKEN})"


@functools.lru_cache(1)
def stop_rows() -> str:
    """SQL rows (lang, term): the stop lists of the repository."""
    rows = {(lang, w.replace("'", "''")) for lang, w in stop_words()}
    return ", ".join(f"('{a}', '{b}')" for a, b in sorted(rows))


CORPUS = f"""
corpus AS (
  SELECT doc_id AS mid, CAST(doc_id AS VARCHAR) AS text_id,
         array_to_string(regexp_extract_all(text, {WORD})[1:6], ' ') AS subject,
         coalesce(text, '') AS body_clean, lang, source
  FROM documents),
corpus1 AS (SELECT * FROM corpus QUALIFY row_number() OVER (PARTITION BY mid ORDER BY body_clean) = 1),
contents AS (SELECT mid AS doc_id, coalesce(subject, '') || chr(10) || coalesce(body_clean, '') AS contents
             FROM corpus1)"""

INDEX = CORPUS + f""",
an AS (SELECT doc_id, {toks('contents')} AS toks FROM contents),
ds AS (SELECT doc_id, CAST(len(toks) AS BIGINT) AS dl FROM an),
po AS (SELECT term, doc_id, dl, count(*) AS tf
       FROM (SELECT doc_id, CAST(len(toks) AS BIGINT) AS dl, unnest(toks) AS term FROM an)
       GROUP BY ALL),
sc AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM ds WHERE dl > 0),
ts AS (SELECT term, count(*) AS df,
              ln(1.0::DOUBLE + ((SELECT n FROM sc) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf
       FROM po GROUP BY term)"""


def generated(n: int, src: str = "corpus1", id_col: str = "mid", text_col: str = "body_clean",
              qlen: int = 32) -> str:
    return f"""
se0 AS (SELECT {id_col} AS doc_id, regexp_extract_all({text_col}, {SENT}) AS sents FROM {src}),
se1 AS (SELECT doc_id, unnest(sents) AS sentence, CAST(generate_subscripts(sents, 1) - 1 AS BIGINT) AS sent_pos
        FROM se0),
se AS (SELECT doc_id, sent_pos, {toks('sentence')} AS toks FROM se1),
se2 AS (SELECT doc_id, sent_pos, array_to_string(toks[1:{qlen}], ' ') AS query, toks FROM se WHERE len(toks) > 0),
ss AS (SELECT doc_id, sent_pos, query, round(avg(ts.idf), 6) AS score
       FROM (SELECT doc_id, sent_pos, query, unnest(toks) AS term FROM se2) JOIN ts USING (term)
       GROUP BY ALL),
gen AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_pos) AS BIGINT) AS q_rank,
               query FROM ss QUALIFY q_rank <= {n})"""


# ------------------------------------------------------------------ TextRank (U: unrolled)
def textrank_sql(iterations: int = 10) -> str:
    parts = [f"""{INDEX},
stop(lang, term) AS (VALUES {stop_rows()}),
tri AS (SELECT mid AS doc_id, lang, coalesce(subject, '') || ' ' || chr(10) || ' ' || coalesce(body_clean, '') AS text FROM corpus1),
sn0 AS (SELECT doc_id, lang, regexp_extract_all(text, {SENT}) AS ss FROM tri),
sn1 AS (SELECT doc_id, lang, unnest(ss) AS raw, CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS pos FROM sn0),
sn AS (SELECT doc_id, lang, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS sentence FROM sn1),
so AS (SELECT DISTINCT doc_id, lang, pos, unnest({toks('sentence')}) AS term FROM sn),
so2 AS MATERIALIZED (SELECT doc_id, pos, term FROM so ANTI JOIN stop USING (lang, term)),
nn AS (SELECT doc_id, pos, count(*) AS n FROM so2 GROUP BY ALL),
nodes AS MATERIALIZED (SELECT sn.doc_id, sn.pos, sn.sentence, len(regexp_extract_all(sn.sentence, {WORD})) AS words, nn.n
          FROM sn JOIN nn USING (doc_id, pos)),
pe AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, count(*) AS shared FROM so2 a JOIN so2 b
       ON a.doc_id = b.doc_id AND a.term = b.term AND a.pos <> b.pos GROUP BY ALL),
ew AS MATERIALIZED (SELECT pe.doc_id, i, j, shared / (ln(na.n) + ln(nb.n)) AS w FROM pe
       JOIN nn na ON na.doc_id = pe.doc_id AND na.pos = i JOIN nn nb ON nb.doc_id = pe.doc_id AND nb.pos = j
       WHERE ln(na.n) + ln(nb.n) > 0),
wo AS MATERIALIZED (SELECT doc_id, i, sum(w) AS wsum FROM ew GROUP BY ALL),
r0 AS (SELECT doc_id, pos, 1.0::DOUBLE AS score FROM nodes)"""]
    for k in range(iterations):
        parts.append(f"""r{k + 1} AS MATERIALIZED (SELECT n.doc_id, n.pos,
  (1.0::DOUBLE - 0.85::DOUBLE) + 0.85::DOUBLE * coalesce(x.acc, 0.0::DOUBLE) AS score FROM nodes n LEFT JOIN
  (SELECT ew.doc_id, ew.j, sum(ew.w * r.score / wo.wsum) AS acc FROM ew
   JOIN r{k} r ON r.doc_id = ew.doc_id AND r.pos = ew.i JOIN wo ON wo.doc_id = ew.doc_id AND wo.i = ew.i GROUP BY ALL) x
  ON x.doc_id = n.doc_id AND x.j = n.pos)""")
    parts.append(f"""trs AS (SELECT n.*, round(r.score, 6) AS score FROM nodes n JOIN r{iterations} r USING (doc_id, pos)),
trg AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY score DESC, pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM trs),
trg2 AS (SELECT *, max(CASE WHEN abs(15 - before - words) > abs(15 - before) THEN 1 ELSE 0 END)
          OVER (PARTITION BY doc_id ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stp FROM trg),
summ AS (SELECT doc_id, string_agg(sentence, chr(10) ORDER BY pos) AS summary FROM trg2 WHERE stp = 0 GROUP BY doc_id),
kl AS (SELECT doc_id, lang, {toks('text')} AS tl FROM tri),
kt0 AS (SELECT doc_id, lang, unnest(tl) AS term, generate_subscripts(tl, 1) AS p FROM kl),
kt AS (SELECT doc_id, term, p FROM kt0 ANTI JOIN stop USING (lang, term)),
kp AS (SELECT doc_id, term, lead(term) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM kt),
ku AS MATERIALIZED (SELECT DISTINCT doc_id, u, v FROM (SELECT doc_id, term AS u, nxt AS v FROM kp WHERE nxt IS NOT NULL AND term <> nxt
       UNION ALL SELECT doc_id, nxt, term FROM kp WHERE nxt IS NOT NULL AND term <> nxt)),
kd AS MATERIALIZED (SELECT doc_id, u, count(*) AS deg FROM ku GROUP BY ALL),
kn AS MATERIALIZED (SELECT DISTINCT doc_id, term FROM kt),
k0 AS (SELECT doc_id, term, 1.0::DOUBLE AS score FROM kn)""")
    for k in range(iterations):
        parts.append(f"""k{k + 1} AS MATERIALIZED (SELECT kn.doc_id, kn.term,
  (1.0::DOUBLE - 0.85::DOUBLE) + 0.85::DOUBLE * coalesce(x.acc, 0.0::DOUBLE) AS score FROM kn LEFT JOIN
  (SELECT ku.doc_id, ku.v AS term, sum(k.score / kd.deg) AS acc FROM ku
   JOIN k{k} k ON k.doc_id = ku.doc_id AND k.term = ku.u JOIN kd ON kd.doc_id = ku.doc_id AND kd.u = ku.u GROUP BY ALL) x
  USING (doc_id, term))""")
    parts.append(f"""ktop AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, term) AS r
         FROM k{iterations} QUALIFY r <= 8),
kw AS (SELECT doc_id, string_agg(term, ' ' ORDER BY r) AS keywords FROM ktop GROUP BY doc_id),
prep AS MATERIALIZED (SELECT c.mid AS doc_id, c.subject, c.body_clean,
   'subject: ' || coalesce(c.subject, '') || ' body: ' || regexp_replace(coalesce(c.body_clean, ''), '[\\n\\r\\t]', ' ', 'g') AS body_clean_and_subject,
   CAST(length(regexp_replace(c.body_clean, '[\\n\\r\\t]', ' ', 'g')) AS BIGINT) AS clean_length_character,
   coalesce(s.summary, '') AS text_rank_query, coalesce(kw.keywords, '') AS elaborative_description
   FROM corpus1 c LEFT JOIN summ s ON s.doc_id = c.mid LEFT JOIN kw ON kw.doc_id = c.mid)""")
    return ",\n".join(parts)


TEXTRANK = textrank_sql()


DOCIDS = "ids AS (SELECT doc_id, elaborative_description AS docid FROM prep)"

QUERIES = TEXTRANK + "," + generated(1) + f""",
ki AS (SELECT b.item_id, b.text AS query,
              (SELECT min(d.doc_id) FROM documents d WHERE contains(d.text, b.text)) AS target
       FROM benchmark b),
q AS (SELECT 'k' || CAST(item_id AS VARCHAR) AS query_id, 'known_item' AS query_type, query,
             p.elaborative_description AS target FROM ki LEFT JOIN prep p ON p.doc_id = ki.target
      UNION ALL
      SELECT 'd' || CAST(g.doc_id AS VARCHAR), 'd2q', g.query, p.elaborative_description
      FROM gen g JOIN prep p USING (doc_id)
      UNION ALL
      SELECT 't' || CAST(doc_id AS VARCHAR), 'textrank', text_rank_query, elaborative_description FROM prep),
q2 AS MATERIALIZED (SELECT * FROM q WHERE query IS NOT NULL AND query <> '')"""

BM25 = QUERIES + f""",
qt AS (SELECT query_id, term, count(*) AS qf
       FROM (SELECT query_id, unnest({toks('query')}) AS term FROM q2) GROUP BY ALL),
sco AS (SELECT qt.query_id, po.doc_id,
               sum(qt.qf * ts.idf * po.tf / (po.tf + 0.9::DOUBLE * ((1.0::DOUBLE - 0.4::DOUBLE)
                   + 0.4::DOUBLE * po.dl / (SELECT avgdl FROM sc)))) AS score
        FROM qt JOIN ts USING (term) JOIN po USING (term) GROUP BY ALL),
topk AS (SELECT query_id, doc_id, round(score, 6) AS score,
                CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS BIGINT) AS rank
         FROM sco QUALIFY rank <= 20),
ranks AS (SELECT q2.query_id, q2.query_type, q2.target, min(h.rank) AS rank
          FROM q2 LEFT JOIN (SELECT t.*, p.elaborative_description FROM topk t JOIN prep p USING (doc_id)) h
            ON h.query_id = q2.query_id AND h.elaborative_description = q2.target
          GROUP BY ALL)"""


def metric_cols(rank: str = "rank", rnd: bool = True) -> str:
    def r(e):
        return f"round({e}, 4)" if rnd else e
    return ",\n".join([
        r(f"avg(CASE WHEN {rank} <= 3 THEN 1.0::DOUBLE / {rank} ELSE 0.0::DOUBLE END)") + " AS mrr_3",
        r(f"avg(CASE WHEN {rank} <= 20 THEN 1.0::DOUBLE / {rank} ELSE 0.0::DOUBLE END)") + " AS mrr_20",
        r(f"avg(CASE WHEN {rank} <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)") + " AS hits_1",
        r(f"avg(CASE WHEN {rank} <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)") + " AS hits_10",
    ])


def per_type(ranks: str = "ranks", rnd: bool = True) -> str:
    return f"""SELECT query_type, count(*) AS n_queries, {metric_cols(rnd=rnd)}
FROM {ranks} GROUP BY query_type"""


def macro(ranks: str = "ranks", types=("textrank", "d2q")) -> str:
    tl = ", ".join(f"'{t}'" for t in types)
    return f"""SELECT 'macro' AS query_type, CAST(sum(n_queries) AS BIGINT) AS n_queries,
  round(avg(mrr_3), 4) AS mrr_3, round(avg(mrr_20), 4) AS mrr_20,
  round(avg(hits_1), 4) AS hits_1, round(avg(hits_10), 4) AS hits_10
FROM ({per_type(ranks, rnd=False)}) pt WHERE query_type IN ({tl})
HAVING count(*) = {len(types)}"""


ORACLE: dict[str, str] = {}

ORACLE["scan_corpus"] = f"WITH {CORPUS} SELECT mid, text_id, subject, body_clean, lang, source FROM corpus"

ORACLE["postings"] = INDEX + """
SELECT term, doc_id, count(*) AS tf, array_to_string(list_sort(list(pos)), ',') AS positions
FROM (SELECT doc_id, unnest(toks) AS term, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS pos FROM an)
GROUP BY ALL"""
ORACLE["postings"] = "WITH " + ORACLE["postings"].lstrip()

ORACLE["doc_vectors"] = f"""WITH {INDEX},
dv AS (SELECT doc_id, term, count(*) AS tf, array_to_string(list_sort(list(pos)), ',') AS positions
       FROM (SELECT doc_id, unnest(toks) AS term, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS pos FROM an) GROUP BY doc_id, term)
SELECT dv.doc_id, ds.dl, md5(string_agg(term || ':' || tf || ':' || positions, ' ' ORDER BY term)) AS terms_md5
FROM dv JOIN ds USING (doc_id) GROUP BY dv.doc_id, ds.dl"""
ORACLE["phrase_match"] = f"""WITH {INDEX},
ph AS (SELECT item_id, {toks('text')} AS t FROM benchmark),
tp AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM an),
ps AS (SELECT ph.item_id, ph.t, tp.doc_id, tp.pos FROM ph JOIN tp ON tp.term = ph.t[1])
SELECT item_id, ps.doc_id, count(*) AS n_matches, CAST(min(pos) - 1 AS BIGINT) AS first_pos
FROM ps JOIN an ON an.doc_id = ps.doc_id WHERE an.toks[pos:pos + len(t) - 1] = t GROUP BY ALL"""
ORACLE["doc_stats"] = f"WITH {INDEX} SELECT doc_id, dl FROM ds"
ORACLE["term_stats"] = f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM ts"
ORACLE["query_set"] = f"WITH {BM25} SELECT query_id, query_type, query, target FROM q2"
ORACLE["generate_queries"] = f"WITH {INDEX}, {generated(3)} SELECT doc_id, q_rank, query FROM gen"
ORACLE["sample_queries"] = f"""WITH {INDEX}, {generated(10)},
sc10 AS (SELECT doc_id, sent_pos, query, score FROM ss
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_pos) <= 10),
dr AS (SELECT *, round(score - ln(-ln((('0x' || substr(md5('313:' || doc_id || ':' || sent_pos), 1, 13))::BIGINT + 0.5::DOUBLE)
              / 4503599627370496.0::DOUBLE)), 6) AS draw FROM sc10)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY draw DESC, sent_pos) AS BIGINT) AS q_rank, query
FROM dr QUALIFY q_rank <= 3"""
ORACLE["bm25_topk"] = f"WITH {BM25} SELECT query_id, rank, doc_id, score FROM topk"
ORACLE["bm25_rank"] = f"WITH {BM25} SELECT query_id, query_type, target, rank FROM ranks"
ORACLE["metrics_by_type"] = f"WITH {BM25} {per_type()}"
ORACLE["metrics_macro"] = f"WITH {BM25} {macro()}"
ORACLE["bm25_eval"] = f"""WITH {BM25}
SELECT 'BM25-base' AS system, query_type, n_queries, mrr_3, mrr_20, hits_1, hits_10
FROM ({per_type()} UNION ALL {macro()})"""
ORACLE["dedupe_first"] = f"""WITH {CORPUS}
SELECT md5(body_clean) AS text_key, min(mid) AS doc_id FROM corpus GROUP BY 1"""

# ------------------------------------------------------------------ projections
SUBJ = f"array_to_string(regexp_extract_all(text, {WORD})[1:6], ' ')"
LANGS = "(VALUES ('en','English'),('fr','French'),('de','German'),('es','Spanish')) AS l(lang, language)"
PAGES = r"""pf AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
     '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'),
     '^\s+|\s+$', '', 'g') AS passage
  FROM pages)"""

ORACLE["clean_body"] = r"SELECT doc_id, regexp_replace(text, '[\n\r\t]', ' ', 'g') AS body FROM documents"
ORACLE["compose_subject_body"] = f"""WITH {CORPUS}
SELECT mid AS doc_id, 'subject: ' || coalesce(subject, '') || ' body: ' ||
       regexp_replace(coalesce(body_clean, ''), '[\\n\\r\\t]', ' ', 'g') AS body_clean_and_subject FROM corpus"""
ORACLE["compose_contents"] = f"WITH {CORPUS} SELECT mid AS doc_id, coalesce(subject, '') || chr(10) || coalesce(body_clean, '') AS contents FROM corpus"
ORACLE["prompt_by_lang"] = f"""WITH {CORPUS}
SELECT c.mid AS doc_id, c.lang,
  'Generate a ' || coalesce(l.language, c.lang, '') || ' question for this passage: ' || c.subject || ' ' || c.body_clean AS prompt,
  'Generate ' || coalesce(l.language, c.lang, '') || ' question: ' || c.subject || '</s>' || c.body_clean AS dev_prompt
FROM corpus c LEFT JOIN {LANGS} ON c.lang = l.lang"""
ORACLE["role_prefix"] = f"""WITH {PAGES}
SELECT page_id, 'Passage: ' || coalesce(passage, '') AS passage_text,
  'Passage: ' || coalesce(title, '') || '</s>' || coalesce(passage, '') AS titled_text,
  'Question: ' || coalesce(regexp_extract_all(passage, {SENT})[1], '') AS question_text FROM pf"""
PROMPTED = """pr AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Passage: ' || coalesce(text, '')
  WHEN 1 THEN 'Question: ' || coalesce(text, '') WHEN 2 THEN 'Passage: Question: ' || coalesce(text, '')
  ELSE coalesce(text, '') END AS prompt FROM documents)"""
ORACLE["strip_prompt"] = f"""WITH {PROMPTED},
s1 AS (SELECT doc_id, CASE WHEN starts_with(prompt, 'Passage: ') THEN substr(prompt, 10) ELSE prompt END AS p FROM pr)
SELECT doc_id, CASE WHEN starts_with(p, 'Question: ') THEN substr(p, 11) ELSE p END AS text FROM s1"""
ORACLE["title_slice"] = f"""WITH {PAGES},
mt AS (SELECT page_id, ' title:' || title || CASE WHEN page_id % 2 = 0 THEN '_parentSection' || url ELSE '' END || ' ' AS raw_title FROM pf),
st AS (SELECT page_id, regexp_replace(raw_title, '^\\s+|\\s+$', '', 'g') AS t FROM mt),
fx AS (SELECT page_id, t, CASE WHEN strpos(t, '_parentSection') = 0 THEN length(t) - 1 ELSE strpos(t, '_parentSection') - 1 END AS stop FROM st)
SELECT page_id, substr(t, 7, greatest(stop - 6, 0)) AS title FROM fx"""
ORACLE["flatten_newlines"] = r"SELECT doc_id, replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), ' ') AS text FROM documents"
ORACLE["length_features"] = f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS length_character,
  CAST(len(regexp_extract_all(text, {WORD})) AS BIGINT) AS length_word,
  CAST(length(regexp_replace(coalesce(text, ''), '[\\n\\r\\t]', ' ', 'g')) AS BIGINT) AS clean_length_character,
  CAST(len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[\\n\\r\\t]', ' ', 'g'), {WORD})) AS BIGINT) AS clean_length_word
FROM documents"""
ORACLE["token_truncate"] = f"SELECT doc_id, array_to_string({toks('text')}[1:16], ' ') AS tokens FROM documents"
ORACLE["max_id_length"] = f"WITH {TEXTRANK}, {DOCIDS} SELECT CAST(max(len({toks('docid')})) + 1 AS BIGINT) AS max_id_length FROM ids"
LABELSEQ = f"""ls AS (SELECT mid AS doc_id, CASE WHEN mid % 3 = 0 THEN list_append({toks('body_clean')}, '-100')
  ELSE {toks('body_clean')} END AS seq FROM corpus),
um AS (SELECT doc_id, list_transform(seq, lambda x: CASE WHEN x = '-100' THEN '<pad>' ELSE x END) AS seq FROM ls)"""
PADDED = "list_concat(seq, list_transform(range(greatest(128 - len(seq), 0)), lambda x: '<pad>'))[1:128]"
ORACLE["pad_sequences"] = f"WITH {CORPUS}, {LABELSEQ} SELECT doc_id, array_to_string({PADDED}, ' ') AS padded FROM um"
ORACLE["batch_pad"] = f"""WITH {CORPUS}, {LABELSEQ},
nb AS (SELECT doc_id, seq, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 8) AS BIGINT) AS batch FROM um),
ml AS (SELECT *, max(len(seq)) OVER (PARTITION BY batch) AS l FROM nb)
SELECT doc_id, batch,
  array_to_string(list_concat(seq, list_transform(range(l - len(seq)), lambda x: '<pad>')), ' ') AS input_padded,
  array_to_string(list_concat(seq, list_transform(range(l - len(seq)), lambda x: '-100')), ' ') AS labels_padded
FROM ml"""
ORACLE["decode_tokens"] = f"""WITH {CORPUS}, {LABELSEQ}
SELECT doc_id, trim(array_to_string(list_filter(list_append({PADDED}, '</s>'),
  lambda x: x NOT IN ('<pad>', '</s>', '<unk>')), ' ')) AS decoded FROM um"""
RANKER = f"""rc AS (SELECT d.source, d.doc_id, (l.quality = 1 AND l.toxic = 0) AS is_positive,
   {SUBJ.replace('text', 'd.text')} AS title, coalesce(d.text, '') AS text
   FROM documents d JOIN labels l USING (doc_id)),
fp AS (SELECT source, coalesce(regexp_extract_all(arg_min(text, doc_id), {SENT})[1], '') AS question
   FROM rc WHERE is_positive GROUP BY source),
rk AS (SELECT rc.*, fp.question FROM rc LEFT JOIN fp USING (source))"""
ANS = f"regexp_replace(coalesce(regexp_extract_all(text, {SENT})[1], ''), '^\\s+|\\s+$', '', 'g')"
ORACLE["pair_input"] = f"""WITH {RANKER}
SELECT source, doc_id,
  coalesce(question, '') || '</s>' || concat_ws(' ', title, text) AS input,
  coalesce(question, '') || '</s>' || text AS input_notitle,
  coalesce(question, '') || '</s>' || concat_ws(' ', {ANS}, title, text) AS input_answer,
  coalesce(question, '') || '</s>' || concat_ws(' ', {ANS}, text) AS input_answer_notitle
FROM rk"""
ORACLE["numeric_vocab"] = f"""WITH t AS (SELECT DISTINCT unnest({toks('text')}) AS t FROM documents),
v AS (SELECT t AS token FROM t UNION ALL SELECT '▁' || t FROM t UNION ALL SELECT '▁' UNION ALL SELECT '</s>')
SELECT DISTINCT token FROM v WHERE (regexp_matches(token, '^▁?[0-9]*$') AND token <> '') OR token = '</s>'"""
ORACLE["id_kind"] = f"""WITH {TEXTRANK}, {DOCIDS}
SELECT id_set, bool_and(NOT regexp_matches(id, '^[0-9]+$')) AS semantic_ids FROM (
  SELECT 'doc_id' AS id_set, CAST(doc_id AS VARCHAR) AS id FROM ids UNION ALL SELECT 'docid', docid FROM ids) GROUP BY id_set"""

# ------------------------------------------------------------------ joins / aggregates / splits / builders
QR = """cv AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
qa AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS qid,
  CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS docid, coalesce(text, '') AS question, coalesce(next_text, '') AS passage
  FROM cv WHERE role = 'user' AND next_role = 'assistant'),
qrows AS (SELECT conv_id, turn, qid, docid, 0 AS k FROM qa UNION ALL SELECT conv_id, turn, qid || 'b', docid, 1 FROM qa WHERE turn = 0),
qr AS (SELECT 'train' AS split, qid, docid, struct_pack(c := conv_id, t := turn, k := k) AS pos FROM qrows WHERE conv_id % 5 < 4
  UNION ALL SELECT 'dev', qid, docid, struct_pack(c := conv_id, t := turn, k := k) FROM qrows WHERE conv_id % 5 >= 4
  UNION ALL SELECT 'dev', qid, docid, struct_pack(c := conv_id, t := turn, k := k) FROM qrows WHERE conv_id % 5 < 4 AND conv_id % 7 = 0)"""


def seeded(seed, x):
    return f"md5('{seed}:' || CAST({x} AS VARCHAR))"


def frac(key):
    return f"(CAST(('0x' || substr({key}, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def bucket(key, train=0.8, validate=0.1, test=0.1):
    t2 = train + (1.0 - train) * validate / (validate + test)
    u = frac(key)
    return (f"CASE WHEN {u} < {train!r}::DOUBLE THEN 'train' WHEN {u} < {t2!r}::DOUBLE THEN 'validate' "
            f"ELSE 'test' END")


ORACLE["attach_queries"] = f"""WITH {INDEX}, {generated(2)}
SELECT c.mid, g.q_rank, g.query AS doctoquery FROM corpus1 c LEFT JOIN gen g ON g.doc_id = c.mid"""
ORACLE["qrel_lookup"] = f"""WITH {QR},
f AS (SELECT docid, qid FROM qr WHERE split = 'train' QUALIFY row_number() OVER (PARTITION BY docid ORDER BY pos) = 1)
SELECT f.docid, f.qid, a.question, b.passage FROM f JOIN qa a ON a.qid = f.qid JOIN qa b ON b.docid = f.docid"""
ORACLE["dev_anti_train"] = f"""WITH {QR}
SELECT DISTINCT docid FROM qr WHERE split = 'dev' AND docid NOT IN (SELECT docid FROM qr WHERE split = 'train')"""
ORACLE["qid_guard"] = f"""WITH {QR}
SELECT qid, docid FROM qr WHERE split = 'dev' AND qid NOT IN (SELECT qid FROM qr WHERE split = 'train')
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos) = 1"""
ORACLE["prompt_cross_lang"] = f"""WITH {CORPUS}
SELECT c.mid AS doc_id, l.lang, 'Generate a ' || l.language || ' question for this passage: ' || c.subject || ' ' || c.body_clean AS prompt
FROM corpus c, {LANGS}"""
ORACLE["mrr_at_k"] = f"""WITH {BM25}
SELECT CAST(k AS BIGINT) AS k, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END), 6) AS mrr
FROM ranks, (VALUES (1), (3), (10), (20)) t(k) GROUP BY k"""
ORACLE["hits_at_k"] = f"""WITH {BM25}
SELECT CAST(k AS BIGINT) AS k, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hits
FROM ranks, (VALUES (1), (3), (10), (20)) t(k) GROUP BY k"""
ORACLE["qrel_invert"] = f"WITH {QR} SELECT split, docid, string_agg(qid, ',' ORDER BY pos, qid) AS qids FROM qr GROUP BY split, docid"
ORACLE["distinct_ids"] = f"WITH {TEXTRANK}, {DOCIDS} SELECT DISTINCT docid AS text_id FROM ids"
ORACLE["source_sizes"] = "SELECT source, count(*) AS n_rows FROM documents GROUP BY ROLLUP (source)"
ORACLE["nth_shortest"] = """SELECT doc_id, CAST(length(text) AS BIGINT) AS char_count FROM documents
ORDER BY char_count NULLS FIRST, doc_id LIMIT 1 OFFSET 3"""
ORACLE["seeded_sample"] = f"""SELECT doc_id, CAST(row_number() OVER (ORDER BY {seeded(313, 'doc_id')}, doc_id) AS BIGINT) AS sample_rank
FROM documents QUALIFY sample_rank <= 100"""
ORACLE["split_exact"] = f"""WITH n AS (SELECT count(*)::DOUBLE AS n FROM documents),
c AS (SELECT floor(n * 0.8::DOUBLE + 1e-9::DOUBLE) AS n_train, n FROM n),
c2 AS (SELECT n_train, floor((n - n_train) * 0.1::DOUBLE / (0.1::DOUBLE + 0.1::DOUBLE) + 1e-9::DOUBLE) AS n_val FROM c),
r AS (SELECT doc_id, row_number() OVER (ORDER BY {seeded(42, 'doc_id')}, doc_id) AS rn FROM documents)
SELECT doc_id, CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_train + n_val THEN 'validate' ELSE 'test' END AS split
FROM r, c2"""
ORACLE["split_bucket"] = f"SELECT doc_id, {bucket(seeded(42, 'doc_id'))} AS split FROM documents"
VIEWROWS = f"""{TEXTRANK}, {generated(1)}, {DOCIDS},
vr AS (SELECT doc_id, 'body_clean_and_subject' AS view, body_clean_and_subject AS text FROM prep
       UNION ALL SELECT doc_id, 'text_rank_query', text_rank_query FROM prep
       UNION ALL SELECT p.doc_id, 'doctoquery', g.query FROM prep p LEFT JOIN gen g USING (doc_id))"""
ORACLE["split_by_doc"] = f"WITH {VIEWROWS} SELECT doc_id, view, {bucket(seeded(42, 'doc_id'))} AS split FROM vr"
ORACLE["split_by_query"] = f"""WITH {VIEWROWS}
SELECT doc_id, view, {bucket(seeded(42, "CAST(doc_id AS VARCHAR) || ':' || view"))} AS split FROM vr"""
ORACLE["multi_view_pairs"] = f"""WITH {VIEWROWS}
SELECT v.view, coalesce(v.text, '') AS text, coalesce(i.docid, '') AS text_id, {bucket(seeded(42, 'v.doc_id'))} AS split
FROM vr v LEFT JOIN ids i USING (doc_id)"""
ORACLE["multi_view_pairs_textrank"] = ORACLE["multi_view_pairs"] + " WHERE v.view <> 'doctoquery'"
ORACLE["dense_ids"] = f"""SELECT doc_id, CAST(row_number() OVER (ORDER BY {seeded(313, 'doc_id')}, doc_id) - 1 AS BIGINT) AS rand_id
FROM documents"""
ORACLE["quota_fill"] = f"""WITH pref AS (SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
pool AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM pref)),
u AS (SELECT doc_id, 0 AS priority FROM pref UNION ALL SELECT doc_id, 1 FROM pool)
SELECT doc_id, CAST(priority AS BIGINT) AS priority,
  CAST(row_number() OVER (ORDER BY priority, {seeded(313, 'doc_id')}, doc_id) AS BIGINT) AS fill_rank
FROM u QUALIFY fill_rank <= (SELECT count(*) // 2 FROM documents)"""
ORACLE["shard_rows"] = f"""WITH n AS (SELECT count(*) AS n, CAST(ceil(count(*) / 8) * 8 AS BIGINT) AS target FROM labels),
top AS (SELECT doc_id, 1 AS copy FROM labels ORDER BY {seeded(313, 'doc_id')}, doc_id LIMIT (SELECT target - n FROM n)),
u AS (SELECT doc_id, 0 AS copy FROM labels UNION ALL SELECT * FROM top),
r AS (SELECT doc_id, copy, row_number() OVER (ORDER BY copy, doc_id) AS rn FROM u)
SELECT doc_id, CAST(copy AS BIGINT) AS copy, CAST(floor((rn - 1) / ((SELECT target FROM n) // 8)) AS BIGINT) AS shard FROM r"""
ORACLE["shard_rows_inference"] = """SELECT doc_id, CAST(least((row_number() OVER (ORDER BY doc_id) - 1)
  // greatest(1, (SELECT count(*) FROM labels) // 8), 7) AS BIGINT) AS shard FROM labels"""
ORACLE["mix_sources"] = """WITH s AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY source),
t AS (SELECT *, sum(n_rows) OVER () AS total, row_number() OVER (ORDER BY source) AS pos, count(*) OVER () AS n_src FROM s),
u AS (SELECT *, floor(total * 2 / 4) AS total_steps, round_even(n_rows / total * floor(total * 2 / 4), 0) AS share FROM t),
v AS (SELECT source, CAST(CASE WHEN pos = n_src THEN total_steps - coalesce(sum(CASE WHEN pos < n_src THEN share END) OVER (), 0)
       ELSE share END AS BIGINT) AS steps, n_rows // 4 AS per_pass FROM u),
w AS (SELECT *, CAST(ceil(steps / per_pass) AS BIGINT) AS passes FROM v WHERE per_pass > 0 AND steps > 0),
x AS (SELECT d.source, d.doc_id, w.steps, w.per_pass, unnest(range(w.passes)) AS pass FROM documents d JOIN w USING (source)),
y AS (SELECT *, row_number() OVER (PARTITION BY source, pass
        ORDER BY md5('313:' || CAST(pass AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS i FROM x),
z AS (SELECT source, pass, doc_id, i % 4 AS slot, pass * per_pass + i // 4 AS batch, steps FROM y WHERE i // 4 < per_pass),
c AS (SELECT * FROM z WHERE batch < steps),
o AS (SELECT source, batch, row_number() OVER (ORDER BY md5('313:' || source || ':' || CAST(batch AS VARCHAR)), source, batch) - 1 AS step
      FROM c WHERE slot = 0)
SELECT source, CAST(pass AS BIGINT) AS pass, CAST(batch AS BIGINT) AS batch, CAST(slot AS BIGINT) AS slot, doc_id,
  CAST(step AS BIGINT) AS step FROM c JOIN o USING (source, batch)"""
ORACLE["generation_input"] = f"""WITH {CORPUS}
SELECT 'email' AS kind, mid AS doc_id, NULL::VARCHAR AS lang, 'subject: ' || subject || ' body: ' || body_clean AS text FROM corpus
UNION ALL
SELECT 'multilingual', c.mid, l.lang, 'Generate a ' || l.language || ' question for this passage: ' || c.subject || ' ' || c.body_clean
FROM corpus c, {LANGS}
UNION ALL
SELECT 'monolingual', mid, NULL::VARCHAR, body_clean FROM corpus"""


def positioned(train: str, pool: str, dev: str) -> str:
    """CTE ``pos_`` (docid, priority, phase, text_id): train ids filled from the
    pool up to 1.2 x, then dev ids, with seeded dense ids."""
    return f"""pl AS (SELECT docid FROM ({pool}) WHERE docid NOT IN (SELECT docid FROM ({train})) AND docid NOT IN (SELECT docid FROM ({dev}))),
fl AS (SELECT docid, 0 AS priority FROM ({train}) UNION ALL SELECT docid, 1 FROM pl),
filled AS (SELECT *, row_number() OVER (ORDER BY priority, {seeded(313, 'docid')}, docid) AS fill_rank, 0 AS phase FROM fl
           QUALIFY fill_rank <= (SELECT count(*) * 12 // 10 FROM ({train}))),
held AS (SELECT docid, 2 AS priority, row_number() OVER (ORDER BY {seeded(313, 'docid')}, docid) AS fill_rank, 1 AS phase FROM ({dev})),
allr AS (SELECT *, row_number() OVER (ORDER BY phase, fill_rank) AS position
         FROM (SELECT * FROM filled UNION ALL SELECT * FROM held)),
vals AS (SELECT unnest(range((SELECT count(*) FROM allr))) AS v),
perm AS (SELECT v, row_number() OVER (ORDER BY {seeded(313, 'v')}, v) AS position FROM vals),
pos_ AS (SELECT a.docid, a.priority, a.phase, p.v AS text_id FROM allr a JOIN perm p USING (position))"""


QAD = f"""{QR},
fq AS (SELECT split, docid, qid FROM qr QUALIFY row_number() OVER (PARTITION BY split, docid ORDER BY pos) = 1),
tr AS (SELECT docid, qid FROM fq WHERE split = 'train' AND qid IN (SELECT qid FROM qa)),
dv AS (SELECT docid, qid FROM fq WHERE split = 'dev' AND qid IN (SELECT qid FROM qa) AND docid NOT IN (SELECT docid FROM tr)),
pas AS (SELECT docid, passage FROM qa UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR), coalesce(text, '') FROM documents),
{positioned('SELECT docid FROM tr', 'SELECT docid FROM pas', 'SELECT docid FROM dv')},
asked AS (SELECT x.docid, qa.question FROM (SELECT * FROM tr UNION ALL SELECT * FROM dv) x JOIN qa USING (qid)),
qad AS (SELECT p.*, s.passage, CASE WHEN p.priority <> 1 THEN k.question END AS question
        FROM pos_ p JOIN pas s USING (docid) LEFT JOIN asked k USING (docid))"""
ORACLE["qa_dataset_train"] = f"""WITH {QAD}
SELECT text_id, 'Passage: ' || passage AS text FROM qad
UNION ALL SELECT text_id, 'Question: ' || question FROM qad WHERE phase = 0 AND question IS NOT NULL"""
ORACLE["qa_dataset_dev"] = f"WITH {QAD} SELECT text_id, 'Question: ' || question AS text FROM qad WHERE phase = 1"
ORACLE["qa_dataset_corpus"] = f"WITH {QAD} SELECT text_id, CAST(text_id AS VARCHAR) || chr(9) || passage AS line FROM qad"
ML = f"""{QR},
ml0 AS (SELECT r.split, r.qid, r.docid, a.question,
   replace(regexp_replace(a.passage, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS passage,
   replace(regexp_replace(a.question, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS title,
   ['en', 'fr', 'de', 'es'][a.conv_id % 4 + 1] AS lang
   FROM qr r JOIN qa a ON a.qid = r.qid
   QUALIFY row_number() OVER (PARTITION BY r.qid ORDER BY CASE WHEN r.split = 'train' THEN 0 ELSE 1 END, r.pos) = 1),
ml AS (SELECT ml0.* EXCLUDE (title), substr('title:' || title || '_parentSection', 7,
         greatest(strpos('title:' || title || '_parentSection', '_parentSection') - 7, 0)) AS title,
       coalesce(l.language, ml0.lang) AS language FROM ml0 LEFT JOIN {LANGS} ON l.lang = ml0.lang)"""
MLSET = f"""{ML}, {PAGES},
mi AS (SELECT 'q' || qid AS docid, split, question, passage, title FROM ml),
mp AS (SELECT 'p' || CAST(page_id AS VARCHAR) AS docid, NULL::VARCHAR AS question, replace(passage, chr(10), ' ') AS passage,
         regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS title FROM pf),
{positioned("SELECT docid FROM mi WHERE split = 'train'", 'SELECT docid FROM mp', "SELECT docid FROM mi WHERE split = 'dev'")},
mset AS (SELECT p.*, x.question, x.passage, x.title FROM pos_ p
         JOIN (SELECT docid, question, passage, title FROM mi UNION ALL SELECT * FROM mp) x USING (docid))"""
ORACLE["multiling_train"] = f"""WITH {MLSET}
SELECT text_id, 'Passage: ' || title || '</s>' || passage AS text FROM mset
UNION ALL SELECT text_id, 'Question: ' || question FROM mset WHERE priority = 0"""
ORACLE["multiling_dev"] = f"WITH {MLSET} SELECT text_id, 'Question: ' || question AS text FROM mset WHERE phase = 1"
ORACLE["multiling_corpus"] = f"WITH {MLSET} SELECT text_id, CAST(text_id AS VARCHAR) || chr(9) || passage || chr(9) || title AS line FROM mset"
ORACLE["generator_pairs"] = f"""WITH {ML}
SELECT split, qid, question AS text_id, CASE WHEN split = 'train'
  THEN 'Generate a ' || language || ' question for this passage: ' || title || ' ' || passage
  ELSE 'Generate ' || language || ' question: ' || title || '</s>' || passage END AS text FROM ml"""
ORACLE["ranker_groups"] = f"""WITH {RANKER}
SELECT source, question, CAST(sum(CAST(is_positive AS INT)) AS BIGINT) AS n_pos,
  CAST(sum(CAST(NOT is_positive AS INT)) AS BIGINT) AS n_neg
FROM rk GROUP BY source, question HAVING n_pos > 0 AND n_neg > 0"""

# ------------------------------------------------------------------ trie / evidence / beam (U: unrolled)
TRIE_BODY = f"""{DOCIDS},
sq AS (SELECT doc_id, list_append(list_filter(string_split(docid, ' '), lambda x: x <> ''), '</s>') AS seq FROM ids),
st0 AS (SELECT doc_id, seq, unnest(seq) AS token, generate_subscripts(seq, 1) AS i FROM sq),
st AS (SELECT doc_id, array_to_string(seq[1:i - 1], ' ') AS prefix, token, CAST(i - 1 AS BIGINT) AS depth FROM st0),
edges AS (SELECT prefix, token, depth, count(*) AS n_seq FROM st GROUP BY ALL)"""
TRIE = f"{TEXTRANK}, {TRIE_BODY}"
ORACLE["trie_edges"] = f"WITH {TRIE} SELECT prefix, token, depth, n_seq FROM edges"
ORACLE["trie_next"] = f"""WITH {TRIE},
probes AS (SELECT DISTINCT prefix FROM st
  UNION SELECT array_to_string({toks('subject')}[1:2], ' ') FROM corpus)
SELECT p.prefix, e.token AS next_token FROM probes p LEFT JOIN edges e ON e.prefix = p.prefix"""


def _trie_of(name, src, bos):
    head = "['<s>'] || " if bos else ""
    return f"""{name}_sq AS (SELECT doc_id, {head}list_append(list_filter(string_split(docid, ' '), lambda x: x <> ''), '</s>') AS seq FROM {src}),
{name}_st0 AS (SELECT doc_id, seq, unnest(seq) AS token, generate_subscripts(seq, 1) AS i FROM {name}_sq),
{name}_st AS (SELECT array_to_string(seq[1:i - 1], ' ') AS prefix, token, CAST(i - 1 AS BIGINT) AS depth FROM {name}_st0),
{name}_e AS (SELECT DISTINCT prefix, token, depth FROM {name}_st),
{name}_n AS (SELECT CASE WHEN prefix = '' THEN token ELSE prefix || ' ' || token END AS node FROM {name}_e
             UNION SELECT '' FROM {name}_e WHERE depth = 0)"""


ORACLE["trie_next_fallback"] = f"""WITH {TRIE},
il AS (SELECT i.doc_id, i.docid, c.lang FROM ids i JOIN corpus1 c ON c.mid = i.doc_id),
ia AS (SELECT * FROM il WHERE lang = 'en'), ib AS (SELECT * FROM il WHERE lang <> 'en'),
{_trie_of('a', 'ia', True)},
{_trie_of('b', 'ib', False)},
probes AS (SELECT DISTINCT prefix FROM (SELECT prefix FROM a_st UNION ALL SELECT prefix FROM b_st)),
pt AS (SELECT prefix, list_filter(string_split(prefix, ' '), lambda x: x <> '') AS toks FROM probes),
pk AS (SELECT prefix, toks, unnest(range(len(toks) + 1)) AS k FROM pt),
pm AS (SELECT prefix, toks, max(k) AS m FROM pk WHERE array_to_string(toks[1:k], ' ') IN (SELECT node FROM a_n)
       GROUP BY prefix, toks),
hit AS (SELECT pm.prefix, e.token AS next_token FROM pm JOIN a_e e ON e.prefix = pm.prefix WHERE pm.m = len(pm.toks)),
swapped AS (SELECT '' AS prefix, token AS next_token FROM b_e WHERE depth = 0
            AND EXISTS (SELECT 1 FROM hit WHERE prefix = '' AND next_token = '<s>')),
miss AS (SELECT pm.prefix, e.token AS next_token FROM pm
         JOIN b_e e ON e.prefix = array_to_string(pm.toks[pm.m + 1:], ' ') WHERE pm.m < len(pm.toks)),
res AS (SELECT DISTINCT * FROM (SELECT * FROM hit WHERE next_token <> '<s>' UNION ALL SELECT * FROM swapped
        UNION ALL SELECT * FROM miss))
SELECT p.prefix, r.next_token FROM probes p LEFT JOIN res r USING (prefix)"""
ORACLE["trie_leaves"] = f"""WITH {TEXTRANK}, {DOCIDS},
sq AS (SELECT list_filter(string_split(docid, ' '), lambda x: x <> '') AS seq FROM ids),
full_ AS (SELECT DISTINCT array_to_string(seq, ' ') AS sequence FROM sq),
proper AS (SELECT DISTINCT array_to_string(seq[1:k], ' ') AS sequence
           FROM (SELECT seq, unnest(range(1, len(seq))) AS k FROM sq))
SELECT sequence FROM full_ WHERE sequence NOT IN (SELECT sequence FROM proper)"""
EVID = """ev AS MATERIALIZED (SELECT st.depth, st.prefix, st.token, dt.term, count(*) AS weight
       FROM st JOIN (SELECT po.doc_id, po.term FROM po JOIN corpus1 c ON c.mid = po.doc_id ANTI JOIN stop s
                     ON s.lang = c.lang AND s.term = po.term) dt USING (doc_id) GROUP BY ALL)"""
ORACLE["index_evidence"] = f"WITH {TRIE}, {EVID} SELECT depth, prefix, token, term, weight FROM ev"


def beam_sql(steps: int = 9, beams: int = 20) -> str:
    parts = [f"""{QUERIES}, {TRIE_BODY}, {EVID},
kids AS MATERIALIZED (SELECT prefix, token, count(*) OVER (PARTITION BY prefix) AS n_children FROM (SELECT DISTINCT prefix, token FROM edges)),
bq AS (SELECT query_id, query_type, query, target FROM q2),
qterm AS (SELECT DISTINCT query_id, unnest({toks('query')}) AS term FROM bq),
s0 AS (SELECT DISTINCT query_id, '' AS prefix, 0.0::DOUBLE AS lp, CAST(0 AS BIGINT) AS len, false AS done FROM qterm)"""]
    for i in range(steps):
        parts.append(f"""live{i} AS (SELECT query_id, prefix, lp, len FROM s{i} WHERE NOT done),
hits{i} AS MATERIALIZED (SELECT l.query_id, l.prefix, e.token, sum(e.weight) AS ev FROM live{i} l JOIN qterm q USING (query_id)
            JOIN ev e ON e.prefix = l.prefix AND e.term = q.term GROUP BY ALL),
tot{i} AS (SELECT query_id, prefix, sum(ev) AS ev_total FROM hits{i} GROUP BY ALL),
cand{i} AS (SELECT l.query_id, l.prefix, l.lp, l.len, k.token, k.n_children, coalesce(t.ev_total, 0) AS ev_total,
              coalesce(h.ev, 0) AS ev
            FROM live{i} l JOIN kids k ON k.prefix = l.prefix
            LEFT JOIN tot{i} t ON t.query_id = l.query_id AND t.prefix = l.prefix
            LEFT JOIN hits{i} h ON h.query_id = l.query_id AND h.prefix = l.prefix AND h.token = k.token),
pool{i} AS (SELECT query_id, CASE WHEN prefix = '' THEN token ELSE prefix || ' ' || token END AS prefix,
              round(lp + ln((1.0::DOUBLE + ev) / (1.0::DOUBLE * n_children + ev_total)), 6) AS lp,
              len + 1 AS len, token = '</s>' AS done FROM cand{i}
            UNION ALL SELECT * FROM s{i} WHERE done),
s{i + 1} AS MATERIALIZED (SELECT * FROM pool{i}
           QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(lp / len, 6) DESC, prefix) <= {beams})""")
    parts.append(f"""beams AS (SELECT query_id,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(lp / len, 6) DESC, prefix) AS BIGINT) AS rank,
  regexp_replace(prefix, '( |^)</s>$', '') AS docid, round(lp / len, 6) AS score FROM s{steps} WHERE done),
tg AS (SELECT query_id, query_type, target FROM bq),
branks AS MATERIALIZED (SELECT tg.query_id, tg.query_type, tg.target, min(b.rank) AS rank FROM tg
           LEFT JOIN beams b ON b.query_id = tg.query_id AND b.docid = tg.target GROUP BY ALL)""")
    return ",\n".join(parts)


BEAM = beam_sql()
ORACLE["beam_retrieve"] = f"WITH {BEAM} SELECT query_id, rank, docid, score FROM beams"
ORACLE["beam_eval"] = f"""WITH {BEAM}
SELECT 'DSI-base' AS system, query_type, n_queries, mrr_3, mrr_20, hits_1, hits_10
FROM ({per_type('branks')} UNION ALL {macro('branks')})"""
_BM25_TAIL = BM25[len(QUERIES):]
ORACLE["saved_results"] = f"""WITH {BEAM} {_BM25_TAIL},
sz AS (SELECT 'N' || CAST(count(*) AS VARCHAR) AS size FROM prep)
SELECT x.system, size, 'text_rank_d2q_q1' AS experiment_type, 'v1.0' AS version, mrr_3, mrr_20, hits_1, hits_10
FROM (SELECT 'BM25-base' AS system, * FROM ({macro()}) UNION ALL SELECT 'DSI-base', * FROM ({macro('branks')})) x, sz"""
ORACLE["beam_hits"] = f"""WITH {BEAM},
vd AS (SELECT query_id, docid, min(rank) AS r FROM beams WHERE docid IN (SELECT docid FROM ids) GROUP BY ALL),
rr AS (SELECT query_id, docid, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM vd),
hr AS (SELECT tg.query_id, min(rr.rank) AS rank FROM tg LEFT JOIN rr ON rr.query_id = tg.query_id
       AND rr.docid = tg.target AND rr.rank <= 10 GROUP BY ALL)
SELECT count(*) AS n_queries, round(avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hits_1,
  round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hits_10 FROM hr"""
ORACLE["valid_dedupe_rank"] = f"""WITH {BEAM},
bh AS (SELECT query_id, rank, array_to_string(string_split(docid, ' ')[1:2], ' ') AS item FROM beams),
vi AS (SELECT DISTINCT array_to_string(string_split(i.docid, ' ')[1:2], ' ') AS item FROM ids i
       JOIN corpus c ON c.mid = i.doc_id WHERE c.lang = 'en'),
fr AS (SELECT query_id, item, min(rank) AS fr FROM bh GROUP BY ALL)
SELECT query_id, item, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fr) AS BIGINT) AS rank
FROM fr WHERE item IN (SELECT item FROM vi)"""

# ------------------------------------------------------------------ re-rank
PAIRS = f"""{RANKER},
pp AS (SELECT source, doc_id, coalesce(question, '') AS query, concat_ws(' ', title, text) AS context FROM rk),
pq AS (SELECT DISTINCT source, doc_id, unnest({toks('query')}) AS term FROM pp),
pc AS (SELECT DISTINCT source, doc_id, unnest({toks('context')}) AS term FROM pp),
psc AS (SELECT source, doc_id, sum(ts.idf) AS score FROM pq JOIN pc USING (source, doc_id, term) JOIN ts USING (term)
        GROUP BY ALL),
scored AS (SELECT pp.source, pp.doc_id, round(coalesce(psc.score, 0.0::DOUBLE), 6) AS score
           FROM pp LEFT JOIN psc USING (source, doc_id))"""
ORACLE["score_pairs"] = f"WITH {INDEX}, {PAIRS} SELECT source, doc_id, score FROM scored"
ORACLE["rerank_with_scorer"] = f"""WITH {QR},
cq AS (SELECT DISTINCT b.docid, a.question AS query, b.passage FROM qa a JOIN qa b USING (conv_id)),
ct AS (SELECT docid, query, {toks('query')} AS q, {toks('passage')} AS c FROM cq),
cs AS (SELECT docid, query, CASE WHEN len(q) = 0 THEN 0.0::DOUBLE ELSE
              round(len(list_filter(q, lambda x: list_contains(c, x)))::DOUBLE / len(q), 6) END AS score FROM ct)
SELECT docid, CAST(row_number() OVER (PARTITION BY docid ORDER BY score DESC, query) AS BIGINT) AS rank, query, score FROM cs"""
ORACLE["rerank_queries"] = f"""WITH {INDEX},
ss AS (SELECT mid AS doc_id, body_clean, regexp_extract_all(body_clean, {SENT}) AS s FROM corpus),
cq AS (SELECT DISTINCT doc_id, unnest(s) AS query FROM ss),
qt AS (SELECT DISTINCT doc_id, query, unnest({toks('query')}) AS term FROM cq),
ct AS (SELECT DISTINCT doc_id, unnest({toks('body_clean')}) AS term FROM ss),
rsc AS (SELECT doc_id, query, sum(ts.idf) AS score FROM qt JOIN ct USING (doc_id, term) JOIN ts USING (term) GROUP BY ALL),
r AS (SELECT cq.doc_id, cq.query, round(coalesce(rsc.score, 0.0::DOUBLE), 6) AS score FROM cq LEFT JOIN rsc USING (doc_id, query))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, query) AS BIGINT) AS rank, query, score FROM r"""
HNG_BODY = f"""pos AS (SELECT source, min(doc_id) AS doc_id FROM rk WHERE is_positive GROUP BY source),
neg AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {seeded(313, 'doc_id')}, doc_id) AS rn,
          count(*) OVER (PARTITION BY source) AS n_neg FROM rk WHERE NOT is_positive),
sl AS (SELECT source, doc_id, CAST(unnest(range(rn, 4, n_neg)) AS BIGINT) AS slot FROM neg WHERE rn <= 3),
hg AS (SELECT source, CAST(0 AS BIGINT) AS slot, doc_id, true AS is_positive FROM pos WHERE source IN (SELECT source FROM neg)
       UNION ALL SELECT source, slot, doc_id, false FROM sl WHERE source IN (SELECT source FROM pos))"""
HNG = RANKER + ",\n" + HNG_BODY
ORACLE["hard_negative_groups"] = f"WITH {HNG} SELECT source, slot, doc_id, is_positive FROM hg"
ORACLE["listwise_loss"] = f"""WITH {INDEX}, {PAIRS}, {HNG_BODY},
g AS (SELECT hg.source, hg.slot, s.score FROM hg JOIN scored s USING (source, doc_id)),
m AS (SELECT source, max(score) AS m FROM g GROUP BY source),
per AS (SELECT g.source, max(m.m) + ln(sum(exp(g.score - m.m))) - max(CASE WHEN g.slot = 0 THEN g.score END) AS loss
        FROM g JOIN m USING (source) GROUP BY g.source)
SELECT count(*) AS n_groups, round(avg(loss), 6) AS loss FROM per"""

# ------------------------------------------------------------------ sources / sinks
ORACLE["sink_roundtrip"] = ORACLE["scan_corpus"]
RESULTS = """b AS (SELECT 'BM25-base' AS system, source AS size, 'base' AS experiment_type, 'v1.0' AS version,
   round(count(*) / 1000.0::DOUBLE, 4) AS mrr_3, round(avg(n_chars) / 100000.0::DOUBLE, 4) AS mrr_20,
   0.0::DOUBLE AS hits_1, 1.0::DOUBLE AS hits_10 FROM documents GROUP BY source),
u AS (SELECT 'BM25-base' AS system, source AS size, CASE WHEN lang = 'en' THEN 'base' ELSE 'multilingual' END AS experiment_type,
   'v1.0' AS version, round(count(*) / 1000.0::DOUBLE, 4) AS mrr_3, round(avg(n_chars) / 100000.0::DOUBLE, 4) AS mrr_20,
   0.5::DOUBLE AS hits_1, 0.5::DOUBLE AS hits_10, lang AS seq FROM documents GROUP BY source, lang),
ul AS (SELECT * EXCLUDE (seq) FROM u QUALIFY row_number() OVER (PARTITION BY system, size, experiment_type, version ORDER BY seq DESC) = 1)"""
ORACLE["upsert_results"] = f"""WITH {RESULTS}
SELECT * FROM b WHERE (system, size, experiment_type, version) NOT IN (SELECT (system, size, experiment_type, version) FROM ul)
UNION ALL SELECT * FROM ul"""
PAIRS_SQL = f"""{CORPUS},
pr2 AS (SELECT 'subject: ' || coalesce(subject, '') || ' body: ' || regexp_replace(coalesce(body_clean, ''), '[\\n\\r\\t]', ' ', 'g') AS text,
   text_id FROM corpus)"""
ORACLE["jsonl_roundtrip"] = f"WITH {PAIRS_SQL} SELECT text, text_id FROM pr2"
ORACLE["pairs_to_json"] = f"WITH {PAIRS_SQL} SELECT CAST(to_json(struct_pack(text := text, text_id := text_id)) AS VARCHAR) AS line FROM pr2"
ORACLE["tsv_roundtrip"] = f"WITH {QR} SELECT qid, docid FROM qr"
ORACLE["query_tsv"] = f"WITH {QR} SELECT qid, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS text FROM qa"
ORACLE["corpus_tsv_read"] = f"""WITH {PAGES}
SELECT page_id AS docid, passage, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title FROM pf"""
_LOGGED = """count(*) AS n_rows, count(rank) AS n_found, CAST(ceil(count(*) / 32.0) AS BIGINT) AS batches,
  CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS final_epoch"""
ORACLE["run_log"] = f"""(WITH {BM25} SELECT 'bm25_eval' AS job, {_LOGGED} FROM ranks)
UNION ALL (WITH {BEAM} SELECT 'beam_eval' AS job, {_LOGGED} FROM branks)"""
ORACLE["ordered_shards"] = f"""WITH {CORPUS},
o AS (SELECT mid, row_number() OVER (ORDER BY subject, mid) AS rank, count(*) OVER () AS n FROM corpus)
SELECT mid, CAST(floor((rank - 1) / ceil(n / 8.0)) AS BIGINT) AS shard, CAST(rank AS BIGINT) AS rank FROM o"""
ORACLE["corpus_tsv"] = f"""WITH {PAGES}
SELECT CAST(page_id AS VARCHAR) || chr(9) || passage || chr(9) || regexp_replace(title, '\\s+', ' ', 'g') AS line FROM pf"""
ORACLE["nested_qa_flatten"] = f"""WITH {PAGES}
SELECT pf.title, pf.passage AS context, coalesce(regexp_extract_all(pf.passage, {SENT})[1], '') AS question,
  regexp_extract(p.html, '<html lang="([^"]*)"', 1) AS lang, CAST(pf.page_id AS VARCHAR) AS qid
FROM pf JOIN pages p USING (page_id)"""
ORACLE["multi_source_cap"] = f"""WITH {RANKER}
SELECT doc_id, question FROM rk WHERE is_positive
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10"""

ORACLE["textrank_summary"] = f"WITH {TEXTRANK} SELECT doc_id, text_rank_query FROM prep"
ORACLE["textrank_keywords"] = f"WITH {TEXTRANK} SELECT doc_id, elaborative_description FROM prep"
ORACLE["unique_docids"] = f"WITH {TEXTRANK} SELECT doc_id, trim(elaborative_description || ' ' || doc_id) AS docid FROM prep"
ORACLE["prepare_corpus"] = f"WITH {TEXTRANK} SELECT * FROM prep"
