"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from quarry.llm import fm_index, mixing

_UNIT = r"\n|[^\x20\x09-\x0D]{1,8}"


def _root(t: str) -> str:
    return (f"sha256(array_to_string(list_transform(string_split({t}, chr(10) || chr(10)), lambda s: "
            f"sha256(array_to_string(list_transform(string_split(s, chr(10)), lambda p: sha256(p)), ''))), ''))")


def _leaves(t: str) -> str:
    """Distinct pairs of neighbouring units; no unit holds the joining sign."""
    units = f"regexp_extract_all({t}, '{_UNIT}')"
    return (f"list_distinct(list_transform(list_zip(list_concat([''], {units}), list_concat({units}, [''])), "
            f"lambda x: x[1] || chr(32) || x[2]))")


def _near(ra: str, la: str, rb: str, lb: str) -> str:
    return (f"round(CASE WHEN {ra} = {rb} THEN 1.0 WHEN len({la}) + len({lb}) = 0 THEN 0.0 "
            f"ELSE least(2.0::DOUBLE * len(list_intersect({la}, {lb})) / (len({la}) + len({lb})), 0.999) END, 6)::DOUBLE")


FINGERPRINTS = rf"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt, length(text) AS n
      FROM b WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text
                          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substring(text, 1, n - n // 2) || substring(nxt, 1, n // 2) AS edited FROM n),
f AS (SELECT doc_id, n, sha256(edited) AS edited_sha256, {_root('text')} AS r, {_root('edited')} AS er, {_root('nxt')} AS nr,
             {_leaves('text')} AS l, {_leaves('edited')} AS el, {_leaves('nxt')} AS nl FROM e)
SELECT doc_id, n AS n_chars, edited_sha256, r AS fingerprint, er AS edited_fingerprint,
       {_near('r', 'l', 'er', 'el')} AS near_edited, {_near('r', 'l', 'nr', 'nl')} AS near_next FROM f
"""

_W = ", ".join(str(float(x)) for x in mixing.WEIGHTS)


def _seats(name: str, frm: str, group: str, votes: str, seats: str, key: str, most: str = "(1::BIGINT << 60)") -> str:
    """CTEs that give ``{name}`` = the rows of ``frm`` with ``won``."""
    return f"""
{name}0 AS (SELECT *, {votes}::DOUBLE AS v, CASE WHEN sum({votes}::DOUBLE) OVER (PARTITION BY {group}) > 0
            THEN {votes}::DOUBLE / sum({votes}::DOUBLE) OVER (PARTITION BY {group}) ELSE 0 END AS share,
            count(*) OVER (PARTITION BY {group}) AS m FROM {frm}),
{name}1 AS (SELECT *, least(greatest(floor(share * {seats} - (share * m / 2 + 1)), 0)::BIGINT, {most}) AS low,
            least(ceil(share * {seats} + (share * m / 2 + 1))::BIGINT, {most} - 1) AS high FROM {name}0),
{name}2 AS (SELECT *, {seats} - sum(low) OVER (PARTITION BY {group}) AS room FROM {name}1),
{name}3 AS (SELECT {group}, {key}, v, room, unnest(generate_series(low, high)) AS k FROM {name}2 WHERE v > 0 AND low <= high),
{name}4 AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY v / (2 * k + 1) DESC, {key}, k) AS r FROM {name}3),
{name}5 AS (SELECT {group}, {key}, count(*) AS n FROM {name}4 WHERE r <= room GROUP BY ALL),
{name} AS (SELECT a.*, CASE WHEN a.v > 0 THEN a.low + coalesce(x.n, 0) ELSE 0 END AS won
           FROM {name}2 a LEFT JOIN {name}5 x ON a.{group} = x.{group} AND a.{key} = x.{key})"""


def _picked(x: str) -> str:
    """Words in selected blocks before place ``x``."""
    n = mixing.BLOCK_WORDS
    at = f"(({x} // {n}) * r + c) // nb"
    return f"({at}) * {n} + ((({x} // {n} + 1) * r + c) // nb - ({at})) * ({x} % {n})"


MIXING = rf"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') AS sk,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT sum(size) AS total, greatest(1, ceil(count(*) / {mixing.ROWS_PER_SHARD}.0))::BIGINT AS shards FROM d),
b AS (SELECT d.*, ('0x' || substr(h, 1, 8))::BIGINT % shards AS shard FROM d, t),
c AS (SELECT sk, shard, sum(size) AS cell_size FROM b GROUP BY ALL),
s0 AS (SELECT sk, source, sum(size) AS source_size FROM b GROUP BY ALL),
s1 AS (SELECT *, [{_W}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}) + 1] AS w,
              ({mixing.REPEAT_LIMIT} * source_size)::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, (SELECT total FROM t)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
              sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s1),
lv AS (SELECT min_by(remains / rest, cap / w) AS level FROM s2 WHERE cap / w > remains / rest),
s AS (SELECT sk, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target,
             0 AS al, ceil((SELECT total FROM t) / {mixing.BLOCK_WORDS}.0)::BIGINT AS seats FROM s2, lv),
{_seats('p', 's', 'al', 'target', 'seats', 'sk')},
cs AS (SELECT c.sk, c.shard, c.cell_size, ceil(c.cell_size / {mixing.BLOCK_WORDS}.0)::BIGINT AS nb,
              {mixing.REPEAT_LIMIT} * ceil(c.cell_size / {mixing.BLOCK_WORDS}.0)::BIGINT AS most,
              p.source_size, p.target, p.won AS blocks FROM c JOIN p USING (sk)),
{_seats('q', 'cs', 'sk', 'cell_size', 'blocks', 'shard', 'most')},
z AS (SELECT sk, shard, source_size, target, nb, won // greatest(nb, 1) AS passes, won % greatest(nb, 1) AS r,
             ('0x' || substr(md5('{mixing.SEED}:' || sk || ':' || shard), 1, 8))::BIGINT % greatest(nb, 1) AS c FROM q),
r AS (SELECT b.doc_id, b.size, z.source_size, z.target, z.nb, z.passes, z.r, z.c,
             coalesce(sum(b.size) OVER (PARTITION BY b.sk, b.shard ORDER BY b.h, b.doc_id, b.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM b JOIN z USING (sk, shard))
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (CASE WHEN nb > 0 THEN passes * size + ({_picked('(before + size)')}) - ({_picked('before')}) ELSE 0 END)::BIGINT AS taken
FROM r
"""

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(len(w), {fm_index.WINDOW}) AS n,
             array_to_string(list_slice(w, k, k + least(len(w), {fm_index.WINDOW}) - 1), ' ') AS g
      FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {fm_index.WINDOW} + 1))) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT r, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
      FROM (SELECT d.r, d.w, l.n, unnest(generate_series(1, len(d.w) - l.n + 1)) AS k FROM d, (SELECT DISTINCT n FROM v) l
            WHERE len(d.w) >= l.n)),
h AS (SELECT s.r, s.k, s.n, v.item FROM s JOIN v ON s.n = v.n AND s.g = v.g),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""

ORACLE = {
    "op13_decontamination": DECONTAMINATION,
    "op1_fingerprints": FINGERPRINTS,
    "op2_mixing": MIXING,
}
