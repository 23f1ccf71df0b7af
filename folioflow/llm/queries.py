"""The registered queries of this subpackage and their DuckDB twins.

op4, op8 and op9 have none: trained networks and a byte-pair vocabulary cannot be told in SQL.
"""

from __future__ import annotations

from folioflow.llm import chat, collocations, decontaminate, language, minhash, mixing, neighbours, phrases, quality, simhash, spelling, sstable, suffixes

QUERIES = {"op1_decontaminate": decontaminate.op1, "op2_suffix_dedup": suffixes.op2, "op3_mix_sources": mixing.op3, "op4_language_id": language.op4, "op5_neighbours": neighbours.op5, "op6_chat_format": chat.op6, "op10_minhash": minhash.op10, "op7_phrase_dedup": phrases.op7, "op8_token_sstable": sstable.op8, "op9_quality": quality.op9, "op11_collocations": collocations.op11, "op12_simhash": simhash.op12, "op13_spelling": spelling.op13}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SOLID = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, pattern: str) -> str:
    return f"coalesce(regexp_extract_all({text}, '{pattern}'), [])"


OP1 = f"""
WITH d AS (SELECT doc_id, {_words(_LOW.format("text"), _ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {_words(_LOW.format("text"), _ALNUM)} AS w FROM benchmark WHERE item_id IS NOT NULL),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, i, n FROM places JOIN phrases USING (n, p)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# hexadecimal digits stand for bytes: two to each
OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
parts AS (SELECT doc_id, j, substr(x, 2 * j + 1, 1198) AS y FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99, 500)) AS j FROM d WHERE length(x) >= 200)),
w AS (SELECT doc_id, j + i AS i, md5(substr(y, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, j, y, unnest(range(0, length(y) // 2 - 99)) AS i FROM parts)),
least_of AS (SELECT s, min({'d': doc_id, 'i': i}) AS e FROM w GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, i FROM w JOIN least_of USING (s) WHERE (doc_id, i) <> (e.d, e.i)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
      SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM gone)) GROUP BY doc_id, run),
kept AS (SELECT doc_id, count(*) AS n, sum(b - a) AS removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM runs GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN x ELSE array_to_string(list_transform(range(0, n + 1), lambda k:
    substr(x, 2 * (CASE WHEN k = 0 THEN 0 ELSE b[k] END) + 1, 2 * ((CASE WHEN k = n THEN length(x) // 2 ELSE a[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE b[k] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP3 = f"""
WITH d AS (SELECT doc_id, source, len({_words("text", _SOLID)}) AS size,
    ('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 6))::BIGINT AS c FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w FROM d GROUP BY source),
-- sources that reach three times their size first; from the first that doesn't on, all share by weight
o AS (SELECT *, sum(3 * n) OVER up AS held, sum(w) OVER up AS shut, sum(n) OVER () AS total, sum(w) OVER () AS weights, row_number() OVER up AS k
  FROM s WINDOW up AS (ORDER BY 3 * n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT min(k) AS k FROM o WHERE (total - (held - 3 * n)) * w / (weights - (shut - w)) <= 3 * n),
first AS (SELECT (total - (held - 3 * n))::DOUBLE AS rest, weights - (shut - w) AS open, k FROM o JOIN level USING (k)),
t AS (SELECT source, n, CASE WHEN o.k >= first.k THEN rest * w / open ELSE (3 * n)::DOUBLE END AS target FROM o LEFT JOIN first ON true),
q AS (SELECT source, n, target, CASE WHEN n > 0 THEN round(target)::BIGINT // n ELSE 0 END AS times, CASE WHEN n > 0 THEN round(target)::BIGINT % n ELSE 0 END AS rest FROM t),
cells AS (SELECT source, c, sum(size) AS m, sum(sum(size)) OVER (PARTITION BY source ORDER BY c) AS upto FROM d GROUP BY source, c),
edge AS (SELECT q.source, min(c) AS c FROM cells JOIN q ON q.source IS NOT DISTINCT FROM cells.source WHERE upto > rest GROUP BY q.source),
cut AS (SELECT e.source, e.c, m, upto - m AS below FROM edge e JOIN cells ON e.source IS NOT DISTINCT FROM cells.source AND e.c = cells.c)
SELECT doc_id, size::BIGINT AS size, n AS source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE size * times + CASE WHEN rest = 0 THEN 0 WHEN d.c < cut.c THEN size WHEN d.c = cut.c THEN floor(size * ((rest - below)::DOUBLE / m))::BIGINT ELSE 0 END END)::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""

# Exact search, which the graphs reach at the size of the comparison; recall at larger ones is measured in the tests.
OP5 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT * FROM (
  SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id)::INTEGER AS rank, v.vec_id, list_inner_product(q.e, v.e) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0)
WHERE rank <= 20
"""

_HARD = r"\### Assistant: </turn> ok"
_ESCAPED = r"length(regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g'))"
OP6 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_HARD}' UNION ALL SELECT -7, 1, 'assistant', '{_HARD}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_ESCAPED.format("role")} + {_ESCAPED.format("text")} + {sum(map(len, chat.MARKS))})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {_words("text", _SOLID)} AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
least_of AS (SELECT s, min(doc_id) AS e FROM p GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM p JOIN least_of USING (s) WHERE doc_id > e),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS x FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS k FROM d) ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(x, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOW.format("text"), _SOLID)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id < b.doc_id JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n) GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
arcs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS x, a AS y FROM arcs UNION SELECT reach.x, arcs.b FROM reach JOIN arcs ON reach.y = arcs.a),
c AS (SELECT x, min(y) AS least FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = doc_id
"""

_PIECES = r"[.,;:!?\x0A-\x0D]"
_CAND = "(SELECT lang, g, f FROM grams WHERE n > 1 AND f >= 10)"
OP11 = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, {_words("piece", r"[^\x20\x09]+")} AS w
  FROM (SELECT lang, unnest(regexp_split_to_array({_LOW.format("text")}, '{_PIECES}')) AS piece FROM documents WHERE text IS NOT NULL)),
grams AS MATERIALIZED (SELECT lang, n, array_to_string(w[i:i + n - 1], ' ') AS g, count(*) AS f
  FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS s(n) WHERE len(w) >= n) GROUP BY ALL HAVING n = 1 OR f >= 10),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE n = 1 GROUP BY lang),
cuts AS (SELECT lang, g, f, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
  FROM (SELECT lang, g, f, w, unnest(range(1, len(w))) AS k FROM (SELECT *, string_split(g, ' ') AS w FROM {_CAND}))),
scores AS (SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, 1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f) AS score
  FROM cuts AS c JOIN grams AS l ON l.lang = c.lang AND l.g = c.x JOIN grams AS r ON r.lang = c.lang AND r.g = c.y),
least_of AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, p, max(f) AS f FROM (
    SELECT lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS p FROM (SELECT lang, f, string_split(g, ' ') AS w FROM grams WHERE n = 3)) GROUP BY ALL),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.g) AS rank
  FROM least_of AS s LEFT JOIN longer AS o ON o.lang = s.lang AND o.p = s.g WHERE o.f IS NULL OR 100 * o.f < 50 * a)
SELECT lang, rank::BIGINT AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

def _mod(x: str) -> str:
    return f"(({x}) % 18446744073709551616::UHUGEINT)"


def _rotl(x: str, r: int) -> str:
    """x is a column; both ends of it as numbers of 128 bits."""
    return f"({_mod(f'{x} * {1 << r}')} + {x} // {1 << (64 - r)})"


def _lane(h: str, at: str, size: int) -> str:
    """The little-endian number of so many bytes of a hexadecimal text."""
    return "('0x' || " + " || ".join(f"substr({h}, (2 * ({at}) + {2 * k + 1})::BIGINT, 2)" for k in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


_SEED = 42
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)  # fixed values of XXH64
_P1, _P2, _P3, _P4, _P5 = (f"{p}::UHUGEINT" for p in _PRIMES)
_V = [(_SEED + sum(x)) % (1 << 64) for x in ((_PRIMES[0], _PRIMES[1]), (_PRIMES[1],), (), (-_PRIMES[0],))]
OP12 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOW.format("text"), _SOLID)} AS w FROM documents),
s AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)) GROUP BY doc_id, x),
own AS (SELECT x, hex(encode(x)) AS h, strlen(x)::BIGINT AS n FROM (SELECT DISTINCT x FROM s)),
st AS (SELECT x, h, n, 0::BIGINT AS p, {", ".join(f"{v}::UHUGEINT AS v{k}" for k, v in enumerate(_V))} FROM own WHERE n >= 32
  UNION ALL SELECT x, h, n, p + 32, {", ".join(_mod(f"{_rotl(f'a{k}', 31)} * {_P1}") for k in range(4))}
  FROM (SELECT *, {", ".join(_mod(f"v{k} + {_lane('h', f'p + {8 * k}', 8)} * {_P2}") + f" AS a{k}" for k in range(4))} FROM st WHERE p + 32 <= n)),
m0 AS (SELECT x, h, n, p, {_mod(" + ".join(_rotl(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))))} AS acc, {", ".join(_mod(f"v{k} * {_P2}") + f" AS b{k}" for k in range(4))} FROM st WHERE p + 32 > n),
m1 AS (SELECT *, {", ".join(_mod(f"{_rotl(f'b{k}', 31)} * {_P1}") + f" AS c{k}" for k in range(4))} FROM m0),
{"".join(f"n{k} AS (SELECT * EXCLUDE (acc), {_mod(f'xor(acc, c{k}) * {_P1} + {_P4}')} AS acc FROM {'m1' if k == 0 else f'n{k - 1}'})," + chr(10) for k in range(4))}
tl AS (SELECT x, h, n, p, {_mod("acc + n::UHUGEINT")} AS acc FROM (SELECT x, h, n, p, acc FROM n3 UNION ALL SELECT x, h, n, 0, {_mod(f"{_SEED}::UHUGEINT + {_P5}")} FROM own WHERE n < 32)
  UNION ALL SELECT x, h, n, p + w, CASE w WHEN 8 THEN {_mod(f"{_rotl('y', 27)} * {_P1} + {_P4}")} WHEN 4 THEN {_mod(f"{_rotl('y', 23)} * {_P2} + {_P3}")} ELSE {_mod(f"{_rotl('y', 11)} * {_P1}")} END
  FROM (SELECT *, xor(acc, CASE w WHEN 8 THEN {_mod(f"{_rotl('k', 31)} * {_P1}")} ELSE k END) AS y FROM (
    SELECT *, CASE w WHEN 8 THEN {_mod(f"{_lane('h', 'p', 8)} * {_P2}")} WHEN 4 THEN {_mod(f"{_lane('h', 'p', 4)} * {_P1}")} ELSE {_mod(f"{_lane('h', 'p', 1)} * {_P5}")} END AS k FROM (
      SELECT *, CASE WHEN p + 8 <= n THEN 8 WHEN p + 4 <= n THEN 4 ELSE 1 END AS w FROM tl WHERE p < n)))),
e1 AS (SELECT x, {_mod(f"xor(acc, acc // {1 << 33}) * {_P2}")} AS acc FROM tl WHERE p = n),
e2 AS (SELECT x, {_mod(f"xor(acc, acc // {1 << 29}) * {_P3}")} AS acc FROM e1),
hashed AS (SELECT x, xor(acc, acc // {1 << 32})::UBIGINT AS v FROM e2),
bits AS (SELECT doc_id, {" + ".join(f"CASE WHEN 2 * sum(CASE WHEN (v >> {b}) & 1 = 1 THEN c ELSE 0 END) > sum(c) THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))} AS fp FROM s JOIN hashed USING (x) GROUP BY doc_id),
prints AS (SELECT doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM d LEFT JOIN bits USING (doc_id)),
f AS (SELECT fp, min(doc_id) AS least FROM prints GROUP BY fp),
arcs AS (SELECT a.fp AS a, b.fp AS b FROM f AS a JOIN f AS b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 3),
reach AS (SELECT fp AS x, fp AS y FROM f UNION SELECT reach.x, arcs.b FROM reach JOIN arcs ON reach.y = arcs.a),
c AS (SELECT reach.x AS fp, min(f.least) AS component_id FROM reach JOIN f ON f.fp = reach.y GROUP BY reach.x)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN c USING (fp)
"""

OP13 = f"""
WITH RECURSIVE tab0 AS (SELECT i, 0 AS k, i AS v FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM tab0 WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM tab0 WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest({_words(_LOW.format("text"), r"[a-z\x{C0}-\x{FF}]+")}) AS run FROM documents) GROUP BY doc_id, run),
hx AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs),
crc AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS c FROM hx, tab),
words AS (SELECT w, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN c % 97 = 0 THEN substr(run, 1, c % length(run)) || substr(run, c % length(run) + 2) ELSE run END AS w, n FROM crc) WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
keys AS (SELECT w, n, i, substr(w, 1, i - 1) AS a, substr(w, i + 1) AS b FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)),
less AS (SELECT DISTINCT w AS long_, n, a || b AS short_ FROM keys),
near AS (
  SELECT x.w, y.w AS o, y.n FROM keys AS x JOIN keys AS y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.w <> y.w
  UNION ALL SELECT long_, words.w, words.n FROM less JOIN words ON words.w = short_
  UNION ALL SELECT words.w, long_, less.n FROM less JOIN words ON words.w = short_),
best AS (SELECT w, count(*) AS k, arg_min(o, (-n, o)) AS o, max(n) AS m FROM near GROUP BY w),
forms AS (SELECT words.w, words.n, coalesce(k, 0)::BIGINT AS k, CASE WHEN m >= 2 * n THEN o END AS form, CASE WHEN m >= 2 * n THEN m END AS m FROM words LEFT JOIN best USING (w)),
way AS (SELECT w, w AS z FROM forms UNION ALL SELECT way.w, form FROM way JOIN forms ON forms.w = way.z WHERE form IS NOT NULL),
ends AS (SELECT way.w, way.z FROM way JOIN forms ON forms.w = way.z WHERE form IS NULL)
SELECT w AS word, form, z AS root, n, k AS n_near, m AS form_n FROM forms JOIN ends USING (w)
"""


SQL: dict[str, str] = {"op12_simhash": OP12, "op13_spelling": OP13, "op11_collocations": OP11, "op1_decontaminate": OP1, "op2_suffix_dedup": OP2, "op3_mix_sources": OP3, "op5_neighbours": OP5, "op6_chat_format": OP6, "op7_phrase_dedup": OP7, "op10_minhash": OP10}
