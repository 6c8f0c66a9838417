"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .bpe import op5_bpe
from .decontaminate import EXACT, LEAST_WORDS, MASKS, MATCHES, op2_decontaminate
from .embed_dedup import op10_embedding_near_dedup
from .lexical import K, op12_lexical_search
from .line_dedup import op3_line_dedup
from .lm_score import op6_lm_score
from .packed_ids import op13_packed_ids
from .pii import op9_pii
from .simhash import op8_simhash_near_dedup
from .substring_dedup import op1_substring_dedup
from .token_counts import op4_token_counts
from .toxicity import op7_toxicity
from .txn_log import op11_txn_log

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_bpe": op5_bpe,
    "op6_lm_score": op6_lm_score,
    "op7_toxicity": op7_toxicity,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_pii": op9_pii,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_txn_log": op11_txn_log,
    "op12_lexical_search": op12_lexical_search,
    "op13_packed_ids": op13_packed_ids,
}

#: Words of whole texts, windows of 20 as strings, all but the earliest start of each sequence, and what they leave.
_OP1 = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, md5(array_to_string(list_slice(ws, p, p + 19), ' ')) AS k FROM starts) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM later),
each AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
cut AS (SELECT e.doc_id, count(g.i) AS n, string_agg(x, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS t FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN cut ON cut.doc_id = w.doc_id"""


def _seed(mask: str, word: str) -> str:
    return " || ' ' || ".join(f"list_extract({word}, i + {j})" for j, m in enumerate(mask) if m == "1")


def _seeds(src: str, key: str, least: int) -> str:
    """(key, i, k, h): the words under each mask at each place."""
    at = lambda m: f"(SELECT {key}, ws, unnest(range(1, len(ws) - {len(m) - 2})) AS i FROM {src} WHERE len(ws) >= {max(len(m), least)})"
    return " UNION ALL ".join(f"SELECT {key}, i, {k} AS k, {_seed(m, 'ws')} AS h FROM {at(m)}" for k, m in enumerate(MASKS))


#: Diagonals that share a seed; along each the stretch with the greatest sum of 1 for a match and -2 otherwise.
_OP2 = rf"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
ds AS ({_seeds("d", "doc_id", 0)}), qs AS ({_seeds("q", "item_id", EXACT)}),
short AS (SELECT item_id, len(ws) AS n, array_to_string(ws, ' ') AS h FROM q WHERE len(ws) BETWEEN {LEAST_WORDS} AND {EXACT - 1}),
grams AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS h FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM short) WHERE len(ws) >= n)),
diagonal AS (SELECT doc_id, item_id, ds.i - qs.i AS b FROM ds JOIN qs ON ds.k = qs.k AND ds.h = qs.h UNION SELECT doc_id, item_id, i - 1 FROM grams JOIN short ON short.n = grams.n AND short.h = grams.h),
pairs AS (SELECT doc_id, item_id, b, d.ws AS dw, q.ws AS qw, len(q.ws) AS n, unnest(range(greatest(b, 0), least(b + len(q.ws), len(d.ws)))) AS p FROM diagonal JOIN d USING (doc_id) JOIN q USING (item_id)),
points AS (SELECT doc_id, item_id, b, n, p, CAST(list_extract(dw, p + 1) = list_extract(qw, p - b + 1) AS INT) AS m FROM pairs),
sums AS (SELECT *, sum(3 * m - 2) OVER o AS s, sum(m) OVER o AS c FROM points WINDOW o AS (PARTITION BY doc_id, item_id, b ORDER BY p)),
lows AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY doc_id, item_id, b ORDER BY p), 0)) AS low FROM sums),
ends AS (SELECT *, p + 1 AS e FROM lows QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, b ORDER BY s - low DESC, p) = 1),
begins AS (SELECT e.doc_id, e.item_id, e.b, e.n, e.e, e.c, min(x.p) AS p0, any_value(e.low) AS low FROM ends e LEFT JOIN sums x ON x.doc_id = e.doc_id AND x.item_id = e.item_id AND x.b = e.b AND x.s = e.low AND e.low < 0 AND x.p < e.e GROUP BY ALL),
runs AS (SELECT g.doc_id, g.item_id, g.b, g.n, coalesce(g.p0 + 1, greatest(g.b, 0)) AS a, g.e, g.c - coalesce(x.c, 0) AS m FROM begins g LEFT JOIN sums x ON x.doc_id = g.doc_id AND x.item_id = g.item_id AND x.b = g.b AND x.p = g.p0)
SELECT doc_id, item_id, CAST(a AS INT) AS start_word, CAST(e AS INT) AS end_word, CAST(m AS INT) AS n_matched, CAST(n AS INT) AS n_item_words FROM runs WHERE m >= CASE WHEN n < {EXACT} THEN n ELSE least({MATCHES}, (4 * n + 4) // 5) END QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY m DESC, b) = 1"""

#: Cosines of all pairs in double precision, and what each vector reaches by links.
_OP10 = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT u, v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
least_of AS (SELECT u, min(v) AS low FROM reach GROUP BY u), number AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept FROM embeddings LEFT JOIN number ON number.u = vec_id LEFT JOIN least_of ON least_of.u = vec_id"""



def _crc32(x: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, bit by bit."""
    bits = f"flatten(list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda y: list_transform(range(8), lambda i: (CAST('0x' || y AS BIGINT) >> i) & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], {bits}), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


#: A transaction's records one after the other; the store after an epoch has the last change of each key up to there.
_OP11 = rf"""WITH RECURSIVE h AS (SELECT doc_id, coalesce('=' || source, '') AS src, text, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT *, h % 23 AS m, (h // 100) % 300 AS key, text IS NULL OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS gone FROM h),
r AS MATERIALIZED (SELECT doc_id, src, m, key, CASE WHEN m > 6 AND NOT gone THEN {_crc32("key || ':' || text")} END AS v, coalesce(sum(CAST(m <= 2 AS INT)) OVER (PARTITION BY src ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS txn FROM k),
rec AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src, txn ORDER BY doc_id) AS i FROM r),
fold AS (SELECT DISTINCT src, txn, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id BIGINT, key BIGINT, v BIGINT, d BIGINT)[]) AS live, CAST(0 AS BIGINT) AS d FROM rec
UNION ALL SELECT f.src, f.txn, rec.i, CASE WHEN m > 6 THEN list_append(f.live, {{'id': doc_id, 'key': rec.key, 'v': v, 'd': f.d}}) WHEN m > 4 THEN list_filter(f.live, lambda c: c.d < f.d) ELSE f.live END, CASE WHEN m IN (3, 4) THEN f.d + 1 WHEN m IN (5, 6) THEN greatest(f.d - 1, 0) ELSE f.d END FROM fold f JOIN rec ON rec.src = f.src AND rec.txn = f.txn AND rec.i = f.i + 1),
back AS (SELECT unnest(list_filter(f.live, lambda c: c.d = f.d)) AS c, doc_id AS ender FROM fold f JOIN rec ON rec.src = f.src AND rec.txn = f.txn AND rec.i = f.i + 1 WHERE m IN (5, 6)),
done AS (SELECT f.src, f.txn, f.live, CASE WHEN m <= 2 THEN doc_id END AS ender, m <= 1 AS committed FROM fold f JOIN rec USING (src, txn, i) QUALIFY row_number() OVER (PARTITION BY f.src, f.txn ORDER BY f.i DESC) = 1),
numbered AS (SELECT src, txn, live, row_number() OVER (ORDER BY ender) AS n FROM done WHERE committed),
applied AS (SELECT n, (n - 1) // 4 + 1 AS epoch, unnest(live) AS c FROM numbered),
epochs AS (SELECT DISTINCT (n - 1) // 4 + 1 AS epoch FROM numbered),
last AS (SELECT e.epoch, c.key AS key, c.v AS v FROM epochs e JOIN applied a ON a.epoch <= e.epoch QUALIFY row_number() OVER (PARTITION BY e.epoch, c.key ORDER BY n DESC, c.id DESC) = 1)
SELECT 'state' AS kind, epoch AS id, count(v) AS n, CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM epochs LEFT JOIN last USING (epoch) GROUP BY epoch
UNION ALL SELECT 'rollback', c.id, ender, c.key FROM back UNION ALL SELECT 'abort', c.id, ender, c.key FROM (SELECT unnest(live) AS c, ender FROM done WHERE NOT committed)"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Scores of all documents that share a term with an item.
_OP12 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) FILTER (len(ts) > 0) AS a, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY ALL), w AS (SELECT t, CAST(floor(1000 * ln((2 * a + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, a),
q AS (SELECT i, item_id, unnest(list_distinct(ts)) AS t FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ts FROM benchmark WHERE text IS NOT NULL)),
sc AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * a) // l)))) AS BIGINT) AS score FROM q JOIN tf USING (t) JOIN w USING (t), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM sc WHERE score > 0 QUALIFY rank <= {K}"""

#: Encoders, trained models, alignments and XXH64 are beyond SQL; tests/llm holds the other queries against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": _OP1,
    "op2_decontaminate": _OP2,
    "op10_embedding_near_dedup": _OP10,
    "op11_txn_log": _OP11,
    "op12_lexical_search": _OP12,
}
