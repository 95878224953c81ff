"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from cellweave.llm.quality_rules import Rules


def certified_rules(rules: Rules = Rules()) -> str:
    """The counts by unnested words and windows, the severities, and the certified rung of each stratum."""
    a, top = rules.max_false_reject, len(rules.cutoffs[0][1])
    level = rules.delta / len(rules.bands)
    rungs = ", ".join("(" + " + ".join(f"({k} > {c!r}::double)::int" for c in cuts) + ")" for k, cuts in rules.cutoffs)
    stratum = "CASE " + " ".join(f"WHEN n_words >= {b} THEN {i}" for i, b in reversed(list(enumerate(rules.bands)))) + " END"
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{word}') ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{word}')) ls FROM d),
g AS (SELECT rid, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) i FROM w)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) n FROM g),
v AS (SELECT rid, count(DISTINCT i + j) n FROM c, (SELECT unnest([0, 1, 2]) j) WHERE n > 1 GROUP BY rid),
m AS (SELECT rid, doc_id, len(ws)::bigint n_words, coalesce(length(array_to_string(ws, '')), 0)::bigint word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(v.n, 0)::bigint n_repeat_words, len(ls) n_lines, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) n_capitals FROM w LEFT JOIN v USING (rid)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed, {stratum} stratum, coalesce(n_symbols::double / nullif(n_words, 0), 0) symbols, coalesce(n_dup_lines::double / nullif(n_lines, 0), 0) dup_lines,
  coalesce(n_repeat_words::double / nullif(n_words, 0), 0) repeats, coalesce(n_capitals::double / nullif(word_chars, 0), 0) capitals FROM m),
x AS (SELECT *, greatest({rungs}, 0) severity FROM s),
l AS (SELECT doc_id, max(quality) good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
y AS (SELECT stratum, severity, good FROM x JOIN l USING (doc_id) WHERE NOT base_failed),
q AS (SELECT stratum, rung, sum(good)::bigint n, sum(1 - good)::bigint m, count(*) FILTER (WHERE severity >= rung AND good = 1) k, count(*) FILTER (WHERE severity >= rung AND good = 0) b FROM y, (SELECT unnest(range(1, {top + 1})) rung) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k > n * {a!r}::double THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({a!r}) + (n - i) * ln(1 - {a!r})))) END p FROM q WHERE n > 0),
o AS (SELECT *, bool_and(p <= {level!r}) OVER (PARTITION BY stratum ORDER BY rung DESC) ok FROM p),
r AS (SELECT stratum, rung FROM o WHERE ok QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY coalesce(b::double / nullif(m, 0) - {rules.good_weight!r} * (k::double / n), 0) DESC, rung DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(severity >= r.rung, false) kept FROM x LEFT JOIN r USING (stratum)"""


def merkle_manifest() -> str:
    """All nodes of both kinds of tree by a recursion over their levels, siblings by run, and the present leaves folded."""
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    digest = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars")) + f" || {field(text)})"
    crc = "(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda ch: ord(ch)::bigint)), lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda v, i: xor(v >> 1, (v & 1) * 3988292384))))"
    even = f"doc_id IS NOT NULL AND xor({crc}, 4294967295) % 2 = 0"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN {even} THEN replace(text, chr(10), '') ELSE text END present FROM documents),
l AS (SELECT doc_id, source, {digest('text')} leaf, {digest('present')} present FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 i, count(*) OVER (PARTITION BY source) n FROM l),
t AS (SELECT 0 k, source, i, n, leaf h FROM p UNION ALL SELECT k + 1, source, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY k, source, i // 3, n),
s AS (SELECT source, h subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 i, count(*) OVER () n FROM t WHERE n = 1),
u AS (SELECT 0 k, i, n, subroot h FROM s UNION ALL SELECT k + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY k, i // 3, n),
r AS (SELECT h root FROM u WHERE n = 1),
tb AS (SELECT source, k, i // 3 run, list(h ORDER BY i) hs FROM t WHERE n > 1 GROUP BY ALL),
ub AS (SELECT k, i // 3 run, list(h ORDER BY i) hs FROM u WHERE n > 1 GROUP BY ALL),
st AS (SELECT p.doc_id, p.source, p.i, tb.k, array_to_string(hs[:j], '') b, array_to_string(hs[j + 2:], '') a FROM (SELECT p.*, k, (i // (3 ** k)::bigint) % 3 j, i // (3 ** (k + 1))::bigint run FROM p, (SELECT DISTINCT k FROM tb)) p JOIN tb ON tb.source IS NOT DISTINCT FROM p.source AND tb.k = p.k AND tb.run = p.run),
su AS (SELECT s.source, ub.k, array_to_string(hs[:j], '') b, array_to_string(hs[j + 2:], '') a FROM (SELECT s.*, k, (i // (3 ** k)::bigint) % 3 j, i // (3 ** (k + 1))::bigint run FROM s, (SELECT DISTINCT k FROM ub)) s JOIN ub USING (k, run)),
al AS (SELECT source, i, k, b, a FROM st UNION ALL SELECT p.source, p.i, 1000 + k, b, a FROM p JOIN su ON su.source IS NOT DISTINCT FROM p.source),
ls AS (SELECT source, i, list(b ORDER BY k) bs, list(a ORDER BY k) az FROM al GROUP BY ALL),
f AS (SELECT p.doc_id, p.source, p.leaf, coalesce(array_to_string(list_transform(list_zip(bs, az), lambda z: z[1] || z[2]), ''), '') proof,
  CASE WHEN bs IS NULL THEN p.present ELSE list_reduce(list_prepend(p.present, list_transform(range(1, len(bs) + 1), lambda x: x::varchar)), lambda h, x: sha256(bs[x::bigint] || h || az[x::bigint])) END folded FROM p LEFT JOIN ls ON ls.source IS NOT DISTINCT FROM p.source AND ls.i = p.i)
SELECT f.doc_id, f.leaf, s.subroot, r.root, sha256(f.proof) proof_sha256, f.folded folded_root, f.folded = r.root verified FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source, r"""


def block_negatives() -> str:
    """Scores of all pairs of an anchor and another row by unnested components, then windows over ranks."""
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id anchor_id, b.vec_id id, a.label = b.label same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id positive_id, score positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id negative_id, s.score negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rk FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rk::integer "rank", negative_id, positive_score, negative_score FROM n WHERE rk <= 5"""
