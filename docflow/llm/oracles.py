"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from docflow.llm.hilbert import BITS, DIMENSIONS, SHARDS, curve_tables
from docflow.llm.quality import CELLS, UNIT, QualityParams

#: Lower-case A-Z only; MD5 and SHA-256 are of UTF-8 text in both engines.
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = f"""
WITH d AS (SELECT doc_id, sha256({_ASCII_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""

#: Shingles as texts, all pairs that share one, and everything that links reach.
OP7 = f"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM t),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id > b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.a, r.root FROM r JOIN e ON r.doc_id = e.b)
SELECT doc_id, any_value(n) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
           - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS left_size,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS left_w,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS i
  FROM w),
f AS (SELECT i AS at_i, left_size AS at_left, left_w AS at_w FROM l WHERE left_size * w < cap * left_w ORDER BY i LIMIT 1),
t AS (
  SELECT source, source_size,
         least(CASE WHEN at_i IS NULL OR i < at_i THEN cap ELSE at_left * w / at_w END, cap) AS target
  FROM l LEFT JOIN f ON true),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('docflow-mix-1|' || coalesce(d.source, '')), 1, 5))::BIGINT::DOUBLE / 1048576.0 AS u,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.h, d.doc_id) - 1 AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, greatest(least(floor((i + 1) * rate + u) - floor(i * rate + u), 2), 0)::INT AS copies FROM p)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""



#: CRC-32 of a text's UTF-8 bytes, from its table made by rule; ``t`` is the text.
_CRC_TABLE = "(SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS crc FROM (SELECT unnest(range(0, 256)) AS n))"
_BYTES = "list_transform(range(1, strlen({t}) + 1), lambda i: (strpos('0123456789ABCDEF', h[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i]) - 1)"


def _hilbert() -> str:
    """Quantile cells of each dimension, a step of the curve for each bit plane, runs of the order."""
    entry, direction, rank = map(list, curve_tables(len(DIMENSIONS)))
    dims, mask, cells = len(DIMENSIONS), (1 << len(DIMENSIONS)) - 1, 1 << BITS
    quantiles = ", ".join(
        f"""q{k} AS (SELECT v, floor((coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) * {cells} / sum(n) OVER ())::INT AS cell
  FROM (SELECT {c} AS v, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY 1))"""
        for k, c in enumerate(DIMENSIONS)
    )
    joins = " ".join(f"LEFT JOIN q{k} ON d.{c} = q{k}.v" for k, c in enumerate(DIMENSIONS))
    planes = ""
    turn = lambda x, by, up: f"((({x}) {'<<' if up else '>>'} ({by})) | (({x}) {'>>' if up else '<<'} ({dims} - ({by})))) & {mask}"
    for step, bit in enumerate(range(BITS - 1, -1, -1)):
        plane = " | ".join(f"(((c{k} >> {bit}) & 1) << {k})" for k in range(dims))
        planes += f"""p{step} AS (SELECT *, {rank}[({turn(f'xor({plane}, e)', f'(d + 1) % {dims}', False)}) + 1] AS w, (d + 1) % {dims} AS turn FROM s{step}),
s{step + 1} AS (SELECT * EXCLUDE (h, e, d, w, turn), (h << {dims}) | w AS h, xor(e, {turn(f'{entry}[w + 1]', 'turn', True)}) AS e, (d + {direction}[w + 1] + 1) % {dims} AS d FROM p{step}),
"""
    return f"""
WITH x AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
d AS (SELECT doc_id, source, lang, strlen(t) + 1 AS size, xor(list_reduce({_BYTES.format(t="t")}, lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) AS text_crc32 FROM x, {_CRC_TABLE}),
{quantiles},
s0 AS (SELECT doc_id, size, text_crc32, {", ".join(f"coalesce(q{k}.cell, 0) AS c{k}" for k in range(dims))}, 0::BIGINT AS h, 0 AS e, 0 AS d FROM d {joins}),
{planes}o AS (SELECT *, row_number() OVER (ORDER BY h, doc_id, text_crc32) - 1 AS place, count(*) OVER () AS n FROM s{BITS}),
r AS (SELECT *, (place * {SHARDS}) // n AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (place - (shard * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, h AS hilbert FROM r
"""


def _quality() -> str:
    """Text statistics, counts on labelled rows, sites and scores, one common table each."""
    gaps = r"[\x20\x09-\x0D]+"
    kinds = (r"[!#$%&*+/<=>@\[\\\]^_`{|}~]", "[A-Z]", "[0-9]", "[.,;:]")
    share = lambda count, of, scale: f"CASE WHEN {of} > 0 THEN ({count}) * {scale} // ({of}) ELSE 0 END"
    values = [share(f"strlen(t) - strlen(regexp_replace(t, '{k}', '', 'g'))", "strlen(t)", 1000) for k in kinds]
    values += [share("strlen(array_to_string(w, ''))", "len(w)", 10), share("len(list_distinct(w))", "len(w)", 100), share("len(list_distinct(l))", "len(l)", 100), "len(w)"]
    cells = ", ".join(f"len(list_filter({list(marks)}, lambda m: m <= {v}))" for marks, v in zip(CELLS.values(), values, strict=True))
    p, u = QualityParams(), float(UNIT)
    rate = "({k} * {up} + ({s} - p) / {u}) / ({k} + {n} - 1)"
    strength = f"""CASE WHEN n <= k OR k <= up OR spread <= 0 OR (own - above) / (k - up) <= within THEN {p.most}
      ELSE least({p.most}, greatest({p.least}, within / (((own - above) / (k - up) - within) / (spread / (k - up))))) END::DOUBLE"""
    moments = "sum(n)::DOUBLE AS n, count(*)::DOUBLE AS k, sum(q)::DOUBLE AS q, sum(s * s / n)::DOUBLE AS own"
    return f"""
WITH x AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
y AS (SELECT *, list_filter(regexp_split_to_array(t, '{gaps}'), lambda z: z <> '') AS w, CASE WHEN t = '' THEN []::VARCHAR[] ELSE string_split(t, chr(10)) END AS l FROM x),
c AS (SELECT rid, doc_id, source, lang, coalesce(substr(md5(doc_id::VARCHAR), 1, 1) IN ('2', '6', 'a', 'e'), false) AS held_out, [{cells}] AS cells FROM y),
f AS (SELECT *, generate_subscripts(cells, 1) AS k, unnest(cells) AS cell FROM c),
labelled AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
counted AS (SELECT k, cell, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE NOT good) AS b FROM f JOIN labelled USING (doc_id) WHERE NOT held_out GROUP BY 1, 2),
every AS (SELECT sum(g)::DOUBLE AS g, sum(b)::DOUBLE AS b FROM counted WHERE k = 1),
ratio AS (SELECT k, cell, ln((o.g + {p.smoothing} * e.g / (e.g + e.b)) / e.g) - ln((o.b + {p.smoothing} * e.b / (e.g + e.b)) / e.b) AS r FROM counted o, every e),
scored AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(source) AS source, any_value(lang) AS lang, any_value(held_out) AS held_out, sum(coalesce(r, 0) ORDER BY f.k) AS evidence FROM f LEFT JOIN ratio ON f.k = ratio.k AND f.cell = ratio.cell GROUP BY rid),
s AS (SELECT *, round({u} / (1 + exp(-(evidence + (SELECT ln(g / b) FROM every)))))::BIGINT AS p FROM scored),
paths AS (SELECT source, lang, count(*)::DOUBLE AS n, sum(p) / {u} AS s, sum(p::HUGEINT * p)::DOUBLE / ({u} * {u}) AS q FROM s GROUP BY 1, 2),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(p) / {u} AS s, sum(p::HUGEINT * p)::DOUBLE / ({u} * {u}) AS q FROM s GROUP BY 1),
mean AS (SELECT sum(p) / count(*) / {u} AS m FROM s),
h AS (SELECT {moments}, 1.0 AS up, sum(s) * sum(s) / sum(n) AS above, sum(n) - sum(n * n) / sum(n) AS spread FROM hosts WHERE source IS NOT NULL),
host_strength AS (SELECT {strength} AS v FROM (SELECT *, greatest(0.0, q - own) / (n - k) AS within FROM h)),
o AS (SELECT source, sum(n) AS n, sum(s) AS s, sum(n * n) AS nn FROM paths WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1),
oo AS (SELECT count(*)::DOUBLE AS up, sum(s * s / n) AS above, sum(nn / n) AS nn FROM o),
pp AS (SELECT {moments} FROM paths WHERE source IS NOT NULL AND lang IS NOT NULL),
path_strength AS (SELECT {strength} AS v FROM (SELECT *, n - nn AS spread, greatest(0.0, q - own) / (n - k) AS within FROM pp, oo)),
j AS (SELECT s.*, hosts.n AS host_n, hosts.s * {u} AS host_s, paths.n AS path_n, paths.s * {u} AS path_s, host_strength.v AS hk, path_strength.v AS pk, m
  FROM s JOIN hosts ON s.source IS NOT DISTINCT FROM hosts.source JOIN paths ON s.source IS NOT DISTINCT FROM paths.source AND s.lang IS NOT DISTINCT FROM paths.lang, host_strength, path_strength, mean),
r AS (SELECT *, CASE WHEN source IS NULL THEN m ELSE {rate.format(k="hk", up="m", s="host_s", u=u, n="host_n")} END AS host_rate FROM j),
z AS (SELECT *, CASE WHEN source IS NULL OR lang IS NULL THEN host_rate ELSE {rate.format(k="pk", up="host_rate", s="path_s", u=u, n="path_n")} END AS path_rate FROM r),
e AS (SELECT *, least(greatest(path_rate, 1e-6), 1 - 1e-6) AS prior FROM z)
SELECT doc_id, held_out, round(evidence, 6) AS evidence, CASE WHEN source IS NULL THEN 0 ELSE host_n END::BIGINT AS host_rows, round(host_rate, 6) AS host_rate,
  CASE WHEN source IS NULL OR lang IS NULL THEN 0 ELSE path_n END::BIGINT AS path_rows, round(path_rate, 6) AS path_rate,
  round(1 / (1 + exp(-(evidence + ln(prior / (1 - prior))))), 6) AS score, round(1 / (1 + exp(-(evidence + ln(prior / (1 - prior))))), 6) >= {p.threshold} AS kept FROM e
"""


SQL = {
    "op1_hilbert_shards": _hilbert(),
    "op3_quality_bayes": _quality(),
    "op7_lsh_forest": OP7,
    "op8_exact_dedup": OP8,
    "op10_systematic_mix": OP10,
}
