"""DuckDB SQL with the rows of the corpus queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEARDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w
), n AS (
  SELECT d.doc_id, count(g)::BIGINT AS n FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN s USING (doc_id) GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen
), k AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN n USING (doc_id) JOIN k ON node = doc_id
"""

DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS size, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g FROM b WHERE len(ws) > 0
), sizes AS (
  SELECT DISTINCT size FROM bw
), dw AS (
  SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS pos, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS g
  FROM d, sizes WHERE len(ws) >= size
), h AS (
  SELECT doc_id, pos, dw.size, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.size = bw.size
), x AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM h) GROUP BY 1
), i AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY 1
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN i USING (doc_id)
"""

_RULES = [("example.org", "/en/1", "block"), ("example.org", "/es/", "block"), ("com", "/de/", "block"), ("com", "/fr/", "allow"), ("org", "/", "allow")]  # longest first
_LOWER_HOST = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule(host: str, path: str, field: int) -> str:
    cases = " ".join(f"WHEN ({host} = '{h}' OR {host} LIKE '%.{h}') AND starts_with({path}, '{p}') THEN '{(h + p, v)[field]}'" for h, p, v in _RULES)
    return f"CASE {cases} END"


_HOST = _LOWER_HOST.format(r"regexp_extract({}, '^(?s:.*?)://([^/?#]*)', 1)")
_PATH = r"regexp_extract({}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
_NODE = _LOWER_HOST.format(r"regexp_extract({0}, '^(?s:.*?)://[^/?#]*')") + r" || regexp_extract({0}, '^(?s:.*?)://[^/?#]*([^#]*)', 1)"

#: Canonical links with absolute targets make aliases.
URLS = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, coalesce({_HOST.format("url")}, '') AS host, coalesce({_PATH.format("url")}, '') AS path, {_NODE.format("url")} AS node,
    regexp_extract(html, '<link rel="canonical" href="([^"]+)"', 1) AS link FROM pages
), e AS (
  SELECT node AS a, {_NODE.format("link")} AS b FROM p WHERE link <> '' UNION SELECT {_NODE.format("link")}, node FROM p WHERE link <> ''
), r AS (
  SELECT a AS n, a AS seen FROM e UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.seen
), s AS (
  SELECT n, max(CASE {_rule(_HOST.format("seen"), _PATH.format("seen"), 1)} WHEN 'allow' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS spread FROM r GROUP BY 1
)
SELECT page_id, host, path, {_rule("host", "path", 0)} AS rule,
  coalesce({_rule("host", "path", 1)}, CASE spread WHEN 2 THEN 'allow' WHEN 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN s ON s.n = p.node
"""

REPEATS = """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT k, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)
), f AS (
  SELECT s, min(doc_id) AS least FROM w GROUP BY 1
), x AS (
  SELECT k, i, i > coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), -99) + 50 AS new FROM w JOIN f USING (s) WHERE least < doc_id
), g AS (
  SELECT k, i, sum(new::INT) OVER (PARTITION BY k ORDER BY i) AS n FROM x
), spans AS (
  SELECT k, n, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY 1, 2
), ends AS (
  SELECT k, a, b FROM spans UNION ALL SELECT k, len(h) // 2, len(h) // 2 FROM d
), gaps AS (
  SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a, b), 0) AS after FROM ends
)
SELECT doc_id, any_value(len(h) // 2)::BIGINT AS n_bytes, sum(b - a)::BIGINT AS n_removed, (count(*) - 1)::BIGINT AS n_spans,
  sha256(unhex(string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a, b))) AS kept_sha256
FROM gaps JOIN d USING (k) GROUP BY k, doc_id
"""


def _licenses() -> str:
    from .licenses import TEMPLATES, THRESHOLD

    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)
    grams = "list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])"
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS k, name, regexp_split_to_array(trim(regexp_replace(lower(text), '[^\pL\pN]+', ' ', 'g')), ' ') AS ws FROM (VALUES {values}) v(name, text)
), tg AS (
  SELECT k, g, count(*) AS c FROM (SELECT k, unnest({grams}) AS g FROM t) GROUP BY ALL
), s AS (
  SELECT row_number() OVER () AS s, doc_id, regexp_split_to_array(trim(regexp_replace(lower(seg), '[^\pL\pN]+', ' ', 'g')), ' ') AS ws FROM (
    SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '(?:\n[^\pL\pN\n]*)+\n'), [text])) AS seg FROM documents)
), sg AS (
  SELECT s, g, count(*) AS c FROM (SELECT s, unnest({grams}) AS g FROM s WHERE len(ws) BETWEEN 2 AND 400) GROUP BY ALL
), d AS (
  SELECT doc_id, name, max(2.0 * shared / (len(s.ws) - 1 + len(t.ws) - 1)) AS dice FROM (
    SELECT s, k, sum(least(sg.c, tg.c)) AS shared FROM sg JOIN tg USING (g) GROUP BY ALL) m JOIN s USING (s) JOIN t USING (k) GROUP BY ALL
), b AS (
  SELECT doc_id, name, dice::DOUBLE AS dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM d WHERE dice >= {THRESHOLD}
)
SELECT doc_id, name AS license, coalesce(dice, 0.0)::DOUBLE AS dice, coalesce(n, 0)::BIGINT AS n_licenses FROM documents LEFT JOIN b USING (doc_id) WHERE coalesce(r, 1) = 1
"""


#: CRC-32 byte by byte over distinct features.
RESAMPLING = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), df AS MATERIALIZED (
  SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM d) GROUP BY ALL
), bf AS MATERIALIZED (
  SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM b) GROUP BY ALL
), step AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), tab AS MATERIALIZED (
  SELECT i, c FROM step WHERE k = 8
), x AS (
  SELECT f, hex(encode(f)) AS h, 0::BIGINT AS i, 4294967295::BIGINT AS c FROM (SELECT f FROM df UNION SELECT f FROM bf)
  UNION ALL
  SELECT f, h, x.i + 2, xor(tab.c, x.c >> 8) FROM x JOIN tab ON tab.i = xor(x.c & 255, 16 * (strpos('0123456789ABCDEF', h[x.i + 1]) - 1) + strpos('0123456789ABCDEF', h[x.i + 2]) - 1) WHERE x.i < len(h)
), k AS MATERIALIZED (
  SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM x WHERE i = len(h)
), s AS (
  SELECT bucket, sum(n) AS s FROM df JOIN k USING (f) GROUP BY 1
), t AS (
  SELECT bucket, sum(n) AS t FROM bf JOIN k USING (f) GROUP BY 1
), g AS MATERIALIZED (
  SELECT r.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS gain
  FROM range(10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), w AS (
  SELECT doc_id, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY 1
), z AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (doc_id)
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)
"""


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of k-means, one after the other."""
    apart = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, part, min({{'d': d, 'entry': entry}}) AS near FROM (SELECT r, part, entry, {apart}::BIGINT AS d FROM p JOIN c{k} USING (part)) GROUP BY 1, 2)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT part, entry, list(mean ORDER BY i) AS mean FROM (SELECT part, near.entry AS entry, i, floor(sum(v[i]) / count(*))::BIGINT AS mean FROM a{k} JOIN p USING (r, part), (SELECT unnest(range(1, {{size}} + 1)) AS i) GROUP BY ALL) GROUP BY 1, 2)".replace("{size}", "(SELECT max(len(v)) FROM p)"))
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(mean, c) AS c FROM c{k} LEFT JOIN m{k} USING (part, entry))")
    return rf"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), p AS MATERIALIZED (
  SELECT r, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS v FROM e, range({parts}) t(part)
), c0 AS MATERIALIZED (
  SELECT part, r - 1 AS entry, v AS c FROM p WHERE r <= {entries}
), {", ".join(steps)}, h AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}
), o AS (
  SELECT r, string_agg(lower(lpad(hex(near.entry), 2, '0')), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM a{rounds} GROUP BY 1
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN o USING (r), h
"""


SQL = {"op11_resampling": RESAMPLING, "op12_codes": _codes(), "op7_repeats": REPEATS, "op10_licenses": _licenses(), "op6_urls": URLS, "op1_neardup": NEARDUP, "op8_decontamination": DECONTAMINATION}
