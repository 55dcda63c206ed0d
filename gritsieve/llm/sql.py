"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP2 = r"""
WITH lines AS (
    SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n
    FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), keyed AS (
    SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), frequent AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), judged AS (
    SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""

OP4 = r"""
WITH folded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), docs AS (
    SELECT row_number() OVER () AS r, doc_id, words FROM folded
), items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, k, array_to_string(list_slice(words, s, s + k - 1), ' ') AS w
    FROM (SELECT item_id, words, least(13, len(words)) AS k, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS s
          FROM items WHERE len(words) > 0)
), lengths AS (
    SELECT DISTINCT k FROM windows
), places AS (
    SELECT r, k, s, array_to_string(list_slice(words, s, s + k - 1), ' ') AS w
    FROM (SELECT r, k, words, unnest(range(1, len(words) - k + 2)) AS s FROM docs, lengths WHERE len(words) >= k)
), found AS (
    SELECT p.r, p.k, p.s, i.item_id FROM places p JOIN windows i ON p.k = i.k AND p.w = i.w
), hits AS (
    SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS word FROM found) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY r
)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.names, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.words) AS contaminated
FROM docs d LEFT JOIN hits h ON d.r = h.r LEFT JOIN named n ON d.r = n.r
"""

#: Texts as hexadecimal digits, two for a byte, cut to blocks so that the 100-byte strings of a long text are
#: cut from short pieces.
OP5 = r"""
WITH docs AS (
    SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
    SELECT r, b, substr(h, 512 * b + 1, 512 + 198) AS part
    FROM (SELECT r, h, unnest(range(0, length(h) // 512 + 1)) AS b FROM docs)
), places AS (
    SELECT r, 256 * b + j AS s, md5_number(substr(part, 2 * j + 1, 200)) AS k
    FROM (SELECT r, b, part, unnest(range(0, 256)) AS j FROM blocks) WHERE length(part) >= 2 * j + 200
), firsts AS (
    SELECT k, min((r, s)) AS place FROM places GROUP BY k HAVING count(*) > 1
), repeats AS (
    SELECT p.r, p.s FROM places p JOIN firsts f ON p.k = f.k WHERE (p.r, p.s) > f.place
), edges AS (
    SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + 100, true) AS opens FROM repeats
), runs AS (
    SELECT r, min(s) AS a, max(s) + 100 AS z
    FROM (SELECT r, s, count(*) FILTER (opens) OVER (PARTITION BY r ORDER BY s) AS run FROM edges) GROUP BY r, run
), gaps AS (
    SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS z, z - a AS gone FROM runs
    UNION ALL
    SELECT d.r, coalesce(max(u.z), 0), any_value(length(d.h)) // 2, 0 FROM docs d LEFT JOIN runs u ON d.r = u.r GROUP BY d.r
)
SELECT any_value(d.doc_id) AS doc_id, any_value(length(d.h)) // 2 AS n_bytes, CAST(sum(g.gone) AS BIGINT) AS n_removed,
       count(*) FILTER (g.gone > 0) AS n_spans,
       sha256(unhex(string_agg(substr(d.h, 2 * g.a + 1, 2 * (g.z - g.a)), '' ORDER BY g.a, g.z))) AS kept_sha256
FROM docs d JOIN gaps g ON d.r = g.r GROUP BY d.r
"""

OP6 = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), per AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)) AS w
    FROM sized GROUP BY source
), ordered AS (
    SELECT *, 2 * source_size AS cap, sum(source_size) OVER () * 150 / 100.0::DOUBLE AS total,
           coalesce(sum(2 * source_size) OVER before, 0) AS cap_before,
           sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left
    FROM per WINDOW before AS (ORDER BY 2 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
    SELECT *, coalesce(max(CASE WHEN NOT (cap / w::DOUBLE <= (total - cap_before::DOUBLE) / w_left::DOUBLE) THEN 1 END)
                       OVER (ORDER BY cap / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS open
    FROM ordered
), targets AS (
    SELECT source, source_size,
           CASE WHEN NOT open THEN cap::DOUBLE
                ELSE w::DOUBLE * (total - coalesce(sum(cap) FILTER (NOT open) OVER (), 0)::DOUBLE) / (sum(w) FILTER (open) OVER ())::DOUBLE END AS target
    FROM marked
), rated AS (
    SELECT *, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS fraction
    FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM targets)
), tried AS (
    SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.whole, i.trial,
           ('0x' || substr(md5('mix-1:' || i.trial || ':' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < t.fraction AS drawn
    FROM sized s JOIN rated t ON s.source IS NOT DISTINCT FROM t.source CROSS JOIN (SELECT unnest(range(0, 32)) AS trial) i
), offs AS (
    SELECT source, trial, abs(coalesce(sum(size) FILTER (drawn), 0)::DOUBLE - (any_value(target) - (any_value(whole) * any_value(source_size))::DOUBLE)) AS off
    FROM tried GROUP BY source, trial
), chosen AS (
    SELECT source, first(trial ORDER BY off, trial) AS trial FROM offs GROUP BY source
)
SELECT t.doc_id, CAST(t.size AS BIGINT) AS size, t.source_size, t.target,
       CAST(t.size * (t.whole + CASE WHEN t.drawn THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM tried t JOIN chosen c ON t.source IS NOT DISTINCT FROM c.source AND t.trial = c.trial
"""

#: One pass for each kind: matches are marked with a private-use character that the text is freed of, and
#: the parts between the marks are measured.
_KINDS = (
    (0, "assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    (1, "access", r"AKIA[A-Z0-9]+", 0, 20),
    (2, "hex", r"[0-9a-f]+", 0, 24),
    (3, "private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    (4, "github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    (5, "jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    (6, "slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    (7, "google", r"AIza[0-9A-Za-z_-]{35}", 0, 0),
)

OP7 = (
    "WITH docs AS (SELECT row_number() OVER () AS r, doc_id, replace(coalesce(text, ''), chr(57344), chr(57345)) AS t FROM documents)"
    + "".join(
        f"""
, cut{k} AS (
    SELECT r, unnest(p) AS part, unnest(range(1, len(p) + 1)) AS i
    FROM (SELECT r, string_split(regexp_replace(t, '{pattern}', chr(57344) || '\\0' || chr(57344), 'g'), chr(57344)) AS p FROM docs)
), span{k} AS (
    SELECT * FROM (SELECT r, {k} AS ord, '{kind}' AS kind, part, i,
                          sum(length(part)) OVER (PARTITION BY r ORDER BY i) - length(part) AS a, sum(length(part)) OVER (PARTITION BY r ORDER BY i) AS b
                   FROM cut{k})
    WHERE i % 2 = 0 AND length(regexp_extract(part, '{pattern}', {group})) >= {least}
)"""
        for k, kind, pattern, group, least in _KINDS
    )
    + ", spans AS ("
    + " UNION ALL ".join(f"SELECT r, ord, kind, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM span{k}" for k, *_ in _KINDS)
    + """), told AS (
    SELECT r, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
           string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) FILTER (ord < 3) AS base,
           string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) AS spans
    FROM spans GROUP BY r
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN told t ON d.r = t.r
"""
)

#: CRC-32 of each distinct word by its table of 256 entries, which the polynomial gives.
OP11 = r"""
WITH RECURSIVE entries AS (
    SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS bit FROM range(256) t(i)
    UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, bit + 1 FROM entries WHERE bit < 8
), crc_table AS (
    SELECT list(c ORDER BY i) AS crc FROM entries WHERE bit = 8
), texts AS (
    SELECT row_number() OVER () AS r, doc_id, false AS wanted, text FROM documents
    UNION ALL
    SELECT row_number() OVER (), NULL, true, text FROM benchmark
), words AS (
    SELECT r, doc_id, wanted, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM texts
), features AS (
    SELECT r, wanted, f, count(*) AS n FROM (SELECT r, wanted, unnest(w) AS f FROM words) GROUP BY ALL
), lettered AS (
    SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)
), hashed AS (
    SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))),
                              lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
    FROM lettered, crc_table
), counts AS (
    SELECT bucket, CAST(sum(n) FILTER (NOT wanted) AS DOUBLE) AS s, CAST(sum(n) FILTER (wanted) AS DOUBLE) AS t FROM features JOIN hashed USING (f) GROUP BY bucket
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (coalesce(sum(s) OVER (), 0) + 10000) / ((coalesce(s, 0) + 1) * (coalesce(sum(t) OVER (), 0) + 10000)))) AS BIGINT) AS gain
    FROM counts
), weights AS (
    SELECT r, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE NOT wanted GROUP BY r
), scored AS (
    SELECT w.r, w.doc_id, CAST(len(w.w) AS BIGINT) AS n_features, coalesce(x.weight, 0) AS weight,
           coalesce(x.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(w.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
    FROM words w LEFT JOIN weights x ON w.r = x.r WHERE NOT w.wanted
), ranked AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN k.place <= 10 * k.n // 100 THEN k.place END AS rank
FROM scored s LEFT JOIN ranked k ON s.r = k.r
"""

OP12 = r"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT r, md5_number(array_to_string(list_slice(words, s, s + k - 1), ' ')) AS h
    FROM (SELECT r, words, least(5, len(words)) AS k, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS s FROM docs WHERE len(words) > 0)
), sizes AS (
    SELECT r, count(*) AS n FROM shingles GROUP BY r
), shared AS (
    SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.h = b.h AND a.r <> b.r GROUP BY a.r, b.r
), links AS (
    SELECT a, b FROM shared s JOIN sizes x ON s.a = x.r JOIN sizes y ON s.b = y.r WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)
), reach AS (
    SELECT r AS a, r AS b FROM docs
    UNION
    SELECT p.a, l.b FROM reach p JOIN links l ON p.b = l.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM docs d LEFT JOIN sizes s ON d.r = s.r JOIN (SELECT p.a, min(o.doc_id) AS component_id FROM reach p JOIN docs o ON p.b = o.r GROUP BY p.a) c ON d.r = c.a
"""

OP13 = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (
    SELECT t, min(doc_id) AS first FROM texts GROUP BY t
), marks AS (
    SELECT doc_id, max(CAST(coalesce(quality, 0) = 1 AS INT)) AS good, max(CAST(coalesce(toxic, 0) = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), judged AS (
    SELECT x.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
           CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
           + 4 * CAST(100 * length(regexp_replace(x.t, '[^A-Z]', '', 'g')) > 10 * length(x.t) AS INT) + 8 * CAST(regexp_matches(x.t, '[#$%&*|]') AS INT)
           + 16 * CAST(f.first IS NOT NULL AND (x.doc_id IS NULL OR x.doc_id > f.first) AS INT) AS mask
    FROM texts x JOIN firsts f ON x.t = f.t LEFT JOIN marks m ON x.doc_id = m.doc_id
), counts AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
    SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS f,
           CAST(list_sum(list_transform(string_split(substr(filter_order, 1, step - 1), ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END)) AS INT) AS ahead,
           1 << (ascii(substr(filter_order, step, 1)) - 65) AS own
    FROM orders, (SELECT unnest(range(1, 6)) AS step)
), told AS (
    SELECT part, filter_order, step, f, sum(CASE WHEN mask & (coalesce(ahead, 0) | own) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN mask & own > 0 AND mask & coalesce(ahead, 0) = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN mask & own > 0 AND mask & coalesce(ahead, 0) > 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN mask & own > 0 AND mask & coalesce(ahead, 0) = 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN mask & own > 0 AND mask & coalesce(ahead, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counts, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM told
"""

SQL: dict[str, str] = {
    "op7_secret_scans": OP7, "op2_line_dedup": OP2, "op4_decontamination": OP4, "op5_suffix_dedup": OP5, "op6_mixing": OP6,
    "op11_importance": OP11, "op12_jaccard": OP12, "op13_filter_audit": OP13,
}
