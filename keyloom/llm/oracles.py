"""SQL for the operators that SQL can express."""

from __future__ import annotations

from keyloom.llm import quality, sharding, substring, warc

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_sql(rules: quality.Rules = quality.Rules()) -> str:
    grid = [(name, c) for name, cutoffs in rules.GRID.items() for c in cutoffs]
    alpha = rules.alpha / len(rules.GRID)
    w = quality.WINDOW
    tests = " UNION ALL ".join(f"SELECT '{n}' AS rule, {c}::DOUBLE AS cut" for n, c in grid)
    rate = " ".join(f"WHEN '{n}' THEN {n}" for n in rules.GRID)
    rejected = " OR ".join(f"coalesce({n} > {n}_cut, false)" for n in rules.GRID)
    cuts = ", ".join(f"min(cut) FILTER (rule = '{n}' AND p <= {rules.delta}::DOUBLE / m) AS {n}_cut" for n in rules.GRID)
    symbols = "".join("\\" + c for c in quality.SYMBOLS)
    return rf"""
WITH d AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {w - 1}), ' ') AS g FROM d, unnest(range(1, greatest(1, len(w) - {w - 2}))) t(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range({w}) r(k) GROUP BY 1),
ln AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
b AS (SELECT d.doc_id, coalesce('=' || stratum, '') AS stratum, len(w) AS n_words, list_sum(list_transform(list_prepend('', w), lambda x: length(x)))::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[{symbols}]', '', 'g')) AS n_symbols, length(text) - length(replace(text, '!', '')) AS n_shout,
    coalesce(ln.dup, 0) AS n_dup_lines, coalesce(ln.n, 0) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbol_rate,
    CASE WHEN word_chars > 0 THEN n_shout::DOUBLE / word_chars ELSE 0 END AS shout_rate, CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_rate,
    CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_rate FROM b),
good AS (SELECT m.* FROM m JOIN (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
own AS (SELECT stratum FROM good GROUP BY 1 HAVING count(*) >= {rules.min_labels}),
s AS (SELECT stratum AS st, g.* FROM good g JOIN own USING (stratum)),
t AS (SELECT st, rule, cut, count(*) AS n, count(*) FILTER (CASE rule {rate} END > cut) AS k FROM s, ({tests}) GROUP BY 1, 2, 3),
q AS (SELECT *, (SELECT count(DISTINCT st) FROM t) * {len(grid)} AS m, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}::DOUBLE) + (n - j) * ln(1 - {alpha}::DOUBLE)))
    FROM range(k + 1) r(j)) AS p FROM t),
c AS (SELECT st, {cuts} FROM q GROUP BY 1)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejected}) AS kept
FROM m LEFT JOIN c ON c.st = m.stratum
"""


def sharding_sql(shards: int = 16, seed: str = "mix-1") -> str:
    return rf"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT doc_id, source, coalesce(text, '') AS text, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
e AS (SELECT doc_id, source, h, len(b) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS crc FROM d, t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, crc, size) AS k, count(*) OVER (PARTITION BY source) AS n FROM e),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * k - 1)::DOUBLE / (2 * n), source, h, doc_id, crc, size) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (pos * {shards} // total)::INTEGER AS shard,
    (pos - ((pos * {shards} // total) * total + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
"""


def warc_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS digest, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= {warc.REVISIT_BYTES} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= {warc.REVISIT_BYTES} AND page_id <> last THEN last END AS refers_to FROM q
"""


def substring_sql() -> str:
    k = substring.WINDOW
    return rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS g FROM d, unnest(range(1, greatest(1, len(w) - {k - 2}))) t(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT i + j) AS pos FROM rep, range({k}) r(j) GROUP BY 1),
x AS (SELECT doc_id, w, coalesce(pos, []) AS pos FROM d LEFT JOIN gone USING (doc_id)),
y AS (SELECT doc_id, len(w) AS n, len(pos) AS r, CASE WHEN len(pos) = 0 THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(pos, i)) END AS kept FROM x)
SELECT doc_id, n AS n_words, r AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM y
"""
