"""DuckDB SQL that gives what the queries give, written from their definitions."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def sharding(shards: int = 40, rounds: int = 6, seed: str = "deal") -> str:
    digest = lambda i, x: f"('0x' || substr(md5('{seed}:{i}:' || ({x})::VARCHAR), 1, 15))::BIGINT"
    turned = "(SELECT rn, n, a, b, x % a AS l, x // a AS r FROM walk WHERE NOT done)"
    for i in range(rounds):
        turned = f"(SELECT rn, n, a, b, l, (r + {digest(i, 'l')}) % b AS r FROM {turned})" if i % 2 else f"(SELECT rn, n, a, b, (l + {digest(i, 'r')}) % a AS l, r FROM {turned})"
    return f"""
    WITH RECURSIVE bits AS (
      SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) AS r(i)
    ), docs AS (
      SELECT doc_id, coalesce(text, '') AS text FROM documents
    ), sized AS (
      SELECT doc_id, strlen(text)::BIGINT + 16 AS size,
        xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, v: xor(c >> 8, tab[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) AS text_crc32,
        md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(text)) AS digest
      FROM docs, bits
    ), numbered AS (
      SELECT *, row_number() OVER (ORDER BY digest) - 1 AS rn, count(*) OVER () AS n FROM sized
    ), domain AS (
      SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM docs)
    ), walk AS (
      SELECT rn::BIGINT AS rn, d.n, a, b, rn::BIGINT AS x, false AS done FROM numbered, domain d
      UNION ALL
      SELECT rn, n, a, b, r * a + l, r * a + l < n FROM {turned}
    )
    SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (x % {shards})::INTEGER AS shard, (x // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
    FROM numbered JOIN walk USING (rn) WHERE done"""


def decontamination(n: int = 10) -> str:
    return f"""
    WITH items AS (
      SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS} AS w FROM benchmark
    ), grams AS (
      SELECT DISTINCT item, w[i:i + {n - 1}] AS gram FROM items, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS u(i) WHERE len(w) > 0
    ), lengths AS (SELECT DISTINCT len(gram) AS m FROM grams),
    docs AS (
      SELECT row_number() OVER () AS row, doc_id, {WORDS} AS w FROM documents
    ), hits AS (
      SELECT row, i, m, item FROM (
        SELECT row, i, m, w[i:i + m - 1] AS gram FROM docs, lengths, unnest(range(1, greatest(len(w) - m + 2, 1))) AS u(i)
      ) JOIN grams USING (gram)
    ), places AS (
      SELECT row, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + m)) AS u(p) GROUP BY row
    ), named AS (
      SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN places USING (row) LEFT JOIN named USING (row)"""


def licenses() -> str:
    from .license_rules import BASE, rules

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    listed = [(r.priority, r.weight, r.label, False, r.regex) for r in rules()]
    listed += [(len(listed) + i, 0.8, label, True, "".join(f" {w} " for w in phrase.split())) for i, (phrase, label) in enumerate(BASE)]
    rows = ", ".join(f"({p}, {w}::DOUBLE, {quoted(label)}, {str(b).lower()}, {quoted(x)})" for p, w, label, b, x in listed)
    count = lambda s: f"((length({s}) - length(replace({s}, ' ', ''))) // 2)"
    return f"""
    WITH rules(priority, weight, label, base, regex) AS (VALUES {rows}),
    docs AS (SELECT row_number() OVER () AS row, doc_id, {WORDS} AS w FROM documents),
    padded AS (SELECT row, array_to_string(list_transform(w, lambda x: ' ' || x || ' '), '') AS s FROM docs),
    hits AS (
      SELECT row, priority, weight, label, base, regexp_extract_all(s, regex) AS m, string_split_regex(s, regex) AS between FROM padded, rules WHERE regexp_matches(s, regex)
    ), places AS (
      SELECT row, priority, weight, label, base, list_sum(list_transform(between[1:i], lambda x: {count('x')})) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: {count('x')})), 0) AS start, {count('m[i]')} AS size
      FROM hits, unnest(range(1, len(m) + 1)) AS u(i)
    ), found AS (SELECT *, start + size AS stop FROM places),
    kept AS (
      SELECT * FROM found d WHERE base OR NOT EXISTS (
        SELECT 1 FROM found e WHERE e.row = d.row AND NOT e.base AND e.priority < d.priority AND ((d.start >= e.start AND d.stop <= e.stop) OR (e.start >= d.start AND e.stop <= d.stop)))
    ), named AS (
      SELECT row, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score FROM kept GROUP BY row
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM docs LEFT JOIN named USING (row)"""


def warc() -> str:
    """Records of pages, from the definitions: patterns of its own, and the standard table of named entities."""
    from html.entities import html5

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    crlf = "chr(13) || chr(10)"
    named = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    table = f"MAP([{', '.join(map(quoted, named))}], [{', '.join(map(quoted, named.values()))}])"
    entity = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"

    def decoded(x: str) -> str:
        one = "CASE WHEN e[2] <> '#' THEN coalesce(entities[e[2:-2]], e) WHEN lower(e[3]) = 'x' THEN chr(('0x' || e[4:-2])::INTEGER) ELSE chr(e[3:-2]::INTEGER) END"
        between = f"string_split_regex({x}, '{entity}')"
        every = f"list_transform(regexp_extract_all({x}, '{entity}'), lambda e: {one})"
        return f"replace(list_reduce(list_transform(list_zip({between}, list_append({every}, '')), lambda z: z[1] || coalesce(z[2], '')), lambda a, b: a || b), chr(160), ' ')"

    def swap(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {quoted(pattern)}, {to}, 'g')"

    dropped = "(?is)" + "|".join(["<!--.*?(?:-->|\\z)", *(f"<{e}\\b.*?(?:</{e}\\s*>|\\z)" for e in ("script", "style", "title"))])
    breaks = "(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|blockquote|pre|body|head|html)\\b[^>]*(?:>|\\z)"
    blank = "[ \\t\\r\\n]+"
    bare = swap(swap(swap(swap("body", dropped, "' '"), blank, "' '"), breaks, "chr(10)"), "<[/!?a-zA-Z][^>]*(?:>|\\z)", "''")
    text = swap(swap(swap(decoded("bare"), "[ \\t]+", "' '"), " ?\\n[ \\n]*", "chr(10)"), "^[ \\n]+|[ \\n]+$", "''")
    title = f"trim({swap(decoded('raw_title'), blank, quoted(' '))}, ' ')"
    href = quoted("""(?i)<a\\b[^<>]*?\\bhref\\s*=\\s*["']([^"'<>]*)["']""")
    links = f"coalesce(array_to_string(list_transform(regexp_extract_all(body, {href}, 1), lambda x: 'outlink: ' || x || ' A/@href' || {crlf}), ''), '')"
    urn = lambda h: f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-3' || substr({h}, 14, 3) || '-' || substr('89ab', ('0x' || substr({h}, 17, 1))::INTEGER % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"
    return f"""
    WITH p AS (
      SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS body, {table} AS entities, regexp_extract(coalesce(html, ''), '(?is)<title\\b[^>]*(?:>|\\z)(.*?)(?:</title\\s*>|\\z)', 1) AS raw_title FROM pages
    ), r AS (
      SELECT *, {bare} AS bare, md5('response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || target_uri || chr(10) || md5(body)) AS h, 'sha256:' || sha256(body) AS source_digest,
        'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(body) AS source_headers, 'text/html; charset=utf-8' AS source_type FROM p
    ), n AS (SELECT *, {urn('h')} AS refers_to, {links} AS raw_links FROM r),
    m AS (SELECT *, md5('metadata' || chr(10) || refers_to) AS hm, md5('conversion' || chr(10) || refers_to) AS hc FROM n),
    rows AS (
      SELECT *, 'metadata' AS record_type, {urn('hm')} AS record_id, {urn('hc')} AS concurrent_to, 'application/warc-fields' AS content_type,
        'title: ' || {title} || {crlf} || 'source-content-type: ' || source_type || {crlf} || 'source-payload-digest: ' || source_digest || {crlf}
          || 'source-header: ' || replace(source_headers, {crlf}, {crlf} || 'source-header: ') || {crlf} || {decoded('raw_links')} AS block FROM m
      UNION ALL
      SELECT *, 'conversion', {urn('hc')}, {urn('hm')}, 'text/plain; charset=utf-8', {text} FROM m
    )
    SELECT page_id, record_type, record_id, refers_to, concurrent_to, target_uri, '2024-01-01T00:00:00Z' AS warc_date, content_type, strlen(block)::BIGINT AS content_length,
      'sha256:' || sha256(block) AS block_digest, source_type, source_headers, source_digest, block FROM rows"""
