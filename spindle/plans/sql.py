"""DuckDB SQL for the registered search queries, written from the definitions of the operators."""

from __future__ import annotations

from ..functions import text as T
from ..operators.config import KIND_WEIGHTS, ZONE_WEIGHTS

_q = lambda s: "'" + s.replace("'", "''") + "'"
TOKENS = "list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}\\p{{M}}][\\p{{L}}\\p{{N}}\\p{{M}}_.\\-\\/]*'), lambda t: regexp_replace(t, '[_.\\-/]+$', ''))"
VI = f"translate(lower(s), {_q(T.VI_FROM + T.MARKS)}, {_q(T.VI_TO)})"
LATIN = f"translate(replace(replace(lower(s), 'ß', 'ss'), 'œ', 'oe'), {_q(T.LATIN_FROM + T.MARKS)}, {_q(T.LATIN_TO)})"
CLASS = r"""CASE WHEN regexp_matches(s, '[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}]') THEN 'CJK'
  WHEN regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]|[^\x00-\x7F]') THEN CASE WHEN regexp_matches(s, '^[0-9]+[a-zA-Z]{1,3}$') THEN 'NUMERIC_UNIT' ELSE 'ALNUM_CODE' END
  WHEN regexp_matches(s, '[0-9]') THEN 'NUMERIC_UNIT' WHEN regexp_matches(s, '[^\x00-\x7F]') THEN 'WORD_DIACRITIC' WHEN regexp_matches(s, '[A-Za-z]') THEN 'WORD_LATIN' ELSE 'OTHER' END"""
STOP = f"((class = 'WORD_DIACRITIC' AND lower IN ({', '.join(map(_q, T.VIETNAMESE_STOPWORDS))})) OR (class = 'WORD_LATIN' AND lower IN ({', '.join(map(_q, T.ENGLISH_STOPWORDS))})))"


def tokens(name: str, source: str, text: str, keys: str) -> str:
    """CTE `name` with keys, pos, s, lower, class, vi, latin, stop, content of the texts of a source."""
    return f"""{name}0 AS (
      SELECT {keys}, unnest(range(len(l))) AS pos, unnest(l) AS s FROM (SELECT {keys}, {TOKENS.format(text=f"coalesce({text}, '')")} AS l FROM {source})
    ), {name} AS (
      SELECT *, bool_or(NOT stop) OVER (PARTITION BY {keys}) AS content FROM (
        SELECT *, {STOP} AS stop FROM (SELECT *, lower(s) AS lower, {CLASS} AS class, {VI} AS vi, {LATIN} AS latin FROM {name}0))
    )"""


def postings(name: str, toks: str, keys: str, mode: str) -> str:
    """CTE `name` with keys, pos, term, field, kind, ord of analyzed tokens."""
    prefix = f"UNION ALL SELECT {keys}, pos, substr(lower, 1, i) AS term, 'code', 'code_prefix', 4, stop, content FROM {toks}, unnest(range(2, greatest(length(lower), 2))) AS u(i) WHERE class IN ('ALNUM_CODE', 'NUMERIC_UNIT')" if mode == "index" else ""
    return f"""{name}v AS (
      SELECT {keys}, pos, lower AS term, 'text' AS field, 'lower' AS kind, 0 AS ord, stop, content FROM {toks}
      UNION ALL SELECT {keys}, pos, lower, 'code', 'code_exact', 1, stop, content FROM {toks} WHERE class IN ('ALNUM_CODE', 'NUMERIC_UNIT')
      UNION ALL SELECT {keys}, pos, unnest(regexp_extract_all(lower, '[0-9]{{2,}}')), 'code', 'code_digits', 2, stop, content FROM {toks} WHERE class IN ('ALNUM_CODE', 'NUMERIC_UNIT')
      UNION ALL SELECT {keys}, pos, unnest(regexp_extract_all(lower, '[a-z]{{2,}}')), 'code', 'code_letters', 3, stop, content FROM {toks} WHERE class IN ('ALNUM_CODE', 'NUMERIC_UNIT')
      {prefix}
      UNION ALL SELECT {keys}, pos, vi, 'text', 'fold', 5, stop, content FROM {toks} WHERE class = 'WORD_DIACRITIC' AND vi <> '' AND vi <> lower
      UNION ALL SELECT {keys}, pos, latin, 'text', 'fold', 6, stop, content FROM {toks} WHERE latin <> '' AND latin <> lower
    ), {name} AS (
      SELECT {keys}, pos, term, field, kind, ord FROM {name}v WHERE term <> '' AND NOT (field = 'text' AND stop AND content)
      QUALIFY row_number() OVER (PARTITION BY {keys}, pos, field, term ORDER BY ord) = 1
      UNION ALL
      SELECT {keys}, pos, vi || '_' || next_vi, 'phrase', 'bigram', 9 FROM (
        SELECT *, lead(vi) OVER w AS next_vi, lead(class) OVER w AS next_class FROM {toks} WINDOW w AS (PARTITION BY {keys} ORDER BY pos)
      ) WHERE class = 'WORD_DIACRITIC' AND next_class = 'WORD_DIACRITIC'
    )"""


def _case(column: str, table: dict[str, float], default: float) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {default}::DOUBLE END"


PARTS = "SELECT p_partkey AS doc_id, i AS field_idx, [struct_pack(z := 'title', t := p_name), struct_pack(z := 'sku', t := p_brand), struct_pack(z := 'attr', t := p_type)][i + 1].z AS src, [p_name, p_brand, p_type][i + 1] AS text FROM part, range(3) AS r(i)"
CORPUS = "SELECT doc_id, i AS field_idx, ['title', 'content'][i + 1] AS src, [string_split(text, chr(10))[1], text][i + 1] AS text FROM documents, range(2) AS r(i)"


def index(fields: str, ids: str) -> str:
    """CTEs idx (doc_id, zone, term, kw, tf), zl (doc_id, zone, len), nd (n), az (zone, avg_len, weight) of fields."""
    return f"""f AS (SELECT * FROM ({fields}) WHERE text IS NOT NULL AND text <> ''),
    {tokens("ft", "f", "text", "doc_id, field_idx, src")}, {postings("fp", "ft", "doc_id, field_idx, src", "index")},
    z AS (SELECT DISTINCT doc_id, CASE WHEN field = 'text' THEN src ELSE field END AS zone, term, field_idx, pos, {_case("kind", KIND_WEIGHTS, 0.5)} AS kw FROM fp),
    idx AS (SELECT doc_id, zone, term, max(kw) AS kw, count(DISTINCT (field_idx, pos))::INTEGER AS tf FROM z GROUP BY ALL),
    zl AS (SELECT doc_id, zone, count(DISTINCT (field_idx, pos))::INTEGER AS len FROM z GROUP BY ALL),
    nd AS (SELECT count(DISTINCT doc_id) AS n FROM ({ids})),
    az AS (SELECT zone, sum(len)::DOUBLE / max(n) AS avg_len, {_case("zone", ZONE_WEIGHTS, 1.0)} AS weight FROM zl, nd GROUP BY zone)"""


def values(queries: list[tuple[int, str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_q(q)})" for i, q in queries) + ") AS v(query_id, q)"


def queried(queries: list[tuple[int, str]]) -> str:
    """CTE qp (query_id, pos, term, ord) of queries."""
    return f"qs AS ({values(queries)}), {tokens('qt', 'qs', 'q', 'query_id')}, {postings('qq', 'qt', 'query_id', 'query')}, qp AS (SELECT query_id, pos, term, min(ord) AS ord FROM qq GROUP BY ALL)"


def scored(every_word: bool = True, terms: str = "qp") -> str:
    """CTE sc (query_id, doc_id, score, rank)."""
    need = "met >= needed AND" if every_word else ""
    return f"""dfs AS (SELECT term, count(DISTINCT doc_id) AS df FROM idx GROUP BY term),
    wt AS (
      SELECT query_id, doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, sum(weight * kw * tf / CASE WHEN avg_len > 0 THEN 1 - 0.75 + 0.75 * len / avg_len ELSE 1 END) AS wtf
      FROM (SELECT DISTINCT query_id, term FROM {terms}) JOIN idx USING (term) JOIN dfs USING (term) JOIN zl USING (doc_id, zone) JOIN az USING (zone), nd GROUP BY ALL
    ), met AS (SELECT query_id, doc_id, count(DISTINCT pos) AS met FROM wt JOIN {terms} USING (query_id, term) GROUP BY ALL),
    needed AS (SELECT query_id, count(DISTINCT pos) AS needed FROM {terms} GROUP BY ALL),
    sc AS (
      SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
        SELECT query_id, doc_id, sum(idf * wtf / (1.2 + wtf)) AS score FROM wt GROUP BY ALL
      ) JOIN met USING (query_id, doc_id) JOIN needed USING (query_id) WHERE {need} score > 0
    )"""


def cut(source: str, limit: int) -> str:
    return f"SELECT query_id, doc_id, round(score, 4) AS score, rank::INTEGER AS rank FROM {source} WHERE rank <= {limit}"


def recency(source: str, out: str, mode: str, as_of: int, days: int = 180) -> str:
    """CTE `out` with freshness worked into `source`; dates are CTE attrs (doc_id, title, ts)."""
    from ..operators.config import STRENGTHS

    dated = f"{out}0 AS (SELECT s.*, CASE WHEN ts > 0 THEN ts END AS ts, rank <= 500 AS inside, max(CASE WHEN rank <= 500 THEN score END) OVER (PARTITION BY query_id) AS best, bool_or(rank <= 500 AND coalesce(ts, 0) > 0) OVER (PARTITION BY query_id) AS usable FROM {source} s LEFT JOIN attrs USING (doc_id))"
    if mode == "date":
        order = "inside DESC, CASE WHEN inside AND usable THEN coalesce(ts, 0) END DESC NULLS LAST, CASE WHEN NOT (inside AND usable) THEN rank END, round(score, 9) DESC, doc_id"
        return f"{dated}, {out} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {out}0)"
    lift = f"best * {STRENGTHS[mode]} * exp(-ln(2) * greatest(0, {as_of} - ts) / ({days} * 86400))"
    return f"{dated}, {out}1 AS (SELECT * REPLACE (CASE WHEN inside AND ts IS NOT NULL THEN score + {lift} ELSE score END AS score) FROM {out}0), {out} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY inside DESC, CASE WHEN inside THEN round(score, 9) END DESC NULLS LAST, rank) AS rank FROM {out}1)"


def canon(name: str, toks: str, keys: str) -> str:
    """CTE `name` (keys, c: list of canonical terms)."""
    term = "CASE WHEN class = 'WORD_DIACRITIC' AND vi <> '' AND vi <> lower THEN vi WHEN latin <> '' AND latin <> lower THEN latin ELSE lower END"
    return f"{name} AS (SELECT {keys}, list({term} ORDER BY pos) AS c FROM {toks} WHERE NOT (stop AND content) GROUP BY ALL)"


def exact(source: str, out: str) -> str:
    """CTE `out` with exact titles worked into `source`; needs attrs, qt."""
    return f"""{tokens("tt", f"(SELECT doc_id, title FROM attrs WHERE doc_id IN (SELECT doc_id FROM {source} WHERE rank <= 500))", "title", "doc_id")},
    {canon("tc", "tt", "doc_id")}, {canon("qc", "qt", "query_id")},
    {out}0 AS (
      SELECT s.*, q.c AS q, t.c AS t, count(*) OVER w AS n_rows, bool_or(rank <= 500 AND coalesce(a.title, '') <> '') OVER w AS any_title, max(CASE WHEN rank <= 500 THEN score END) OVER w AS best
      FROM {source} s LEFT JOIN attrs a USING (doc_id) LEFT JOIN tc t USING (doc_id) LEFT JOIN qc q USING (query_id) WINDOW w AS (PARTITION BY query_id)
    ), {out}1 AS (
      SELECT *, CASE WHEN rank > 500 OR t IS NULL OR q IS NULL OR n_rows < 2 OR NOT any_title THEN 0
        WHEN len(list_filter(range(1, greatest(len(t) - len(q) + 2, 1)), lambda i: t[i:i + len(q) - 1] = q)) > 0 THEN 3
        WHEN len(list_filter(q, lambda x: NOT list_contains(t, x))) = 0 THEN 2 WHEN list_has_any(q, t) THEN 1 ELSE 0 END AS tier FROM {out}0
    ), {out} AS (
      SELECT query_id, doc_id, score + tier * CASE WHEN best > 0 THEN best + 1 ELSE 1 END AS score,
        row_number() OVER (PARTITION BY query_id ORDER BY rank <= 500 DESC, tier DESC, rank) AS rank FROM {out}1
    )"""


def typos(cap: int | None = None) -> str:
    """CTEs fix (query_id, pos, word, term, distance, applied), qx (expanded query terms), said (query_id, did_you_mean); needs qp, idx.

    DuckDB's distance allows edits within a transposed pair; it agrees with the engine's up to 1, and at 2 on these queries.
    `cap` limits the candidates of a first character.
    """
    capped = f" QUALIFY place <= {cap}" if cap else ""
    return """tdf AS (SELECT term, count(DISTINCT doc_id) AS df FROM idx GROUP BY term),
    unk AS (
      SELECT query_id, pos, arg_max(term, (length(term), -ord)) AS word FROM qp LEFT JOIN tdf USING (term) GROUP BY ALL HAVING max(coalesce(df, 0)) = 0
    ), voc AS (
      SELECT term, left(term, 1) AS first, row_number() OVER (PARTITION BY left(term, 1) ORDER BY df DESC, term) AS place FROM tdf WHERE df >= 2{capped}
    ), near AS (
      SELECT word, min((d, place, term)) AS best FROM (SELECT DISTINCT word, left(word, 1) AS first FROM unk WHERE length(word) >= 3) JOIN voc USING (first), LATERAL (SELECT damerau_levenshtein(word, term) AS d) WHERE d <= 2 GROUP BY word
    ), fix0 AS (
      SELECT query_id, pos, word, best[3] AS term, best[1] AS distance, CASE WHEN length(word) <= 4 THEN 1 ELSE 2 END AS auto FROM unk JOIN near USING (word)
    ), fix AS (
      SELECT query_id, pos, word, term, distance::INTEGER AS distance, NOT (regexp_matches(word, '[0-9]') OR (regexp_matches(word, '^[a-z]+$') AND NOT regexp_matches(word, '[aeiouy]')))
        AND abs(length(word) - length(term)) <= 1 AND distance <= auto AS applied FROM fix0 WHERE distance <= auto + 1
    ), qx AS (SELECT query_id, pos, term FROM qp UNION SELECT query_id, pos, term FROM fix WHERE applied),
    said AS (
      SELECT query_id, CASE WHEN new <> lower(q) THEN new END AS did_you_mean FROM (
        SELECT query_id, q, CASE WHEN p IS NULL THEN lower(q) ELSE list_reduce(list_transform(p, lambda x: x.word || chr(1) || x.term), lambda s, x: replace(s, split_part(x, chr(1), 1), split_part(x, chr(1), 2)), lower(q)) END AS new
        FROM qs LEFT JOIN (SELECT query_id, list(struct_pack(word := word, term := term) ORDER BY pos) AS p FROM fix GROUP BY ALL) USING (query_id))
    )""".replace("{capped}", capped)
