"""DuckDB SQL for the queries whose results SQL can express: each computes its contract in the plainest way, without the operator's method.

Media files, learned merges and the hidden Markov model can't be expressed; those queries are tested against brute force alone.
"""

from __future__ import annotations

from panelith.llm import quality, substrings, suffixes

WORD = r"[^ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS = "own AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents)"


def near_duplicates(size: int = 5, percent: int = 75) -> str:
    """All pairs that share a shingle, counted in full; classes by reachability."""
    return f"""
    WITH RECURSIVE {ROWS},
    taken AS MATERIALIZED (SELECT r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM own),
    places AS (SELECT r, words, unnest(range(1, greatest(len(words) - {size - 2}, 2))) AS i FROM taken WHERE len(words) > 0),
    shingles AS MATERIALIZED (SELECT DISTINCT r, array_to_string(words[i:i + {size - 1}], ' ') AS s FROM places),
    sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM shingles GROUP BY r),
    common AS (SELECT x.r AS a, y.r AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.r <> y.r GROUP BY ALL),
    links AS MATERIALIZED (
        SELECT a, b FROM common JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b
        WHERE 100 * common.n >= {percent} * (p.n + q.n - common.n)
    ),
    reach AS (SELECT r, r AS other FROM own UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other),
    least AS (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN own o ON o.r = reach.other GROUP BY reach.r)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
    FROM own JOIN least USING (r) LEFT JOIN sizes USING (r)
    """


def repeated_passages(width: int = substrings.WIDTH) -> str:
    """Whole windows compared as strings; a word goes if a repeated window starts at most ``width - 1`` words before it."""
    return f"""
    WITH {ROWS},
    taken AS MATERIALIZED (SELECT r, regexp_extract_all(text, '{WORD}') AS words FROM own),
    windows AS (SELECT r, words, unnest(range(1, len(words) - {width - 2})) AS i FROM taken),
    starts AS (SELECT r, i, count(*) OVER (PARTITION BY md5(array_to_string(words[i:i + {width - 1}], ' '))) > 1 AS again FROM windows),
    single AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM taken),
    last AS (SELECT r, i, word, max(CASE WHEN again THEN i END) OVER (PARTITION BY r ORDER BY i) AS start FROM single LEFT JOIN starts USING (r, i)),
    judged AS (SELECT r, i, word, coalesce(start > i - {width}, false) AS gone FROM last),
    sums AS (
        SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept
        FROM judged GROUP BY r
    )
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM own LEFT JOIN sums USING (r)
    """


def repeated_strings(length: int = suffixes.LENGTH, piece: int = 2048) -> str:
    """Whole windows of bytes compared by digest; texts are cut into overlapping pieces only so that a window isn't sought from its text's start."""
    return f"""
    WITH {ROWS},
    coded AS MATERIALIZED (SELECT r, hex(text) AS h, strlen(text) AS n FROM own),
    pieces AS (SELECT r, n, unnest(range(0, n, {piece})) AS p, h FROM coded WHERE n >= {length}),
    cut AS MATERIALIZED (SELECT r, n, p, substr(h, 2 * p + 1, 2 * {piece + length}) AS part FROM pieces),
    windows AS (SELECT r, p, part, unnest(range(0, least({piece}, n - {length} + 1 - p))) AS i FROM cut),
    starts AS (SELECT r, p + i AS pos, count(*) OVER (PARTITION BY md5(substr(part, 2 * i + 1, {2 * length}))) > 1 AS again FROM windows),
    fresh AS (
        SELECT r, pos, coalesce(pos > lag(pos) OVER (PARTITION BY r ORDER BY pos) + {length}, true) AS opens FROM starts WHERE again
    ),
    numbered AS (SELECT r, pos, sum(opens::INT) OVER (PARTITION BY r ORDER BY pos) AS span FROM fresh),
    spans AS (SELECT r, span, min(pos) AS a, max(pos) + {length} AS b FROM numbered GROUP BY r, span),
    edges AS (SELECT r, a, b, lead(a) OVER (PARTITION BY r ORDER BY a) AS next, row_number() OVER (PARTITION BY r ORDER BY a) AS k FROM spans),
    tails AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed FROM spans GROUP BY r),
    between AS (
        SELECT r, k, substr(h, 2 * b + 1, 2 * (coalesce(next, n) - b)) AS part FROM edges JOIN coded USING (r)
        UNION ALL SELECT r, 0, substr(h, 1, 2 * a) FROM edges JOIN coded USING (r) WHERE k = 1
    ),
    kept AS (SELECT r, string_agg(part, '' ORDER BY k) AS h FROM between GROUP BY r)
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, coded.h))) AS kept_sha256
    FROM own JOIN coded USING (r) LEFT JOIN tails USING (r) LEFT JOIN kept USING (r)
    """


def quality_rules(risk: quality.Risk = quality.Risk()) -> str:
    """Counts by lists of words and lines, the binomial tail as a sum of its terms by the gamma function."""
    share = risk.max_false_rejection / len(risk.rules)
    cutoffs = ", ".join(f"({i}, {j}, {c!r}::DOUBLE)" for i, rule in enumerate(risk.rules) for j, c in enumerate(rule.cutoffs))
    side = lambda of: "CASE i " + " ".join(f"WHEN {i} THEN {getattr(rule, of)}" for i, rule in enumerate(risk.rules)) + " END"
    return f"""
    WITH {ROWS},
    taken AS MATERIALIZED (SELECT r, regexp_extract_all(text, '{WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM own),
    triples AS (SELECT r, i, count(*) OVER (PARTITION BY r, md5(array_to_string(words[i:i + 2], ' '))) > 1 AS again FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM taken)),
    repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM triples, range(3) AS t(k) WHERE again GROUP BY r),
    counted AS MATERIALIZED (
        SELECT r, doc_id, coalesce(lang, '') AS stratum, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
            len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_cased,
            length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims
        FROM own JOIN taken USING (r) LEFT JOIN repeats USING (r)
    ),
    failing AS (SELECT *, n_words < {risk.least_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
    cutoffs(i, j, cutoff) AS (VALUES {cutoffs}),
    rejected AS MATERIALIZED (SELECT r, doc_id, stratum, i, j, {side("numerator")} > cutoff * greatest({side("denominator")}, 1) AS hit FROM failing, cutoffs WHERE NOT base_failed),
    marks AS (SELECT doc_id, min(quality) >= 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    tried AS (
        SELECT stratum, i, j, count(*) FILTER (good) AS n, count(*) FILTER (good AND hit) AS g, count(*) FILTER (NOT good AND hit) AS b
        FROM rejected JOIN marks USING (doc_id) GROUP BY ALL
        HAVING n >= ceil(ln({risk.error / len(risk.rules)!r}) / ln(1 - {share!r}::DOUBLE))
    ),
    allowed AS (SELECT {risk.error!r}::DOUBLE / greatest(1, count(DISTINCT stratum) * {len(risk.rules)}) AS error FROM tried),
    terms AS (SELECT stratum, i, j, n, b, unnest(range(0, g + 1)) AS k FROM tried),
    bounds AS (
        SELECT stratum, i, j, b, sum(exp(lgamma(n + 1) - lgamma(k + 1) - CASE WHEN k < n THEN lgamma(n - k + 1) ELSE 0 END + k * ln({share!r}::DOUBLE) + (n - k) * ln(1 - {share!r}::DOUBLE))) AS tail
        FROM terms GROUP BY ALL
    ),
    passed AS (SELECT stratum, i, j, b, max(tail) OVER (PARTITION BY stratum, i ORDER BY j) <= error AS certified FROM bounds, allowed),
    chosen AS (SELECT stratum, i, j FROM passed WHERE certified AND b > 0 QUALIFY row_number() OVER (PARTITION BY stratum, i ORDER BY b DESC, j) = 1),
    gone AS (SELECT DISTINCT r FROM rejected JOIN chosen USING (stratum, i, j) WHERE hit)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND gone.r IS NULL AS kept
    FROM failing LEFT JOIN gone USING (r)
    """


def shards(n: int = 16) -> str:
    """The least capacity by bisection, each greedy pass cut by cut; texts' checks by the byte-wise rule of the cyclic code."""
    return f"""
    WITH RECURSIVE {ROWS},
    code AS MATERIALIZED (
        SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) AS x(b)
    ),
    sized AS MATERIALIZED (SELECT r, doc_id, strlen(text) + 1 AS size, sha256(text) AS key, hex(text) AS h FROM own),
    texts AS (SELECT DISTINCT key, h FROM sized),
    bytes AS (SELECT key, list_transform(range(0, strlen(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS v FROM texts),
    checks AS (SELECT key, xor(list_reduce(v, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM bytes, code),
    groups AS (SELECT key, sum(size)::BIGINT AS size FROM sized GROUP BY key),
    ends AS MATERIALIZED (SELECT key, sum(size) OVER (ORDER BY key)::BIGINT AS e FROM groups),
    whole AS MATERIALIZED (SELECT max(e) AS total FROM ends),
    search AS (
        SELECT 1::BIGINT AS low, total AS high, 0::BIGINT AS pos, 0 AS used FROM whole
        UNION ALL
        SELECT CASE WHEN stuck THEN middle + 1 ELSE low END, CASE WHEN done THEN middle ELSE high END, CASE WHEN stuck OR done THEN 0 ELSE next END, CASE WHEN stuck OR done THEN 0 ELSE used + 1 END
        FROM (
            SELECT *, next = total AND used < {n} AS done, next <= pos OR used >= {n} AS stuck
            FROM (SELECT low, high, pos, used, (low + high) // 2 AS middle, coalesce((SELECT max(e) FROM ends WHERE e <= pos + (low + high) // 2), 0) AS next, total FROM search, whole WHERE low < high)
        )
    ),
    least AS MATERIALIZED (SELECT max(low) AS capacity FROM search),
    cuts AS (
        SELECT 0 AS shard, 0::BIGINT AS a, (SELECT max(e) FROM ends WHERE e <= capacity) AS b FROM least
        UNION ALL
        SELECT shard + 1, b, (SELECT max(e) FROM ends WHERE e <= b + capacity) FROM cuts, least, whole WHERE b < total
    )
    SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
    FROM sized JOIN checks USING (key) JOIN ends USING (key) JOIN cuts ON e > a AND e <= b
    """


SQL: dict[str, str] = {
    "op1_minhash_near_dedup": near_duplicates(),
    "op3_substring_dedup": repeated_passages(),
    "op5_sharding": shards(),
    "op6_suffix_array_dedup": repeated_strings(),
    "op7_quality_rules": quality_rules(),
}
