"""SQL for the queries that SQL can express."""

from __future__ import annotations

from slotcast.llm.linerules import BOILERPLATE, MIN_WORDS, MOST_LOST, MOST_REPEATED, NAVIGATION, SEPARATORS

_HASH = "CAST('0x' || substr(md5(coalesce(CAST({0} AS VARCHAR), '')), 1, 15) AS BIGINT)"
_BITS = "lpad(bin({0}), 60, '0')"
_WORD = r"[^\x20\x09-\x0D]+"


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Codebook rounds over single components, each entry tried for each part."""
    steps = [f"""
        good AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cells AS MATERIALIZED (
            SELECT vec_id, label, (i - 1) // (len(v) // {parts}) AS part, (i - 1) % (len(v) // {parts}) AS place, CAST(floor({scale} * v[i]) AS BIGINT) AS x
            FROM (SELECT vec_id, label, v, unnest(range(1, len(v) + 1)) AS i FROM good)),
        first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM good QUALIFY entry < {entries}),
        book0 AS MATERIALIZED (SELECT part, entry, place, x FROM cells JOIN first USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""
        tried{r} AS (SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM cells c JOIN book{r} b USING (part, place) GROUP BY c.vec_id, c.part, b.entry),
        best{r} AS MATERIALIZED (SELECT vec_id, part, min({{'d': d, 'entry': entry}}) AS found FROM tried{r} GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""
        means{r} AS (SELECT part, found.entry AS entry, place, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM cells JOIN best{r} USING (vec_id, part) GROUP BY part, found.entry, place),
        book{r + 1} AS MATERIALIZED (SELECT part, entry, place, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN means{r} m USING (part, entry, place))""")
    return f"""
        WITH {",".join(steps)},
        coded AS (
            SELECT vec_id, string_agg(printf('%02x', found.entry), '' ORDER BY part) AS code, CAST(sum(found.d) AS BIGINT) AS error FROM best{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN good USING (vec_id)"""

ORACLE = {
    "op1_sharding": f"""
        WITH rows AS (
            SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
                   {_BITS.format(_HASH.format('doc_id'))} || {_BITS.format(_HASH.format('text'))} AS bits
            FROM documents),
        levels AS (SELECT bits, n_bytes, d, substr(bits, 1, d) AS bucket FROM rows, range(0, 121) t(d)),
        fits AS (
            SELECT d, bucket FROM levels GROUP BY d, bucket HAVING sum(n_bytes) <= 1048576 OR min(bits) = max(bits)),
        leaves AS (SELECT bits, min(l.d) AS depth FROM (SELECT DISTINCT bits, d, bucket FROM levels) l JOIN fits f ON f.d = l.d AND f.bucket = l.bucket GROUP BY bits)
        SELECT doc_id, substr(r.bits, 1, CAST(depth AS INTEGER)) AS shard, CAST(depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS page, n_bytes
        FROM rows r JOIN leaves v ON r.bits = v.bits""",
    "op2_url_filter": """
        WITH rules(listed, rule_host, rule_path) AS (VALUES
            ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        split AS (
            SELECT page_id, row_number() OVER () AS n,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
            FROM pages),
        fitting AS (
            SELECT n, rule_host || rule_path AS rule, listed, row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC) AS place
            FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(listed, 'allow') AS verdict
        FROM split LEFT JOIN (SELECT * FROM fitting WHERE place = 1) USING (n)""",
    "op4_embedding_dedup": """
        WITH RECURSIVE good AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
        LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a) USING (vec_id)""",
    "op6_suffix_dedup": r"""
        WITH words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\x0B\f]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
        spans AS (
            SELECT doc_id, s, md5(array_to_string(list_slice(w, s + 1, s + 50), ' ')) AS h
            FROM words, range(0, len(w) - 49) t(s) WHERE len(w) >= 50),
        firsts AS (SELECT h, min({'i': doc_id, 's': s}) AS f FROM spans GROUP BY h HAVING count(*) > 1),
        found AS (SELECT doc_id, s, f.i AS first_id, f.s AS first_s FROM spans JOIN firsts USING (h)),
        runs AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id, first_id, first_s - s ORDER BY s) AS run FROM found)
        SELECT doc_id, CAST(min(s) AS INTEGER) AS start_word, CAST(count(*) + 49 AS INTEGER) AS n_words, first_id AS first_doc_id, CAST(min(first_s) AS INTEGER) AS first_start_word,
               bool_and(doc_id = first_id AND s = first_s) AS kept
        FROM runs GROUP BY doc_id, first_id, first_s - s, run""",
    "op8_nearest": """
        WITH good AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score
            FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
        QUALIFY rank <= 10""",
    "op12_quality_rules": rf"""
        WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
        words AS (SELECT n, regexp_extract_all(text, '{_WORD}') AS w FROM docs),
        windows AS (
            SELECT n, i, {{'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}} AS gram FROM (SELECT n, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2)),
        again AS (SELECT n, i FROM windows QUALIFY count(*) OVER (PARTITION BY n, gram) > 1),
        covered AS (SELECT n, count(DISTINCT i + k) AS n_repeat_words FROM again, range(0, 3) t(k) GROUP BY n),
        lines AS (
            SELECT n, place, lines[place] AS line, regexp_extract_all(lines[place], '{_WORD}') AS w
            FROM (SELECT n, lines, unnest(range(1, len(lines) + 1)) AS place FROM (SELECT n, string_split(text, chr(10)) AS lines FROM docs))),
        told AS (
            SELECT n, len(w) AS n_words, row_number() OVER (PARTITION BY n, line ORDER BY place) > 1 AS seen,
                   translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                   regexp_matches(line, '([.!?]|…)([ "'')\]]|”|»)*[\x20\x09-\x0D]*$') AS ends,
                   len(list_filter(w, lambda x: x IN ({", ".join(f"'{s}'" for s in SEPARATORS)}))) AS bars,
                   len(regexp_extract_all(line, '[#*$%&|<>]')) + len(regexp_extract_all(line, '[!?]{{2,}}')) AS marks
            FROM lines WHERE len(w) > 0),
        ruled AS (
            SELECT n, n_words, seen,
                   CASE WHEN seen OR regexp_matches(low, '{"|".join(BOILERPLATE)}') THEN 'boilerplate'
                        WHEN (bars >= 2 AND 5 * bars >= n_words) OR (NOT ends AND n_words <= 6 AND regexp_matches(low, '^[\x20\x09-\x0D]*({"|".join(NAVIGATION)})\b')) THEN 'navigation'
                        WHEN NOT ends OR 4 * marks > n_words THEN 'punctuation' END AS rule
            FROM told),
        summed AS (
            SELECT n, count_if(seen) AS n_dup_lines, coalesce(sum(n_words) FILTER (rule IS NOT NULL), 0) AS lost_words, count_if(rule = 'punctuation') AS punctuation_lines,
                   count_if(rule = 'navigation') AS navigation_lines, count_if(rule = 'boilerplate') AS boilerplate_lines
            FROM ruled GROUP BY n),
        counts AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                   CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words,
                   CAST(coalesce(punctuation_lines, 0) AS BIGINT) AS punctuation_lines, CAST(coalesce(navigation_lines, 0) AS BIGINT) AS navigation_lines,
                   CAST(coalesce(boilerplate_lines, 0) AS BIGINT) AS boilerplate_lines
            FROM docs JOIN words USING (n) LEFT JOIN covered USING (n) LEFT JOIN summed USING (n))
        SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
               NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost_words <= {MOST_LOST} * n_words AS kept
        FROM counts""",
    "op13_vector_codes": _codes(),
}
