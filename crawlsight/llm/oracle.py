"""DuckDB SQL for the queries that SQL can express."""

ORACLE = {
    "op10_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
            FROM documents),
        best AS (
            SELECT h, count(*) AS group_size,
                   first(doc_id ORDER BY n DESC, doc_id) AS keep_id
            FROM rows GROUP BY h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256
        FROM rows JOIN best USING (h)
    """,
    "op12_benchmark_decontamination": r"""
        WITH doc AS (
            SELECT doc_id, row_number() OVER () AS row_no,
                   list_filter(string_split_regex(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM documents),
        item AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id,
                   list_filter(string_split_regex(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM benchmark),
        wins AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(
                range(1, len(w) - least(len(w), 10) + 2),
                lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win
            FROM item WHERE len(w) > 0),
        cut AS (
            SELECT row_no, k, unnest(range(1, len(w) - k + 2)) AS i, w
            FROM doc, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k),
        hit AS (
            SELECT row_no, i, k, item_id
            FROM (SELECT row_no, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM cut) c
            JOIN wins USING (k, win)),
        places AS (
            SELECT row_no, count(DISTINCT spot) AS n_hit
            FROM (SELECT row_no, unnest(range(i, i + k)) AS spot FROM hit) GROUP BY row_no),
        named AS (
            SELECT row_no, count(DISTINCT item_id) AS n_items,
                   string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
            FROM hit GROUP BY row_no)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN places USING (row_no) LEFT JOIN named USING (row_no)
    """,
    "op11_phrase_collocation": r"""
        WITH cut AS (
            SELECT row_number() OVER () AS piece_no, lang, piece FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
        piece AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM cut),
        gram AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2),
                                                  lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM piece, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k),
        total AS (SELECT lang, count(*) AS n FROM gram WHERE k = 1 GROUP BY lang),
        freq AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 30),
        cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE k >= 2),
        cuts AS (
            SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS rest
            FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
        scored AS (
            SELECT lang, cuts.phrase, a, c, x.f AS l, y.f AS r,
                   CAST((CAST(a AS HUGEINT) * 2000000) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
            FROM cuts JOIN freq x USING (lang) JOIN freq y USING (lang)
            WHERE x.phrase = head AND y.phrase = rest),
        weakest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
        inner_part AS (
            SELECT lang, a, array_to_string(w[i:i + size - 1], ' ') AS phrase
            FROM (SELECT *, unnest(range(1, k - size + 2)) AS i
                  FROM (SELECT *, unnest(range(2, k)) AS size FROM cand WHERE k >= 3))),
        longer AS (SELECT lang, phrase, max(a) AS longest FROM inner_part GROUP BY ALL),
        kept AS (
            SELECT w.* FROM weakest w LEFT JOIN longer USING (lang, phrase)
            WHERE longest IS NULL OR 100 * longest < 80 * a),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """,
}
