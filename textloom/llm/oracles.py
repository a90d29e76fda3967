"""DuckDB SQL for the exact operators; the others fit models, draw samples or hash, which SQL does not express."""

from __future__ import annotations

from textloom.llm.decontaminate import ENOUGH, MASKS, MIN_SHARE, MIN_TOKENS

_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_TOKENS = (
    r"list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), "
    r"'[^\p{L}\p{M}\p{N}\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g'), "
    r"'[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '')"
)
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _masked(n: str) -> str:
    """Tokens under the ones of every mask laid at each place of ``ts``, as text; the mask must fit in ``n`` tokens."""
    parts = []
    for number, mask in enumerate(MASKS):
        cared = ", ".join(f"ts[i + {k}]" for k, bit in enumerate(mask) if bit == "1")
        parts.append(f"CASE WHEN i + {len(mask) - 1} <= {n} THEN concat_ws(' ', '{number}', {cared}) END")
    return f"unnest([{', '.join(parts)}])"


SQL: dict[str, str] = {
    # tokens under the masks instead of their hashes; a short item is its own mask. A stretch ends at a place with a score
    # of 2.5 for each match less 1.5 for each token since the last lowest sum before it
    "op1_spaced_seed_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, ts FROM (SELECT DISTINCT doc_id, {_TOKENS} AS ts FROM documents)),
        b AS (SELECT item_id, ts, len(ts) AS n FROM (SELECT item_id, {_TOKENS} AS ts FROM benchmark) WHERE len(ts) > 0),
        items AS (SELECT row_number() OVER () AS item, ts, len(ts) AS n FROM (SELECT DISTINCT ts FROM b)),
        item_seeds AS (SELECT item, i, {_masked("n")} AS k FROM items, unnest(range(1, n + 1)) AS u(i) WHERE n >= {MIN_TOKENS}),
        doc_seeds AS (SELECT r, i, {_masked("len(ts)")} AS k FROM d, unnest(range(1, len(ts) + 1)) AS u(i)),
        hits AS (
          SELECT DISTINCT r, item, x.i - y.i AS shift FROM doc_seeds x JOIN item_seeds y USING (k)
          UNION
          SELECT r, item, i - 1 FROM items, d, unnest(range(1, len(d.ts) - n + 2)) AS u(i)
          WHERE n < {MIN_TOKENS} AND list_contains(d.ts, items.ts[1]) AND d.ts[i:i + n - 1] = items.ts
        ),
        along AS (
          SELECT r, item, shift, n, p, (shift + p >= 1 AND coalesce(d.ts[shift + p] = items.ts[p], false))::INT AS hit
          FROM hits JOIN d USING (r) JOIN items USING (item), unnest(range(1, n + 1)) AS v(p)
        ),
        sums AS (
          SELECT *, 2.5 * m - 1.5 * p AS s FROM (SELECT *, sum(hit) OVER (PARTITION BY r, item, shift ORDER BY p) AS m FROM along)
        ),
        lows AS (SELECT *, least(0, min(s) OVER (PARTITION BY r, item, shift ORDER BY p)) AS low FROM sums),
        runs AS (
          SELECT *, s - low AS score, m - coalesce(max(m) FILTER (s = low) OVER (PARTITION BY r, item, shift ORDER BY p), 0) AS run FROM lows
        ),
        diagonals AS (
          SELECT r, item, shift, n, sum(hit) AS n_matched,
            CASE WHEN max(score) > 0 THEN arg_max(run, (score, -p)) ELSE 0 END AS n_stretch
          FROM runs GROUP BY r, item, shift, n
        ),
        judged AS (
          SELECT *, CASE WHEN n < {MIN_TOKENS} THEN n ELSE greatest({MIN_TOKENS}, ceil({MIN_SHARE} * n - 1e-9)) END AS needed FROM diagonals
        ),
        best AS (
          SELECT r, item, n, needed, max((n_matched, n_stretch)) AS best FROM judged
          WHERE n_matched >= least(needed, {max(MIN_TOKENS, ENOUGH)}) GROUP BY r, item, n, needed
        ),
        found AS (
          SELECT doc_id, item, n, max(best) AS best FROM best JOIN d USING (r)
          WHERE best[1] >= needed OR (best[2] >= {max(MIN_TOKENS, ENOUGH)} AND n >= {MIN_TOKENS}) GROUP BY doc_id, item, n
        )
        SELECT DISTINCT doc_id, item_id, best[1]::INT AS n_matched, best[2]::INT AS n_stretch, found.n::INT AS n_item
        FROM found JOIN items USING (item) JOIN b ON b.ts = items.ts""",
    "op4_token_group_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
        shingles AS (
          SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM w, unnest(range(1, len(ws) - 2)) AS u(i) WHERE len(ws) >= 4
          UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
          SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), links AS (
          SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
        ), linked AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT x, y FROM linked UNION SELECT r.x, b.y FROM reach r JOIN linked b ON r.y = b.x)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
        FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) USING (doc_id)""",
    "op10_block_anchor_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) AS u(i)),
        placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS place FROM windows),
        gone AS (SELECT DISTINCT doc_id, i + j AS p FROM placed, unnest(range(0, 20)) AS v(j) WHERE place > 1),
        words AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(p)),
        kept AS (
          SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
          FROM words LEFT JOIN gone USING (doc_id, p) WHERE gone.doc_id IS NULL GROUP BY words.doc_id
        )
        SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    # bytes as two hexadecimal digits each
    "op11_suffix_array_levels": """
        WITH d AS (
          SELECT r, doc_id, t, (length(t) // 2) AS n
          FROM (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents)
        ),
        strings AS (SELECT r, doc_id, i, substring(t, 2 * i - 1, 100) AS k FROM d, unnest(range(1, n - 48)) AS u(i)),
        firsts AS (SELECT k, min(doc_id) AS first FROM strings GROUP BY k HAVING min(doc_id) < max(doc_id)),
        starts AS (SELECT r, i FROM strings JOIN firsts USING (k) WHERE doc_id > first),
        breaks AS (SELECT r, i, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -50) > 50 AS new FROM starts),
        runs AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM breaks),
        spans AS (SELECT r, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY r, run),
        ordered AS (SELECT *, lead(a) OVER (PARTITION BY r ORDER BY a) AS next FROM spans),
        pieces AS (
          SELECT r, b AS a, coalesce(next - 1, d.n) AS z FROM ordered JOIN d USING (r)
          UNION ALL SELECT r, 1, a - 1 FROM d JOIN (SELECT r, min(a) AS a FROM spans GROUP BY r) USING (r)
        ),
        kept AS (SELECT r, string_agg(substring(d.t, 2 * a - 1, 2 * (z - a + 1)), '' ORDER BY a) AS t FROM pieces JOIN d USING (r) GROUP BY r),
        sums AS (SELECT r, sum(b - a) AS gone, count(*) AS n FROM spans GROUP BY r)
        SELECT doc_id, d.n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(sums.n, 0) AS n_spans,
          sha256(unhex(CASE WHEN gone IS NULL THEN d.t ELSE kept.t END)) AS kept_sha256
        FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)""",
    # the checksum of an id bit by bit; stretches of a lag are islands among the pairs of equal words
    "op13_all_lag_runs": f"""
        WITH w0 AS (
          SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS ws,
            xor(list_reduce(
              list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda b: (ascii(c)::BIGINT >> b) & 1)))),
              lambda s, bit: xor(s >> 1, (xor(s, bit) & 1) * 3988292384)), 4294967295) AS h
          FROM documents
        ),
        w1 AS (SELECT *, len(ws) AS n, h // 10 AS g, (h // 10) % len(ws) AS a FROM w0),
        w2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w1),
        words AS (
          SELECT r, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM w2, unnest(range(n)) AS u(i)
        ),
        pairs AS (SELECT x.r, y.i - x.i AS p, x.i FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND x.i < y.i JOIN w2 ON w2.r = x.r WHERE 2 * (y.i - x.i) <= n),
        islands AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM pairs),
        stretches AS (SELECT r, p, min(i) AS s, count(*) + p AS k FROM islands GROUP BY r, p, island HAVING count(*) + p >= greatest(12, 2 * p)),
        runs AS (SELECT r, s, k, min(p) AS q FROM stretches GROUP BY r, s, k),
        told AS (
          SELECT r, count(*) AS n_runs, arg_min((s, k, q), (-k, s, q)) AS best, string_agg(s || ',' || k || ',' || q || chr(10), '' ORDER BY s, q) AS t
          FROM runs GROUP BY r
        ),
        gone AS (SELECT DISTINCT r, i FROM runs, unnest(range(s + q, s + k)) AS u(i)),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM words LEFT JOIN gone USING (r, i) WHERE gone.r IS NULL GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period,
          1000 * best[2] // best[3] AS exponent_milli, sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
        FROM w2 LEFT JOIN told USING (r) LEFT JOIN kept USING (r)""",
}
