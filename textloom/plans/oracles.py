"""DuckDB SQL for the catalogue's queries."""

from __future__ import annotations

_NORM = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))"
_SHARE = "concat('0x', substr(sha256({0}), 1, 13))::BIGINT / 4503599627370496.0"
_POOL = f"CASE WHEN {_SHARE.format(_NORM)} < 0.2 THEN 'test' ELSE 'train' END"
_SENTENCES = (
    r"string_split(regexp_replace(regexp_replace(trim(ln, ' ' || chr(9) || chr(13)), '([。．！？!?]+)([^。．！？!?」』）)\]])', "
    r"'\1' || chr(1) || '\2', 'g'), '(\.)(\s)', '\1' || chr(1) || '\2', 'g'), chr(1))"
)
_LINES = "SELECT d.*, u.ln, u.line_idx FROM documents d, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(ln, line_idx)"
_SHORT = "CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 2000 THEN 'medium' WHEN length(text) < 6000 THEN 'long' ELSE '__none__' END"
_SYMBOLS = r"len(regexp_extract_all(text, '[#*$%&|!]'))"


def _stop(words: str) -> str:
    return rf"len(regexp_extract_all(lower(text), '(^|[ \n])({words})[ .,\n]'))"


_COUNTS = "[" + ", ".join(_stop(w) for w in ("der|die|das|und", "the|and|of|that", "el|los|que|para", "le|les|des|une")) + "]"
_LANGUAGE = f"['de', 'en', 'es', 'fr'][list_position({_COUNTS}, list_max({_COUNTS}))]"
_PASSAGES = rf"""
WITH RECURSIVE lines AS ({_LINES}),
parts AS (
  SELECT doc_id, lang, text AS document, line_idx, {_SENTENCES} AS ss FROM lines
), walk AS (
  SELECT doc_id, lang, document, line_idx, ss, 1 AS i, []::VARCHAR[] AS done, '' AS cur FROM parts
  UNION ALL
  SELECT doc_id, lang, document, line_idx, ss, i + 1,
    CASE WHEN length(cur) + length(ss[i]) <= 300 THEN done
      ELSE list_concat(list_append(done, cur), [substr(ss[i], k * 300 + 1, 300) for k in range(0, greatest(cast(ceil(length(ss[i]) / 300.0) AS BIGINT) - 1, 0))]) END,
    CASE WHEN length(cur) + length(ss[i]) <= 300 THEN cur || ss[i]
      ELSE substr(ss[i], greatest(cast(ceil(length(ss[i]) / 300.0) AS BIGINT) - 1, 0) * 300 + 1, 300) END
  FROM walk WHERE i <= len(ss)
), ended AS (
  SELECT doc_id, lang, document, line_idx, list_append(done, cur) AS ps FROM walk WHERE i = len(ss) + 1
), each AS (
  SELECT doc_id, lang, document, line_idx, p.k, trim(p.x, ' ' || chr(9) || chr(13)) AS passage
  FROM ended, unnest(ps) WITH ORDINALITY AS p(x, k)
), kept AS (SELECT * FROM each WHERE length(passage) >= 10)
"""
_UNIQUE = f"SELECT * FROM (SELECT *, {_NORM} AS norm, row_number() OVER (PARTITION BY {_NORM} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"
_PREPARED = r"""
WITH ps AS (
  SELECT source, trim(p, ' ' || chr(9) || chr(13)) AS text FROM documents, unnest(string_split(text, chr(10))) AS u(p)
), prepared AS (
  SELECT text, min(source) AS source FROM ps WHERE length(text) >= 20 GROUP BY text
)
"""
_CANDIDATES = f"""
WITH base AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position, {_NORM} AS norm, {_POOL} AS pool, {_SHORT} AS bucket,
    contains(text, '@') AS abstained FROM documents
), found AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS copy FROM base
  WHERE pool = 'train' AND NOT abstained AND norm NOT IN (SELECT {_NORM} FROM benchmark) AND bucket <> '__none__'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS rank FROM found WHERE copy = 1
), chosen AS (
  SELECT * FROM ranked WHERE rank <= CASE bucket WHEN 'short' THEN 40 WHEN 'medium' THEN 60 ELSE 30 END
)
"""
_WRITTEN = f"""
WITH written AS (
  SELECT doc_id, text, n_chars, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS written,
    CASE WHEN {_SYMBOLS} > 10 THEN 'bad' ELSE 'good' END AS rule, n_chars < 200 AS abstained
  FROM documents JOIN labels USING (doc_id)
), judged AS (
  SELECT *, CASE WHEN abstained THEN 'abstained' WHEN rule = written THEN 'agreed' ELSE 'disagreed' END AS outcome,
    CASE WHEN abstained THEN written ELSE rule END AS label
  FROM written
)
"""
_RUNS = r"""
WITH chars AS (
  SELECT doc_id, text, u.i - 1 AS pos, substr(text, u.i, 1) AS c
  FROM documents, unnest(range(1, length(text) + 1)) AS u(i) WHERE regexp_matches(text, '[0-9]')
), digits AS (
  SELECT doc_id, text, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM chars WHERE c BETWEEN '0' AND '9'
), spans AS (
  SELECT doc_id, any_value(text) AS text, min(pos) AS start_at, max(pos) + 1 AS end_at FROM digits GROUP BY doc_id, run
)
"""
_PRF = """
round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 12) AS precision,
round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 12) AS recall,
round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0.0 END, 12) AS f1,
CAST(tp + fn AS BIGINT) AS support
"""
_CLASSES = f"""
WITH pairs AS (SELECT lang AS gold, {_LANGUAGE} AS guess FROM documents),
counts AS (
  SELECT label, CAST(count(*) FILTER (WHERE gold = label AND guess = label) AS DOUBLE) AS tp,
    CAST(count(*) FILTER (WHERE gold <> label AND guess = label) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (WHERE gold = label AND guess <> label) AS DOUBLE) AS fn
  FROM pairs, (VALUES ('de'), ('en'), ('es'), ('fr')) AS l(label) GROUP BY label
)
"""
_FLAGGED = rf"""
WITH pairs AS (
  SELECT doc_id AS id, quality = 1 AS q, toxic = 1 AS t, {_SYMBOLS} <= 10 AS pq,
    regexp_matches(text, '\b(idiot|moron|clown|pathetic|worthless)\b') AS pt
  FROM documents JOIN labels USING (doc_id)
)
"""


def _hash(tag: str) -> str:
    return _SHARE.format(f"concat_ws(':', doc_id::VARCHAR, '{tag}:42')")


SQL: dict[str, str] = {
    "flagship": f"""{_PASSAGES.replace("FROM documents d,", f"FROM ({_UNIQUE}) d,")}
        SELECT CASE WHEN {_SHARE.format(_NORM.replace("text", "document"))} < 0.2 THEN 'test' ELSE 'train' END AS pool, lang,
        count(*) AS passages, CAST(sum(length(passage)) AS BIGINT) AS chars FROM kept GROUP BY 1, 2""",
    "normalize_text": f"SELECT doc_id, {_NORM} AS norm FROM documents",
    "dedup_first_wins": f"SELECT doc_id, lang FROM ({_UNIQUE})",
    "store_insert": f"""SELECT doc_id, source FROM (SELECT *, {_NORM} AS norm, row_number() OVER (PARTITION BY {_NORM} ORDER BY doc_id) AS rn
        FROM documents WHERE source <> 'src0') WHERE rn = 1 AND norm NOT IN (SELECT {_NORM} FROM documents WHERE source = 'src0')""",
    "held_out_isolation": f"""SELECT doc_id FROM documents WHERE {_NORM} NOT IN
        (SELECT {_NORM} FROM benchmark UNION ALL SELECT {_NORM} FROM conversations)""",
    "clean_seeds": f"""SELECT item_id AS pos, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY {_NORM} ORDER BY item_id) AS rn
        FROM benchmark) WHERE rn = 1 AND length(trim(text)) BETWEEN 1 AND 200 ORDER BY item_id LIMIT 40""",
    "prepare_paragraphs": f"{_PREPARED} SELECT text, source FROM prepared",
    "source_stats": f"{_PREPARED} SELECT source, count(*) AS paragraphs, CAST(sum(length(text)) AS BIGINT) AS chars FROM prepared GROUP BY source",
    "split_sentences": f"""WITH lines AS ({_LINES}) SELECT doc_id, CAST(line_idx - 1 AS INTEGER) AS line_idx, CAST(s.k - 1 AS INTEGER) AS sentence_idx, s.x AS sentence
        FROM lines, unnest({_SENTENCES}) WITH ORDINALITY AS s(x, k) WHERE s.x <> ''""",
    "split_passages": f"""{_PASSAGES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_idx, k) - 1 AS INTEGER) AS passage_idx,
        passage AS text FROM kept""",
    "pool_assignment": f"SELECT doc_id, {_POOL} AS pool FROM documents",
    "fixed_hash_shuffle": "SELECT doc_id, row_number() OVER (ORDER BY sha256(text || ':42'), doc_id) AS position FROM documents",
    "chunk_requests": "SELECT conv_id, turn, CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) // 20 AS BIGINT) AS chunk FROM conversations",
    "train_valid_split": """WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(doc_id::VARCHAR || '/' || source || ':42'), doc_id::VARCHAR || '/' || source) AS rn, count(*) OVER () AS n FROM documents)
        SELECT doc_id, CASE WHEN rn <= greatest(1, round_even(n * 0.15, 0)) THEN 'valid' ELSE 'train' END AS split FROM h""",
    "normalized_weights": """WITH c AS (SELECT lang AS label, count(*) AS n FROM documents WHERE lang <> 'es' GROUP BY 1),
        f AS (SELECT l.label, coalesce(c.n, (SELECT avg(n) FROM c)) AS w FROM (VALUES ('de'), ('en'), ('es'), ('fr')) AS l(label) LEFT JOIN c USING (label))
        SELECT label, round(w / sum(w) OVER (), 12) AS weight FROM f""",
    "label_quotas": """WITH c AS (SELECT lang AS label, count(*)::DOUBLE AS w FROM documents GROUP BY 1),
        r AS (SELECT label, w / sum(w) OVER () * 777 AS raw FROM c), b AS (SELECT label, floor(raw) AS base, raw - floor(raw) AS rest FROM r)
        SELECT label, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= 777 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b""",
    "corpus_weights": """SELECT 'quality' AS label, round(sum(quality) / (sum(quality) + sum(toxic)) * 0.75, 12) AS weight FROM labels
        UNION ALL SELECT 'toxic', round(sum(toxic) / (sum(quality) + sum(toxic)) * 0.75, 12) FROM labels UNION ALL SELECT '__none__', 0.25""",
    "rule_labels": f"SELECT doc_id, {_SHORT} AS bucket, contains(text, '@') AS abstained FROM documents",
    "sample_quota": f"{_CANDIDATES} SELECT doc_id, bucket FROM chosen",
    "sample_fill_report": f"""{_CANDIDATES} SELECT q.label, CAST(q.quota AS BIGINT) AS quota, count(c.doc_id) AS filled
        FROM (VALUES ('short', 40), ('medium', 60), ('long', 30), ('__none__', 0)) AS q(label, quota) LEFT JOIN chosen c ON c.bucket = q.label GROUP BY 1, 2""",
    "sample_stats": f"""{_CANDIDATES} SELECT (SELECT count(*) FROM chosen) AS collected, CASE WHEN (SELECT count(*) FROM chosen) = 130
        THEN (SELECT max(position) FROM chosen) ELSE (SELECT count(*) FROM documents) END AS scanned, false AS stalled""",
    "sample_stall": f"""{_CANDIDATES}, wanted AS (
          SELECT * FROM ranked WHERE bucket = 'long' OR (bucket = 'medium' AND rank <= 25)
        ), gaps AS (SELECT *, position - lag(position, 1, 0) OVER (ORDER BY position) AS gap FROM wanted),
        kept AS (SELECT * FROM gaps WHERE position < coalesce((SELECT min(position) FROM gaps WHERE gap > 20), 1 << 60)),
        ends AS (SELECT coalesce((SELECT max(position) FROM kept), 0) AS last, (SELECT count(*) FROM documents) AS total)
        SELECT doc_id, position, bucket, least(last + 20, total) AS scanned, total > last + 20 AS stalled FROM kept, ends""",
    "cell_sampling": f"""SELECT doc_id::VARCHAR AS key, CASE WHEN {_hash("label")} < 0.4 THEN 'de' WHEN {_hash("label")} < 0.5 THEN 'en'
        WHEN {_hash("label")} < 0.8 THEN 'es' ELSE 'fr' END AS label, ['dry', 'warm', 'odd'][CAST(floor({_hash("tone")} * 3) AS INTEGER) + 1] AS tone,
        ['note', 'talk', 'list', 'tale'][CAST(floor({_hash("form")} * 4) AS INTEGER) + 1] AS form, {_hash("lookalike")} < 0.3 AS lookalike FROM documents""",
    "consult_labeler": f"{_WRITTEN} SELECT doc_id, label, written, outcome FROM judged",
    "labeler_agreement": f"""{_WRITTEN}, c AS (SELECT CASE WHEN n_chars < 2000 THEN 'short' ELSE 'long' END AS split,
        count(*) FILTER (WHERE outcome = 'agreed') AS agreed, count(*) FILTER (WHERE outcome = 'disagreed') AS disagreed,
        count(*) FILTER (WHERE outcome = 'abstained') AS abstained FROM judged GROUP BY 1)
        SELECT *, agreed + disagreed AS labeled, round(agreed::DOUBLE / nullif(agreed + disagreed, 0), 12) AS rate FROM c""",
    "verify_filter": f"SELECT doc_id FROM documents WHERE lang = {_LANGUAGE}",
    "verification_gate": f"""{_WRITTEN} SELECT doc_id, outcome FROM judged WHERE outcome <> 'abstained'
        OR label = CASE WHEN length(text) - length(replace(text, '!', '')) < 3 THEN 'good' ELSE 'bad' END""",
    "signatures": """SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN '["quality","toxic"]' WHEN quality = 1 THEN '["quality"]'
        WHEN toxic = 1 THEN '["toxic"]' ELSE '[]' END AS signature FROM documents JOIN labels USING (doc_id)""",
    "describe_examples": r"""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[0-9]+')) > 0
        THEN list_aggregate(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: 'NUMBER=''' || x || ''''), 'string_agg', '; ')
        WHEN lang = 'en' THEN 'english' ELSE '(none)' END AS described FROM documents""",
    "class_items": "SELECT conv_id, turn, role AS label FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''",
    "span_items": r"""WITH f AS (SELECT doc_id, trim(text) AS text, regexp_extract(text, '[^ \n]+') AS w FROM documents)
        SELECT doc_id, CAST(strpos(text, w) - 1 AS INTEGER) AS start_at, CAST(strpos(text, w) - 1 + length(w) AS INTEGER) AS end_at FROM f
        WHERE w <> '' AND (length(text) - length(replace(text, w, ''))) / length(w) = 1""",
    "store_two_writers": f"SELECT md5(n) AS norm_md5, 1 AS rows, 1 AS rows_of_id FROM (SELECT DISTINCT {_NORM} AS n FROM documents)",
    # each quote in turn: the smallest place where it stands and meets none of the taken intervals
    "locate_quotes": r"""WITH RECURSIVE w AS (
          SELECT doc_id, text, list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> '') AS ws FROM documents
        ), q AS (
          SELECT doc_id, text, [ws[2], ws[1], ws[1], ws[4] || ' ' || ws[5], ws[5]] AS qs, ['b', 'a', 'again', 'pair', 'in'] AS ls FROM w WHERE len(ws) > 5
        ), walk AS (
          SELECT doc_id, text, qs, ls, 1 AS i, []::STRUCT(s BIGINT, e BIGINT, l VARCHAR)[] AS taken, true AS found FROM q
          UNION ALL
          SELECT doc_id, text, qs, ls, i + 1, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, {'s': p - 1, 'e': p - 1 + length(qs[i]), 'l': ls[i]}) END,
            found AND p IS NOT NULL
          FROM (
            SELECT *, list_min(list_filter(range(1, length(text) + 1), lambda c: substr(text, c, length(qs[i])) = qs[i]
              AND len(list_filter(taken, lambda t: c - 1 < t.e AND c - 1 + length(qs[i]) > t.s)) = 0)) AS p
            FROM walk WHERE i <= 5 AND found
          )
        ), ended AS (SELECT doc_id, found, CASE WHEN found THEN taken END AS taken FROM walk WHERE i = 6 OR NOT found)
        SELECT doc_id, found, CAST(t.s AS INTEGER) AS start_at, CAST(t.e AS INTEGER) AS end_at, t.l AS label
        FROM ended, unnest(CASE WHEN found THEN taken ELSE [NULL] END) AS u(t)""",
    "digit_spans": f"{_RUNS} SELECT doc_id, CAST(start_at AS INTEGER) AS start_at, CAST(end_at AS INTEGER) AS end_at FROM spans",
    "bio_encode": f"""{_RUNS} SELECT doc_id, CAST(pos AS INTEGER) AS pos,
        CASE WHEN pos = min(pos) OVER (PARTITION BY doc_id, run) THEN 'B-NUMBER' ELSE 'I-NUMBER' END AS tag FROM digits""",
    "bio_decode": f"{_RUNS} SELECT doc_id, CAST(start_at AS INTEGER) AS start_at, CAST(end_at AS INTEGER) AS end_at, 'NUMBER' AS label FROM spans",
    "encode_labels": "SELECT doc_id, CAST(list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS BIGINT) AS class_id FROM documents",
    "unreachable_spans": rf"""{_RUNS} SELECT doc_id, count(*) FILTER (WHERE (start_at > 0 AND NOT regexp_matches(substr(text, start_at, 1), '\s'))
        OR (end_at < length(text) AND NOT regexp_matches(substr(text, end_at + 1, 1), '\s'))) AS unreachable FROM spans GROUP BY doc_id""",
    "multiclass_metrics": f"{_CLASSES} SELECT label, {_PRF} FROM counts",
    "multiclass_summary": f"""{_CLASSES}, s AS (SELECT label, tp + fp + fn AS seen, {_PRF} FROM counts)
        SELECT round(avg(f1) FILTER (WHERE seen > 0), 12) AS primary, (SELECT round(avg((gold = guess)::INTEGER), 12) FROM pairs) AS accuracy FROM s""",
    "multilabel_metrics": f"""{_FLAGGED}, counts AS (
        SELECT 'quality' AS label, count(*) FILTER (WHERE q AND pq)::DOUBLE AS tp, count(*) FILTER (WHERE NOT q AND pq)::DOUBLE AS fp, count(*) FILTER (WHERE q AND NOT pq)::DOUBLE AS fn FROM pairs
        UNION ALL SELECT 'toxic', count(*) FILTER (WHERE t AND pt)::DOUBLE, count(*) FILTER (WHERE NOT t AND pt)::DOUBLE, count(*) FILTER (WHERE t AND NOT pt)::DOUBLE FROM pairs)
        SELECT label, {_PRF} FROM counts""",
    "span_metrics": f"""{_RUNS}, counts AS (SELECT 'NUMBER' AS label, count(*) FILTER (WHERE end_at - start_at > 1)::DOUBLE AS tp, 0.0::DOUBLE AS fp,
        count(*) FILTER (WHERE end_at - start_at = 1)::DOUBLE AS fn FROM spans) SELECT label, {_PRF} FROM counts""",
    "error_listing": f"{_FLAGGED} SELECT id FROM pairs WHERE q <> pq OR t <> pt",
    "error_sample": f"""{_FLAGGED}, e AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rn, count(*) OVER () AS n FROM pairs WHERE q <> pq OR t <> pt)
        SELECT id FROM e WHERE rn % greatest(1, n // 20) = 0 ORDER BY id LIMIT 20""",
    "best_round": """WITH r AS (SELECT lang, min(doc_id) AS round, round(avg((n_chars > 1000)::INTEGER), 1) AS "primary",
        CASE WHEN lang <> 'en' THEN round(avg((n_chars > 2000)::INTEGER), 3) END AS valid FROM documents GROUP BY lang)
        SELECT round, "primary" FROM r ORDER BY "primary" DESC, coalesce(valid, 0) DESC, round LIMIT 1""",
    "decision_rules": """SELECT vec_id, ['de', 'en', 'es', 'fr'][list_position(embedding[1:4], list_max(embedding[1:4]))] AS best,
        concat_ws(',', CASE WHEN embedding[1] > 0 THEN 'de' END, CASE WHEN embedding[2] > 0 THEN 'en' END, CASE WHEN embedding[3] > 0 THEN 'es' END,
        CASE WHEN embedding[4] > 0 THEN 'fr' END) AS "over" FROM embeddings""",
    "store_label_counts": rf"""WITH r AS (SELECT CASE WHEN {_SHARE.format("doc_id::VARCHAR")} < 0.2 THEN 'test' ELSE 'train' END AS split,
        CASE WHEN regexp_matches(text, '[0-9]') THEN list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: 'NUMBER')
        WHEN quality = 1 AND toxic = 1 THEN ['quality', 'toxic'] WHEN quality = 1 THEN ['quality'] WHEN toxic = 1 THEN ['toxic'] ELSE ['__none__'] END AS ls
        FROM labels JOIN documents USING (doc_id)) SELECT split, u.l AS label, count(*) AS count FROM r, unnest(ls) AS u(l) GROUP BY 1, 2""",
}

SQL["store_norm_index"] = SQL["store_insert"]
SQL["stream_dedup"] = SQL["dedup_first_wins"]


def _draws(turns: int) -> str:
    """``s<turns>`` with the places ``t<turns>`` that each request of ``s0`` draws."""
    steps = []
    for i in range(turns):
        j = f"(n - {turns} + {i})"
        drawn = f"concat('0x', substr(sha256(key || '/' || {j}), 1, 13))::BIGINT % ({j} + 1)"
        steps.append(f"s{i + 1} AS (SELECT *, list_append(t{i}, CASE WHEN list_contains(t{i}, {drawn}) THEN {j} ELSE {drawn} END) AS t{i + 1} FROM s{i})")
    return ", ".join(steps)


SQL["request_samples"] = f"""
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents WHERE doc_id IS NOT NULL),
s0 AS (
  SELECT DISTINCT conv_id, conv_id || '/' || turn AS request, '42/' || conv_id || '/' || turn AS key, (SELECT count(*) FROM p) AS n, []::BIGINT[] AS t0
  FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL
), {_draws(4)}, each AS (SELECT conv_id, request, key, u.place FROM s4, unnest(t4) AS u(place)), ranked AS (
  SELECT request, doc_id, row_number() OVER (PARTITION BY request ORDER BY sha256('kept/' || key || '/' || doc_id), doc_id) AS rank
  FROM each JOIN p USING (place) WHERE doc_id <> conv_id
)
SELECT request, doc_id FROM ranked WHERE rank <= 3
"""
