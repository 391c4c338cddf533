"""The registered queries as plain SQL for a second engine, over the same tables."""

from __future__ import annotations

_ORACLES: dict[str, str] = {}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


# --- shared inputs -------------------------------------------------------------

PAIRS = """
pairs AS (
  SELECT row_number() OVER (ORDER BY u.conv_id, u.turn) - 1 AS record_id, u.text AS q, a.text AS a, s.text AS ctx
  FROM conversations u
  JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = 0 AND s.role = 'system'
  WHERE u.role = 'user')"""

def _raw(usable: bool) -> str:
    whole = "0, 2, 4" if usable else "0, 2"
    return PAIRS + f""",
raw AS (
  SELECT record_id,
    CASE WHEN m IN (0, 4) THEN q END AS prompt, CASE WHEN m = 1 THEN q END AS instruction,
    CASE WHEN m = 2 THEN q END AS question, CASE WHEN m = 1 THEN ctx END AS input,
    CASE WHEN m = 0 THEN a END AS completion, CASE WHEN m = 4 AND {usable} THEN a END AS response,
    CASE WHEN m = 1 THEN a END AS output, CASE WHEN m = 2 THEN a END AS answer,
    CASE WHEN m IN ({whole}) THEN ctx END AS context,
    CASE WHEN m = 3 THEN concat_ws(E'\\n', ctx, q, a) END AS text
  FROM (SELECT *, record_id % 5 AS m FROM pairs))"""


def _norm(usable: bool) -> str:
    return _raw(usable) + """,
picked AS (
  SELECT record_id,
    COALESCE(NULLIF(prompt, ''), NULLIF(instruction, ''), NULLIF(question, ''),
             NULLIF(input, '')) AS p,
    COALESCE(NULLIF(completion, ''), NULLIF(response, ''), NULLIF(output, ''),
             NULLIF(answer, '')) AS c,
    COALESCE(NULLIF(context, ''), NULLIF(input, '')) AS x, NULLIF(text, '') AS t
  FROM raw),
norm AS (
  SELECT record_id, 'pair' AS kind,
    CASE WHEN x IS NOT NULL AND x <> p THEN p || E'\\n\\nContext:\\n' || x ELSE p END AS prompt,
    c AS completion, NULL::VARCHAR AS text
  FROM picked WHERE p IS NOT NULL AND c IS NOT NULL
  UNION ALL
  SELECT record_id, 'text', NULL, NULL, t
  FROM picked WHERE (p IS NULL OR c IS NULL) AND t IS NOT NULL)"""


TRAINING = _norm(True) + """,
training AS (
  SELECT * FROM norm
  UNION ALL
  SELECT -1 - doc_id, 'text', NULL, NULL, text FROM documents WHERE text <> ''),
shown AS (
  SELECT *, CASE WHEN kind = 'pair'
    THEN E'### Instruction:\\n' || prompt || E'\\n\\n### Response:\\n' END AS head,
    CASE WHEN kind = 'pair'
    THEN E'### Instruction:\\n' || prompt || E'\\n\\n### Response:\\n' || completion
    ELSE text END AS rendered
  FROM training)"""


def _words(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '\\S+'))::BIGINT"


FILTERED = TRAINING + f""",
counted AS (
  SELECT *, CASE WHEN kind = 'pair' THEN {_words('head')} ELSE 0 END AS p,
    {_words("COALESCE(completion, text)")} AS c, {_words('rendered')} AS n
  FROM shown),
filtered AS (
  SELECT *, CASE WHEN kind = 'text' THEN CASE WHEN c < 2 THEN 'too_short' END
    WHEN p >= 512 - 4 THEN 'prompt_too_long' WHEN p + c > 512 THEN 'over_length' END
    AS drop_reason
  FROM counted),
kept AS (
  SELECT record_id, kind, record_id AS seq, p, c,
    LEAST(n + CASE WHEN kind = 'pair' THEN 1 ELSE 0 END, 512) AS length
  FROM filtered WHERE drop_reason IS NULL)"""

DOC_LENGTHS = f"""
lens AS (
  SELECT doc_id AS record_id, doc_id AS seq, LEAST({_words('text')}, 512) AS length
  FROM documents)"""


def _batched(source: str, order: str, size: int = 4) -> str:
    return f"""
ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS rank FROM {source}),
batched AS (
  SELECT *, rank // {size} AS batch_id, rank % {size} AS pos_in_batch,
    max(length) OVER (PARTITION BY rank // {size}) AS width FROM ranked)"""


def _hash(seed: int | str, key: str) -> str:
    return f"md5('{seed}:' || {key}::VARCHAR), {key}"


CHAT = """
chat AS (
  SELECT conv_id AS record_id, conv_id,
    list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts
  FROM conversations GROUP BY conv_id),
lined AS (
  SELECT *, array_to_string(list_transform(range(1, len(roles) + 1),
    lambda i: roles[i] || ': ' || texts[i]), E'\\n') AS lines FROM chat),
styled AS (
  SELECT *, CASE WHEN len(roles) = 1 AND roles[1] = 'user'
    THEN E'### Instruction:\\n' || texts[1] || E'\\n\\n### Response:\\n'
    ELSE lines || E'\\nassistant:' END AS instruct FROM lined)"""


REQUESTS = CHAT + """,
asked AS (
  SELECT 'r' || record_id AS request_id, conv_id,
    CASE WHEN conv_id % 17 = 0 THEN '/v1/embeddings'
      WHEN conv_id % 5 = 0 THEN '/v1/completions' ELSE '/v1/chat/completions' END AS route,
    conv_id % 19 = 0 OR conv_id % 23 = 3 AS blank, conv_id % 19 <> 0 AND conv_id % 23 = 3 AS flagged,
    conv_id % 19 <> 0 AND conv_id % 23 IN (1, 2) AS bad, lines, instruct,
    texts[len(texts)] AS answer FROM styled),
parsed AS (
  SELECT request_id, route, bad, answer,
    CASE WHEN route = '/v1/chat/completions' THEN 'chat' ELSE 'completion' END AS kind,
    CASE WHEN route = '/v1/chat/completions'
      THEN CASE WHEN blank THEN E'\\nassistant:' ELSE instruct END
      ELSE CASE WHEN flagged THEN 'p' WHEN blank THEN '' ELSE lines END END AS prompt,
    CASE WHEN blank OR conv_id % 3 = 0 THEN 128 ELSE conv_id % 40 + 1 END AS max_tokens,
    CASE WHEN blank OR conv_id % 3 = 0 THEN 0.7::DOUBLE ELSE (conv_id % 3 - 1)::DOUBLE END
      AS temperature,
    flagged OR (NOT blank AND conv_id % 4 = 0) AS stream
  FROM asked),
accepted AS (SELECT * FROM parsed WHERE route <> '/v1/embeddings' AND NOT bad)"""

ANSWERED = """
word_lists AS (SELECT regexp_extract_all(text, '\\S+') AS ws FROM conversations),
steps AS (
  SELECT unnest(ws[1:len(ws) - 1]) AS w, unnest(ws[2:]) AS nxt FROM word_lists WHERE len(ws) > 1),
step_counts AS (SELECT w, nxt, count(*) AS n FROM steps GROUP BY w, nxt),
succ AS (
  SELECT w, nxt FROM (
    SELECT w, nxt, row_number() OVER (PARTITION BY w ORDER BY n DESC, nxt) AS r FROM step_counts)
  WHERE r = 1),
prompt_words AS (
  SELECT id, max_tokens, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT request_id AS id, max_tokens, regexp_extract_all(prompt, '\\S+') AS ws FROM accepted)),
starts AS (
  SELECT id, max_tokens, arg_max(p.w, i) AS w
  FROM prompt_words p JOIN succ USING (w) GROUP BY id, max_tokens),
walk AS (
  SELECT id, max_tokens, w, 0 AS k FROM starts
  UNION ALL
  SELECT walk.id, walk.max_tokens, succ.nxt, walk.k + 1
  FROM walk JOIN succ ON succ.w = walk.w WHERE walk.k < walk.max_tokens),
told AS (SELECT id, string_agg(w, ' ' ORDER BY k) AS answer FROM walk WHERE k > 0 GROUP BY id),
answered AS (
  SELECT a.* EXCLUDE (answer), COALESCE(t.answer, '') AS answer
  FROM accepted a LEFT JOIN told t ON t.id = a.request_id)"""

METRICS = """
log AS (
  SELECT user_id AS run_id, iter, (iter - 1) // 5 AS epoch,
    CASE WHEN event_type = 'error' THEN 'val' ELSE 'train' END AS kind,
    CASE WHEN event_type = 'error' THEN CASE event_id % 41 WHEN 1 THEN NULL WHEN 2 THEN 'nan'::DOUBLE
      WHEN 3 THEN 'inf'::DOUBLE ELSE value * 0.5::DOUBLE END ELSE value * 0.02::DOUBLE END AS loss,
    json_extract_string(props, '$.k')::BIGINT AS tokens, epoch_us(ts) AS us
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iter
        FROM events))"""

BEST = METRICS + """,
best AS (
  SELECT run_id, COALESCE(min(loss) FILTER (WHERE isfinite(loss)), 'inf'::DOUBLE) AS best_val,
    COALESCE(first(iter ORDER BY loss, iter) FILTER (WHERE isfinite(loss)), -1) AS best_iter
  FROM log WHERE kind = 'val' GROUP BY run_id)"""

VERDICT = BEST + """,
near AS (
  SELECT run_id, loss AS train_loss FROM (
    SELECT l.run_id, l.loss, row_number() OVER (
      PARTITION BY l.run_id ORDER BY abs(l.iter - b.best_iter), l.iter) AS r
    FROM log l JOIN best b USING (run_id) WHERE l.kind = 'train') WHERE r = 1),
verdicts AS (
  SELECT run_id, best_iter, best_val, train_loss, best_val - train_loss AS gap,
    CASE WHEN best_val - train_loss < 0.5 THEN 'healthy'
      WHEN best_val - train_loss < 1.0 THEN 'watch' ELSE 'OVERFIT RISK' END AS verdict
  FROM best JOIN near USING (run_id))"""

ANSWERS = """
named AS (
  SELECT c.*, n.n_name AS gold, 'NATION_' || ((c.c_nationkey + 1) % 25) AS other
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
kinds AS (
  SELECT 'base' AS run_id, c_custkey % 5 AS k, * FROM named
  UNION ALL
  SELECT 'fine-tuned', CASE WHEN c_custkey % 7 < 4 THEN 0 ELSE c_custkey % 5 END, * FROM named),
answers AS (
  SELECT run_id, c_custkey AS seq, gold, c_mktsegment AS model,
    (c_custkey % 10 + 1) / 100 AS seconds,
    CASE k WHEN 0 THEN gold WHEN 1 THEN lower(replace(gold, '_', '-')) || '.'
      WHEN 2 THEN gold || ' or ' || other WHEN 3 THEN 'no idea' ELSE other END AS raw
  FROM kinds),
labels_n AS (
  SELECT DISTINCT gold AS label, trim(regexp_replace(lower(translate(gold, '_-', '  ')),
    '\\s+', ' ', 'g')) AS norm FROM answers),
hits AS (
  SELECT a.run_id, a.seq, l.label, l.norm FROM answers a JOIN labels_n l
    ON contains(trim(regexp_replace(lower(translate(a.raw, '_-', '  ')), '\\s+', ' ', 'g')),
                l.norm)),
tops AS (
  SELECT h.run_id, h.seq, h.label FROM hits h WHERE NOT EXISTS (
    SELECT 1 FROM hits o WHERE o.run_id = h.run_id AND o.seq = h.seq
      AND o.label <> h.label AND contains(o.norm, h.norm))),
found AS (
  SELECT run_id, seq, min(label) AS pred FROM tops GROUP BY run_id, seq HAVING count(*) = 1),
scored AS (
  SELECT a.*, f.pred, COALESCE(f.pred = a.gold, false) AS ok
  FROM answers a LEFT JOIN found f USING (run_id, seq))"""


def _report(by: str) -> str:
    return f"""
golds AS (SELECT {by}, gold, count(*) AS g FROM scored GROUP BY {by}, gold),
majority AS (SELECT {by}, max(g) AS m FROM golds GROUP BY {by}),
report AS (
  SELECT {by}, count(*)::BIGINT AS n, count(*) FILTER (WHERE ok)::BIGINT AS correct,
    count(*) FILTER (WHERE pred IS NULL)::BIGINT AS unparseable, sum(seconds) AS seconds,
    max(m) AS m FROM scored JOIN majority USING ({by}) GROUP BY {by})"""


LABELLED = f"""
joined AS (
  SELECT d.doc_id AS seq, d.text, d.lang, l.quality
  FROM documents d JOIN labels l USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (ORDER BY {_hash(1, 'seq')}) AS r, count(*) OVER () AS n
  FROM joined),
labelled AS (SELECT *, r <= greatest(1, trunc(n * 0.25::DOUBLE)::BIGINT) AS in_val FROM placed)"""

SAMPLED = LABELLED + f""",
sampled AS (
  SELECT *, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS body,
    row_number() OVER (PARTITION BY in_val ORDER BY {_hash(0, 'seq')}) AS pick
  FROM labelled),
chosen AS (
  SELECT *, CASE WHEN in_val THEN 'test' ELSE 'train' END AS split FROM sampled
  WHERE pick <= CASE WHEN in_val THEN 80 ELSE 200 END)"""

QUALITY_PROMPT = ("'Classify the emotion expressed in this text as one of: low, high.' || "
                  "E'\\n\\nText: ' || body || E'\\n\\nAnswer with one word.'")
QUALITY_LABEL = "CASE quality WHEN 0 THEN 'low' WHEN 1 THEN 'high' END"

# Next-fit as a row-by-row recursion; blocks are numbered as they are closed.
PACKED = """
todo AS (
  SELECT record_id, seq, length, row_number() OVER (ORDER BY seq) AS i, length >= 512 AS is_full
  FROM lens WHERE length > 0),
small AS (SELECT *, row_number() OVER (ORDER BY seq) AS j FROM todo WHERE NOT is_full),
fold AS (
  SELECT j, i, record_id, length, 0 AS block, 0 AS pos, length AS fill
  FROM small WHERE j = 1
  UNION ALL
  SELECT s.j, s.i, s.record_id, s.length,
    CASE WHEN f.fill + s.length > 512 THEN f.block + 1 ELSE f.block END,
    CASE WHEN f.fill + s.length > 512 THEN 0 ELSE f.fill END,
    CASE WHEN f.fill + s.length > 512 THEN s.length ELSE f.fill + s.length END
  FROM fold f JOIN small s ON s.j = f.j + 1),
opened AS (SELECT block, min(i) AS first_i FROM fold GROUP BY block),
closed AS (
  SELECT o.block AS block, NULL::BIGINT AS record_id, n.first_i AS at_row
  FROM opened o LEFT JOIN opened n ON n.block = o.block + 1
  UNION ALL
  SELECT NULL, record_id, i FROM todo WHERE is_full),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY at_row NULLS LAST, block) - 1 AS block_id FROM closed),
segments AS (
  SELECT n.block_id, f.record_id, f.pos AS "offset", f.length AS len
  FROM fold f JOIN numbered n ON n.block = f.block
  UNION ALL
  SELECT n.block_id, t.record_id, 0, t.length
  FROM numbered n JOIN todo t ON t.record_id = n.record_id WHERE n.block IS NULL)"""

KEPT_LENS = FILTERED + """,
lens AS (SELECT record_id, seq, length FROM kept)"""

ANALYSIS = """
by_length AS (
  SELECT length, row_number() OVER (ORDER BY length, seq) - 1 AS rank, count(*) OVER () AS n
  FROM lens),
chunks AS (SELECT rank // 4 AS b, max(length) * count(*) AS cost FROM by_length GROUP BY 1),
sums AS (
  SELECT count(*)::BIGINT AS examples, sum(length)::BIGINT AS real_tokens,
    max(CASE WHEN rank = n // 2 THEN length END)::BIGINT AS p50_len,
    max(CASE WHEN rank = least(n - 1, trunc(n * 0.9::DOUBLE)::BIGINT) THEN length END)::BIGINT
      AS p90_len,
    max(length)::BIGINT AS max_len_seen, (count(*) * max(length))::BIGINT AS naive_tokens,
    (SELECT sum(cost) FROM chunks)::BIGINT AS bucket_tokens,
    ceil(sum(length) / 512)::BIGINT * 512 AS pack_tokens
  FROM by_length),
analysis AS (
  SELECT *, real_tokens / naive_tokens AS useful_naive, real_tokens / bucket_tokens
    AS useful_bucket, real_tokens / pack_tokens AS useful_pack,
    (real_tokens / pack_tokens) / (real_tokens / bucket_tokens) AS gain FROM sums),
choice AS (
  SELECT *, CASE WHEN gain > 1.15 AND p90_len < 256 THEN 'pack' ELSE 'bucket' END AS strategy
  FROM analysis)"""

# --- records -------------------------------------------------------------------

_ORACLES["normalize_sft"] = _with(_norm(False)) + "SELECT * FROM norm"

_ORACLES["load_sft_jsonl"] = _with(_norm(False), """
lines AS (SELECT record_id, row_number() OVER (ORDER BY record_id) - 1 AS seq FROM raw)""") + """
SELECT l.seq, n.kind, n.prompt, n.completion, n.text FROM norm n JOIN lines l USING (record_id)"""

_ORACLES["load_parquet_records"] = """
SELECT doc_id AS seq, 'text' AS kind, md5(text) AS text_md5 FROM documents"""

_ORACLES["render_sft"] = _with(TRAINING) + """
SELECT record_id, kind, md5(rendered) AS rendered_md5, length(rendered)::BIGINT AS n_chars
FROM shown"""

_ORACLES["render_chat_plain"] = _with(CHAT) + "SELECT record_id, lines AS rendered FROM lined"
_ORACLES["render_chat_instruct"] = _with(CHAT) + """
SELECT record_id, instruct AS rendered FROM styled"""

_ORACLES["coerce_shape"] = _with(_raw(False)) + """
SELECT record_id, CASE WHEN prompt IS NOT NULL AND completion IS NOT NULL THEN 'pair'
  WHEN text IS NOT NULL THEN 'text' ELSE 'json' END AS shape,
  CASE WHEN prompt IS NULL OR completion IS NULL THEN text END AS text
FROM raw"""

_ORACLES["messages_to_pairs"] = _with(CHAT, """
cut AS (
  SELECT *, list_max(list_transform(range(1, len(roles) + 1),
    lambda i: CASE WHEN roles[i] = 'assistant' THEN i END)) AS last FROM lined),
heads AS (
  SELECT *, array_to_string(list_transform(range(1, last),
    lambda i: roles[i] || ': ' || texts[i]), E'\\n') AS head_lines FROM cut)""") + """
SELECT record_id, CASE WHEN last > 1 THEN CASE WHEN last = 2 AND roles[1] = 'user'
    THEN E'### Instruction:\\n' || texts[1] || E'\\n\\n### Response:\\n'
    ELSE head_lines || E'\\nassistant:' END END AS prompt,
  CASE WHEN last > 1 THEN texts[last] END AS completion
FROM heads"""

# --- lengths -------------------------------------------------------------------

_ORACLES["filter_for_training"] = _with(FILTERED) + """
SELECT record_id, kind, p AS prompt_tokens, c AS completion_tokens, drop_reason,
  drop_reason IS NULL AND kind = 'pair' AND p + c >= 512 AS eos_truncated
FROM filtered"""

_ORACLES["filter_stats"] = _with(FILTERED) + """
SELECT count(*) FILTER (WHERE drop_reason IS NULL) AS kept,
  count(*) FILTER (WHERE drop_reason = 'prompt_too_long') AS dropped_prompt_too_long,
  count(*) FILTER (WHERE drop_reason IN ('over_length', 'too_short')) AS dropped_over_length,
  count(*) AS total,
  count(*) FILTER (WHERE drop_reason IS NULL AND kind = 'pair' AND p + c >= 512) AS eos_truncated
FROM filtered"""

_ORACLES["count_tokens"] = _with(TRAINING) + f"""
SELECT sum({_words('rendered')})::BIGINT AS total_tokens FROM shown"""

_ORACLES["count_bytes"] = _with(TRAINING) + """
SELECT sum(strlen(rendered))::BIGINT AS total_tokens FROM shown"""

_ORACLES["plugin_token_counts"] = f"""
SELECT doc_id, {_words('text')} AS n_tokens,
  COALESCE(list_sum([length(w) FOR w IN regexp_extract_all(text, '\\S+')]), 0)::BIGINT AS id_sum
FROM documents"""
_ORACLES["mask_by_offsets"] = _with(CHAT) + f"""
SELECT record_id, {_words('lines')} AS n_tokens,
  COALESCE(list_sum([CASE WHEN roles[i] = 'assistant' THEN {_words('texts[i]')} ELSE 0 END
    FOR i IN range(1, len(roles) + 1)]), 0)::BIGINT AS n_loss
FROM lined"""
_ORACLES["coerce_lines"] = """
SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'broken' WHEN p_partkey % 4 = 1 THEN 'text'
    WHEN p_partkey % 4 = 2 THEN 'pair' ELSE 'json' END AS shape,
  CASE WHEN p_partkey % 10 = 0 OR p_partkey % 4 = 2 THEN NULL WHEN p_partkey % 4 = 1 THEN p_name
    ELSE CASE WHEN p_partkey % 4 = 3
      THEN json_object('brand', p_brand, 'extra', json_object('ids', [p_size, p_partkey], 'size', p_size),
        'p_partkey', p_partkey, 'prompt', p_name)::VARCHAR
      ELSE json_object('brand', p_brand, 'extra', json_object('ids', [p_size, p_partkey], 'size', p_size),
        'p_partkey', p_partkey)::VARCHAR END END AS text
FROM part"""

_ORACLES["packing_stats"] = _with(FILTERED) + """
SELECT n AS examples, r AS real_tokens, n * 512 AS naive_padded_tokens, k AS packed_tokens,
  round(100 * (1 - r / (n * 512)), 6) AS waste_naive_pct,
  round(100 * (1 - r / k), 6) AS waste_packed_pct, round(n * 512 / k, 6) AS speedup_vs_naive
FROM (SELECT count(*)::BIGINT AS n, sum(length)::BIGINT AS r,
        ceil(sum(length) / 512)::BIGINT * 512 AS k FROM kept)"""

_ORACLES["analyze_lengths"] = _with(KEPT_LENS, ANALYSIS) + """
SELECT examples, real_tokens, p50_len, p90_len, max_len_seen, naive_tokens, bucket_tokens,
  pack_tokens, round(useful_naive, 6) AS useful_naive, round(useful_bucket, 6) AS useful_bucket,
  round(useful_pack, 6) AS useful_pack, round(gain, 6) AS pack_gain_over_bucket, strategy
FROM choice"""

# --- batches -------------------------------------------------------------------

_ORACLES["mask_labels"] = _with(FILTERED) + """
SELECT record_id, p AS prompt_len, length, least(p, length) AS n_masked, length AS n_labels,
  kind = 'pair' AND p + c < 512 AS ends_with_eos
FROM kept"""

_BATCH_COLUMNS = "record_id, batch_id, pos_in_batch, length, width"

_ORACLES["plain_batches"] = _with(DOC_LENGTHS, _batched("lens", "seq")) + f"""
SELECT {_BATCH_COLUMNS} FROM batched"""
_ORACLES["plain_batches_shuffled"] = _with(
    DOC_LENGTHS, _batched("lens", _hash(3, "seq"))) + f"SELECT {_BATCH_COLUMNS} FROM batched"
_ORACLES["bucket_batches"] = _with(DOC_LENGTHS, _batched("lens", "length, seq")) + f"""
SELECT {_BATCH_COLUMNS} FROM batched"""

BATCH_ORDER = f"""
ordered AS (
  SELECT batch_id, row_number() OVER (ORDER BY {_hash(5, 'batch_id')}) - 1 AS batch_order
  FROM (SELECT DISTINCT batch_id FROM batched))"""

_ORACLES["shuffled_batches"] = _with(
    DOC_LENGTHS, _batched("lens", "length, seq"), BATCH_ORDER) + """
SELECT record_id, batch_id, batch_order, pos_in_batch, width
FROM batched JOIN ordered USING (batch_id)"""

_PADDED_COLUMNS = """record_id, batch_id, pos_in_batch, width, width AS n_labels,
  length AS n_real, least(p, length) + width - length AS n_ignored"""

_ORACLES["pad_batches"] = _with(FILTERED, _batched("kept", "seq")) + f"""
SELECT {_PADDED_COLUMNS} FROM batched"""
_ORACLES["batch_files"] = _with(FILTERED, _batched("kept", "length, seq"), BATCH_ORDER) + f"""
SELECT batch_order, {_PADDED_COLUMNS} FROM batched JOIN ordered USING (batch_id)"""
_ORACLES["batches_from"] = _ORACLES["batch_files"] + """
WHERE batch_order >= (SELECT max(batch_order) // 2 FROM ordered)"""

_ORACLES["pad_left_batches"] = _with(PAIRS, f"""
lens AS (SELECT record_id, record_id AS seq, least({_words('q')}, 128) AS length FROM pairs)""",
                                     _batched("lens", "seq", 8)) + """
SELECT record_id, batch_id, width, width - length AS n_pad, length > 0 AS ends_real
FROM batched"""

_ORACLES["pack_sequences"] = _with(DOC_LENGTHS, PACKED) + """
SELECT block_id, record_id, "offset", len FROM segments"""

_ORACLES["packed_blocks"] = _with(KEPT_LENS, PACKED) + """
SELECT s.block_id, sum(len)::BIGINT AS n_tokens, count(*) AS n_examples,
  sum(len * (len - 1) // 2)::BIGINT AS position_sum,
  sum(least(k.p, len))::BIGINT AS n_masked,
  string_agg(s.record_id || ':' || "offset" || ':' || len, ',' ORDER BY "offset") AS layout
FROM segments s JOIN kept k USING (record_id) GROUP BY s.block_id"""

_ORACLES["packing_info"] = _with(KEPT_LENS, PACKED) + """
SELECT count(DISTINCT block_id) AS actual_blocks,
  ceil(sum(len) / 512)::BIGINT AS estimated_blocks, sum(len)::BIGINT AS used_tokens
FROM segments"""

_ORACLES["adaptive_batches"] = _with(
    KEPT_LENS, ANALYSIS, PACKED, _batched("lens", "length, seq"), """
blocks AS (SELECT block_id, sum(len) AS length FROM segments GROUP BY block_id)""") + """
SELECT strategy, batch_id, pos_in_batch, length, width FROM batched, choice
WHERE strategy = 'bucket'
UNION ALL
SELECT strategy, block_id // 4, block_id % 4, length,
  max(length) OVER (PARTITION BY block_id // 4) FROM blocks, choice WHERE strategy = 'pack'"""

_ORACLES["prepare_training"] = _with(FILTERED, f"""
drawn AS (
  SELECT *, row_number() OVER (ORDER BY {_hash(0, 'seq')}) AS r, count(*) OVER () AS n FROM kept),
sides AS (
  SELECT *, CASE WHEN r <= least(n - 1, greatest(1,
    CASE WHEN n > 10 THEN trunc(n * 0.1::DOUBLE)::BIGINT ELSE n // 5 END))
    THEN 'val' ELSE 'train' END AS side FROM drawn)""") + """
SELECT side, count(*) AS examples, sum(length)::BIGINT AS real_tokens FROM sides GROUP BY side"""

# --- caps, samples, splits -----------------------------------------------------

_ORACLES["head_cap"] = "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 250"
_ORACLES["sample_exact"] = f"""
SELECT doc_id, lang FROM documents ORDER BY {_hash(7, 'doc_id')} LIMIT 300"""

SPLIT = f"""
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY {_hash(0, 'doc_id')}) AS r, count(*) OVER () AS n
  FROM documents),
split AS (
  SELECT doc_id, r <= least(n - 1, greatest(1,
    CASE WHEN n > 10 THEN trunc(n * 0.1::DOUBLE)::BIGINT ELSE n // 5 END)) AS in_val
  FROM placed)"""

_ORACLES["train_val_split"] = _with(SPLIT) + """
SELECT doc_id, in_val, NOT in_val AS in_train FROM split"""
_ORACLES["shuffle"] = f"""
SELECT doc_id, row_number() OVER (ORDER BY {_hash(2, 'doc_id')}) - 1 AS position
FROM documents"""
_ORACLES["amplify"] = _with("""
size AS (SELECT count(*) AS n FROM documents),
doubled AS (
  SELECT 1::BIGINT AS copies UNION ALL
  SELECT copies * 2 FROM doubled, size WHERE copies * n < 50000)""") + """
SELECT doc_id, unnest(range((SELECT max(copies) FROM doubled)))::BIGINT AS copy FROM documents"""

# --- classification tasks ------------------------------------------------------

_ORACLES["build_task"] = _with(SAMPLED) + f"""
SELECT split, seq, {QUALITY_PROMPT} AS prompt,
  CASE WHEN split = 'train' THEN {QUALITY_LABEL} END AS completion,
  CASE WHEN split = 'test' THEN {QUALITY_LABEL} END AS gold
FROM chosen"""

_ORACLES["build_task_named_labels"] = _with(SAMPLED, """
names AS (
  SELECT string_agg('- ' || lang, E'\\n' ORDER BY lang) AS lines
  FROM (SELECT DISTINCT lang FROM labelled WHERE NOT in_val))""") + """
SELECT split, seq, 'Classify this banking customer message as one of the following intents:'
  || E'\\n' || lines || E'\\n\\nMessage: ' || body
  || E'\\n\\nAnswer with one intent name exactly as written above.' AS prompt,
  CASE WHEN split = 'train' THEN lang END AS completion,
  CASE WHEN split = 'test' THEN lang END AS gold
FROM chosen, names"""

_ORACLES["task_split_files"] = _with(SAMPLED) + f"""
SELECT {QUALITY_LABEL} AS gold, md5({QUALITY_PROMPT}) AS prompt_md5
FROM chosen WHERE split = 'test'"""

_ORACLES["label_distribution"] = f"""
SELECT {QUALITY_LABEL} AS label, count(*) AS n FROM documents JOIN labels USING (doc_id)
GROUP BY 1"""

_ORACLES["majority_baseline"] = """
SELECT sum(c)::BIGINT AS n, max(c)::BIGINT AS majority_n,
  round(max(c) / sum(c), 6) AS majority_baseline
FROM (SELECT lang, count(*) AS c FROM documents GROUP BY lang)"""

_ORACLES["label_vocabulary"] = _with(ANSWERS) + "SELECT DISTINCT gold AS label FROM answers"

# --- scoring -------------------------------------------------------------------

_ORACLES["match_labels"] = _with(ANSWERS) + "SELECT run_id, seq, gold, pred FROM scored"
_ORACLES["match_labels_large_vocabulary"] = _ORACLES["match_labels"]

_ORACLES["evaluate_run"] = _with(ANSWERS, _report("run_id")) + """
SELECT run_id, n, correct, unparseable, round(correct / n, 6) AS accuracy,
  round(m / n, 6) AS majority_baseline, round(seconds, 6) AS seconds,
  round(n / seconds, 6) AS examples_per_s
FROM report"""

_ORACLES["eval_report"] = _with(ANSWERS) + """
SELECT run_id, count(*) FILTER (WHERE ok) AS correct, count(*) AS n,
  count(*) FILTER (WHERE pred IS NULL) AS nulls,
  sum(length(substr(raw, 1, 80)))::BIGINT AS raw_chars
FROM scored GROUP BY run_id"""

_ORACLES["nested_report"] = _with(ANSWERS) + """
SELECT run_id, count(*) AS n, md5(string_agg(
  gold || '|' || COALESCE(pred, '-') || '|' || substr(raw, 1, 80), ';' ORDER BY seq)) AS digest
FROM scored GROUP BY run_id"""

_ORACLES["prediction_distribution"] = _with(ANSWERS) + """
SELECT run_id, pred, count(*) AS n FROM scored GROUP BY run_id, pred"""

_ORACLES["prediction_counts"] = _with(ANSWERS) + """
SELECT run_id, string_agg(label || '=' || n, ',' ORDER BY label) AS counts
FROM (SELECT run_id, COALESCE(pred, '<none>') AS label, count(*) AS n
      FROM scored GROUP BY run_id, pred)
GROUP BY run_id"""

_ORACLES["running_accuracy"] = _with(ANSWERS, """
sofar AS (
  SELECT run_id, row_number() OVER w AS i,
    sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS correct
  FROM scored WINDOW w AS (PARTITION BY run_id ORDER BY seq))""") + """
SELECT run_id, i, correct::BIGINT AS correct, round(correct / i, 6) AS accuracy
FROM sofar WHERE i % 50 = 0"""

_ORACLES["compare_runs"] = _with(ANSWERS, _report("model, run_id"), """
sides AS (
  SELECT model,
    max(correct / n) FILTER (WHERE run_id = 'base') AS base,
    max(correct / n) FILTER (WHERE run_id = 'fine-tuned') AS tuned,
    max(m / n) FILTER (WHERE run_id = 'base') AS base_m,
    max(m / n) FILTER (WHERE run_id = 'fine-tuned') AS tuned_m
  FROM report GROUP BY model)""") + """
SELECT model, 'nation' AS task, round(base, 6) AS base, round(tuned, 6) AS tuned,
  round(tuned - base, 6) AS gain, base < base_m AS base_below_majority,
  tuned < tuned_m AS tuned_below_majority
FROM sides"""

# --- training runs -------------------------------------------------------------

_ORACLES["training_plan"] = _with(SPLIT, """
sizes AS (
  SELECT count(*) FILTER (WHERE NOT in_val) AS n_train, count(*) FILTER (WHERE in_val) AS n_val
  FROM split),
steps AS (SELECT *, ceil(n_train / 4)::BIGINT AS batches FROM sizes),
iterations AS (SELECT *, greatest(1, 3 * batches) AS iters FROM steps)""") + """
SELECT n_train, n_val, batches, ceil(batches / 4)::BIGINT * 3 AS planned_steps,
  (batches // 4) * 3 AS applied_steps, iters, greatest(1, iters // 10) AS report_every,
  greatest(1, iters // 6) AS eval_every, greatest(1, least(n_val, 20)) AS val_batches
FROM iterations"""

EPOCHS = METRICS + """,
epochs AS (
  SELECT run_id, epoch, avg(loss) AS mean_loss, sum(tokens)::BIGINT AS tokens,
    count(*) AS micro_batches, (max(us) - min(us)) / 1000000 AS seconds, min(us) AS t0,
    count(*) // 2 AS steps
  FROM log WHERE kind = 'train' GROUP BY run_id, epoch)"""

_ORACLES["epoch_summary"] = _with(EPOCHS) + """
SELECT run_id, epoch, round(mean_loss, 6) AS mean_loss, tokens, micro_batches,
  round(CASE WHEN seconds > 0 THEN tokens / seconds ELSE 0 END, 9) AS tokens_per_s
FROM epochs"""

_ORACLES["running_training_metrics"] = _with(EPOCHS, """
bases AS (
  SELECT run_id, epoch, t0, COALESCE(sum(steps) OVER (PARTITION BY run_id ORDER BY epoch
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM epochs),
moving AS (
  SELECT run_id, epoch, iter, us, row_number() OVER w AS i, avg(loss) OVER w AS loss,
    sum(tokens) OVER w AS seen
  FROM log WHERE kind = 'train' WINDOW w AS (PARTITION BY run_id, epoch ORDER BY iter))""") + """
SELECT run_id, epoch, (before + i // 2)::BIGINT AS step, iter, round(loss, 6) AS loss,
  seen::BIGINT AS seen_tokens,
  round(CASE WHEN us > t0 THEN seen / ((us - t0) / 1000000) ELSE 0 END, 9) AS tokens_per_s
FROM moving JOIN bases USING (run_id, epoch) WHERE i % 2 = 0"""

NEW_BEST = METRICS + """,
flagged AS (
  SELECT run_id, iter, loss, COALESCE(loss < COALESCE(min(loss) OVER (
    PARTITION BY run_id ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    'inf'::DOUBLE), false) AS is_best
  FROM (SELECT run_id, iter, CASE WHEN isfinite(loss) THEN loss END AS loss
        FROM log WHERE kind = 'val'))"""

_ORACLES["new_best_flag"] = _with(NEW_BEST) + """
SELECT run_id, iter, round(loss, 6) AS loss, is_best FROM flagged"""

_ORACLES["best_checkpoint"] = _with(BEST) + """
SELECT r.run_id, round(COALESCE(best_val, 'inf'::DOUBLE), 6) AS best_val,
  COALESCE(best_iter, -1) AS best_iter
FROM (SELECT DISTINCT run_id FROM log) r LEFT JOIN best USING (run_id)"""

_ORACLES["overfit_verdict"] = _with(VERDICT) + """
SELECT run_id, best_iter, round(best_val, 6) AS best_val, round(train_loss, 6) AS train_loss,
  round(gap, 6) AS gap, verdict FROM verdicts"""

_ORACLES["resume_point"] = _with(METRICS) + """
SELECT run_id, max(epoch)::BIGINT + 1 AS start_epoch FROM log GROUP BY run_id"""

_ORACLES["speedup_vs_baseline"] = """
WITH rates AS (
  SELECT user_id AS bench, event_type AS name, min(event_id) AS pos,
    sum(json_extract_string(props, '$.k')::BIGINT) / count(*) AS rate
  FROM events GROUP BY 1, 2),
based AS (SELECT *, first_value(rate) OVER (PARTITION BY bench ORDER BY pos) AS base FROM rates)
SELECT bench, name, pos, round(rate, 6) AS tokens_per_s,
  round(CASE WHEN base > 0 THEN rate / base ELSE 1 END, 6) AS speedup
FROM based"""

_ORACLES["run_manifests"] = _with(VERDICT, """
size AS (SELECT run_id, count(*) AS rows FROM log GROUP BY run_id),
points AS (
  SELECT run_id, count(*) AS points FROM log JOIN size USING (run_id)
  WHERE iter % greatest(1, rows // 10) = 0 GROUP BY run_id)""") + """
SELECT 'run-' || s.run_id AS model,
  CASE WHEN v.verdict IN ('healthy', 'watch') THEN 'base' ELSE 'run-' || s.run_id END AS base_model,
  CASE v.verdict WHEN 'healthy' THEN NULL WHEN 'watch' THEN '4bit' ELSE 'none' END AS quant,
  CASE v.verdict WHEN 'healthy' THEN 'adapter' WHEN 'watch' THEN 'checkpoint' END AS format,
  CASE WHEN v.verdict IN ('healthy', 'watch') THEN '2024-01-02T03:04:05' END AS created,
  CASE WHEN v.verdict = 'healthy' THEN s.rows END AS n_train,
  CASE WHEN v.verdict = 'healthy' THEN 'healthy' END AS overfit_verdict,
  CASE WHEN v.verdict = 'healthy' THEN round(v.best_val, 6) END AS final_val_loss,
  CASE WHEN v.verdict = 'healthy' THEN COALESCE(p.points, 0) ELSE 0 END::BIGINT AS points
FROM size s LEFT JOIN verdicts v USING (run_id) LEFT JOIN points p USING (run_id)"""

# --- models --------------------------------------------------------------------

_ORACLES["enrich_models"] = """
WITH named AS (
  SELECT p_partkey, CASE WHEN p_partkey % 10 < 3
    THEN ['phi-3', 'llama-3-1b', 'llama-3-3b', 'qwen-1.5b', 'gpt2'][p_partkey % 5 + 1]
    ELSE 'hub/' || p_brand || '-' || p_size || CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE 'k' END
      || CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '' END END AS name
  FROM part),
presets(alias, hf, params_b) AS (VALUES
  ('phi-3', 'microsoft/Phi-3-mini-4k-instruct', 3.8::DOUBLE),
  ('llama-3-1b', 'meta-llama/Llama-3.2-1B', 1.2), ('llama-3-3b', 'meta-llama/Llama-3.2-3B', 3.2),
  ('qwen-1.5b', 'Qwen/Qwen2.5-1.5B', 1.5), ('gpt2', 'gpt2', 0.124))
SELECT p_partkey, name, COALESCE(p.hf, name) AS hf,
  COALESCE(p.params_b, CASE WHEN contains(lower(name), '70b') THEN 70::DOUBLE
    WHEN contains(lower(name), '13b') THEN 13 WHEN contains(lower(name), '8b') THEN 8
    WHEN contains(lower(name), '7b') THEN 7 WHEN contains(lower(name), '3b') THEN 3.2
    WHEN contains(lower(name), '1b') THEN 1.2 WHEN contains(lower(name), '0.5b') THEN 0.5
    ELSE 1.5 END) AS params_b,
  COALESCE(p.alias, regexp_extract(rtrim(name, '/'), '([^/]*)$', 1)) AS alias
FROM named LEFT JOIN presets p ON p.alias = name"""

_ORACLES["clamp_context"] = """
SELECT p_partkey::VARCHAR AS model, p_partkey, (p_size * 100)::BIGINT AS requested_len,
  least(p_size * 100, CASE WHEN p_partkey % 3 = 0 THEN 2048 WHEN p_partkey % 4 < 2 THEN 1024
    ELSE p_size * 100 END)::BIGINT AS context_len
FROM part"""

# --- requests ------------------------------------------------------------------

_ORACLES["parse_requests"] = _with(REQUESTS) + """
SELECT request_id, kind, prompt, max_tokens, temperature, stream FROM accepted"""
_ORACLES["rejected_requests"] = _with(REQUESTS) + """
SELECT request_id, route,
  CASE WHEN route = '/v1/embeddings' THEN 'unknown route' ELSE 'bad request' END AS reason,
  CASE WHEN route = '/v1/embeddings' THEN 404 ELSE 400 END::BIGINT AS status
FROM parsed WHERE route = '/v1/embeddings' OR bad"""
_ORACLES["response_envelope"] = _with(REQUESTS, ANSWERED) + f"""
SELECT request_id, CASE WHEN kind = 'chat' THEN 'chatcmpl-' ELSE 'cmpl-' END
    || substr(md5(request_id), 1, 8) AS id,
  CASE WHEN kind = 'chat' THEN 'chat.completion' ELSE 'text_completion' END AS object,
  1700000000::BIGINT AS created, answer,
  CASE WHEN kind = 'chat' THEN {_words('answer')} END AS completion_tokens
FROM answered"""

# --- streams: the final state equals the batch result --------------------------

_ORACLES["stream_best_checkpoint"] = _with(BEST) + """
SELECT run_id, round(best_val, 6) AS best_val, best_iter FROM best WHERE best_iter >= 0"""
_ORACLES["stream_new_best_events"] = _with(NEW_BEST) + """
SELECT run_id, iter, round(loss, 6) AS val_loss FROM flagged WHERE is_best"""
_ORACLES["stream_progress"] = _with(EPOCHS) + """
SELECT run_id, epoch, round(mean_loss, 6) AS mean_loss, tokens,
  round(CASE WHEN seconds > 0 THEN tokens / seconds ELSE 0 END, 9) AS tokens_per_s
FROM epochs"""
_ORACLES["stream_running_accuracy"] = _with(ANSWERS) + """
SELECT run_id, count(*) AS n, count(*) FILTER (WHERE ok) AS correct,
  round(count(*) FILTER (WHERE ok) / count(*), 6) AS accuracy
FROM scored GROUP BY run_id"""
_ORACLES["stream_prepare"] = _with(FILTERED) + """
SELECT record_id, p AS prompt_len, length, least(p, length) AS n_masked FROM kept
WHERE record_id >= 0"""

_ORACLES["stream_prepare_lines"] = _with(FILTERED) + """
SELECT record_id, p AS prompt_len, length, least(p, length) AS n_masked FROM kept
WHERE record_id >= 0 AND record_id % 7 <> 3"""
_ORACLES["stream_prepare_rejects"] = _with(_raw(True)) + """
SELECT record_id, true AS has_line FROM raw WHERE record_id % 7 = 3"""

# --- text ----------------------------------------------------------------------

_ORACLES["word_counts"] = r"""
SELECT doc_id, len(regexp_extract_all(replace(text, 'e', chr(160)),
  '[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'
  ))::BIGINT AS n_words
FROM documents"""
_ORACLES["last_segments"] = """
SELECT p_partkey, CASE WHEN p_partkey % 10 < 3
  THEN ['phi-3', 'llama-3-1b', 'llama-3-3b', 'qwen-1.5b', 'gpt2'][p_partkey % 5 + 1]
  WHEN p_partkey % 3 = 0 THEN ''
  ELSE p_brand || '-' || p_size || CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE 'k' END END AS tail
FROM part"""

_ORACLES["observed_filter"] = _ORACLES["stream_observed_filter"] = _ORACLES["filter_stats"]
_ORACLES["cut_completion"] = f"""
SELECT doc_id, least({_words('text')}, greatest(doc_id % 40 - 1, 0))::BIGINT AS n_tokens
FROM documents"""
_ORACLES["chat_training_records"] = f"""
SELECT record_id, 'chat' AS kind, prompt, completion FROM ({_ORACLES["messages_to_pairs"]})
WHERE prompt IS NOT NULL AND completion IS NOT NULL"""
_ORACLES["packed_blocks_masked"] = _with(KEPT_LENS, PACKED) + """
SELECT s.block_id,
  sum(greatest(least(k.p, len), CASE WHEN "offset" > 0 THEN 1 ELSE 0 END))::BIGINT AS n_masked
FROM segments s JOIN kept k USING (record_id) GROUP BY s.block_id"""
_ORACLES["forced_packing"] = _with(KEPT_LENS, PACKED, """
blocks AS (SELECT block_id, sum(len)::BIGINT AS length FROM segments GROUP BY block_id)""") + """
SELECT block_id // 4 AS batch_id, block_id % 4 AS pos_in_batch, length,
  max(length) OVER (PARTITION BY block_id // 4) AS width FROM blocks"""
_ORACLES["forced_padding"] = _with(KEPT_LENS, _batched("lens", "seq")) + """
SELECT record_id, batch_id, pos_in_batch, length, width FROM batched"""
_ORACLES["ambiguous_labels"] = """
SELECT trim(regexp_replace(lower(translate(label, '_-', '  ')), '\\s+', ' ', 'g')) AS norm,
  count(*) AS labels
FROM (SELECT p_brand AS label FROM part
      UNION SELECT lower(p_brand) FROM part WHERE p_partkey % 2 = 0)
GROUP BY 1 HAVING count(*) > 1"""
