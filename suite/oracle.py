"""The registered queries as SQL over the same tables, for DuckDB."""

from __future__ import annotations

# Shared parts, put together with WITH.
CHAT = """chat AS (
  SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages,
         string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id)"""

EXCHANGES = """exchanges AS (
  SELECT q.conv_id, q.turn, q.text AS u, r.text AS a
  FROM (SELECT * FROM conversations WHERE role = 'user') q
  LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') r
    ON r.conv_id = q.conv_id AND r.turn = q.turn + 1),
next_replies AS (
  SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id)"""

PAIRS = EXCHANGES + """, pairs AS (
  SELECT p.conv_id, p.turn, p.u, p.a, r.a AS r,
         'user: ' || p.u AS asked,
         'user: ' || p.u || chr(10) || 'assistant: ' || p.a AS chosen,
         'user: ' || p.u || chr(10) || 'assistant: ' || r.a AS rejected,
         CAST(1 + length(p.a) % 5 AS DOUBLE) AS score_chosen,
         CAST(1 + length(r.a) % 5 AS DOUBLE) AS score_rejected
  FROM exchanges p JOIN next_replies r
    ON r.conv_id = (p.conv_id + 1) % (SELECT max(conv_id) + 1 FROM conversations)
  WHERE p.u IS NOT NULL AND p.a IS NOT NULL AND r.a IS NOT NULL)"""

GAPPY = EXCHANGES + """, gappy AS (
  SELECT p.conv_id, p.turn,
         CASE WHEN p.a IS NOT NULL THEN 'user: ' || coalesce(p.u, '') || chr(10) || 'assistant: ' || p.a END AS chosen,
         CASE WHEN r.a IS NOT NULL AND length(r.a) % 3 <> 0
              THEN 'user: ' || coalesce(p.u, '') || chr(10) || 'assistant: ' || r.a END AS rejected
  FROM exchanges p LEFT JOIN next_replies r
    ON r.conv_id = (p.conv_id + 1) % (SELECT max(conv_id) + 1 FROM conversations))"""

RAW = """raw AS (
  SELECT doc_id, doc_id % 7 AS m, CASE doc_id % 7
    WHEN 0 THEN to_json({'messages': [{'role': 'user', 'content': source}, {'role': 'assistant', 'content': text}]})::VARCHAR
    WHEN 1 THEN to_json({'prompt': source, 'chosen': text, 'rejected': lang})::VARCHAR
    WHEN 2 THEN to_json({'prompt': source, 'completion': text, 'label': n_chars % 2})::VARCHAR
    WHEN 3 THEN '[' || doc_id || ']'
    WHEN 4 THEN 'bad{'
    WHEN 5 THEN '{"other":1}'
    ELSE '{"messages":null,' || substr(to_json({'prompt': source, 'chosen': text, 'rejected': lang})::VARCHAR, 2)
  END AS t FROM documents),
items AS (SELECT doc_id, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM raw),
keyed AS (SELECT doc_id, j, CASE WHEN json_type(j) = 'OBJECT' THEN json_keys(j) END AS k FROM items),
typed AS (SELECT doc_id, j, k, CASE
    WHEN list_contains(k, 'messages') THEN 'sft'
    WHEN list_contains(k, 'chosen') AND list_contains(k, 'rejected') THEN 'dpo'
    WHEN list_contains(k, 'completion') AND list_contains(k, 'label') THEN 'kto' END AS type FROM keyed),
records AS (SELECT doc_id, type,
    CASE WHEN type IN ('dpo', 'kto') THEN j->>'prompt' END AS prompt,
    CASE WHEN type = 'dpo' THEN j->>'chosen' END AS chosen,
    CASE WHEN type = 'dpo' THEN j->>'rejected' END AS rejected,
    CASE WHEN type = 'kto' THEN j->>'completion' END AS completion,
    CASE WHEN type = 'kto' THEN CAST(j->>'label' AS INTEGER) END AS label,
    CASE type
      WHEN 'sft' THEN coalesce('user: ' || (j->'messages'->0->>'content') || chr(10)
                               || 'assistant: ' || (j->'messages'->1->>'content'), '')
      WHEN 'dpo' THEN 'Prompt: ' || (j->>'prompt') || chr(10) || 'Chosen: ' || (j->>'chosen') || chr(10)
                      || 'Rejected: ' || (j->>'rejected')
      ELSE 'Prompt: ' || (j->>'prompt') || chr(10) || 'Completion: ' || (j->>'completion') || chr(10)
           || 'Label: ' || (j->>'label') END AS text
  FROM typed WHERE type IS NOT NULL)"""

MEANS = """dims AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
dim_means AS (SELECT label, i, avg(x) AS x FROM dims GROUP BY label, i),
means AS (SELECT label, list(x ORDER BY i) AS mean FROM dim_means GROUP BY label)"""

TRIPLES = MEANS + """, cosines AS (
  SELECT e.vec_id, e.vec_id // 8 AS prompt_id,
         list_cosine_similarity(e.embedding::DOUBLE[], o.mean) AS own,
         list_cosine_similarity(e.embedding::DOUBLE[], n.mean) AS next
  FROM embeddings e JOIN means o ON o.label = e.label
  JOIN means n ON n.label = (e.label + 1) % (SELECT max(label) + 1 FROM embeddings)),
rewarded AS (
  SELECT vec_id, prompt_id, 2 * ((1 + vec_id % 5) * own - (1 + vec_id % 3) * next) AS reward FROM cosines)"""

RUN = "['sft', 'dpo', 'orpo', 'kto', 'grpo'][CAST(user_id % 5 + 1 AS INTEGER)] || '_' || user_id"

LOGS = f"""logs AS (
  SELECT user_id, {RUN} AS run, event_id AS pos, strftime(ts, '%Y-%m') AS month,
         CASE WHEN event_type IN ('click', 'view', 'signup') THEN value END AS loss,
         CASE WHEN event_type IN ('purchase', 'signup') THEN value END AS eval_loss,
         CASE WHEN event_type = 'error' THEN value END AS train_runtime
  FROM events)"""

LOG_METRICS = """
         min_by(loss, pos) FILTER (WHERE loss IS NOT NULL AND eval_loss IS NULL) AS initial_train_loss,
         max_by(loss, pos) FILTER (WHERE loss IS NOT NULL AND eval_loss IS NULL) AS final_train_loss,
         min(eval_loss) AS best_eval_loss,
         max_by(eval_loss, pos) FILTER (WHERE eval_loss IS NOT NULL) AS final_eval_loss,
         max_by(coalesce(train_runtime, 0), pos) AS training_time_seconds"""

FILES = f"""files AS (
  SELECT event_id, 'runs/' || {RUN} AS run, CASE
    WHEN event_type = 'signup' THEN CASE WHEN user_id % 3 = 0 THEN 'model.safetensors' ELSE 'adapter_config.json' END
    WHEN event_type = 'purchase' AND user_id % 20 < 6 THEN w
    WHEN event_type IN ('purchase', 'click') THEN folder || w
    ELSE folder || 'trainer_state.json' END AS rel_path
  FROM (SELECT *, CASE WHEN user_id % 7 = 3 THEN 'optimizer.pt' ELSE 'adapter_model.safetensors' END AS w,
               'checkpoint-' || ((event_id % 15 + 1) * 100) || '/' AS folder FROM events)),
checkpoints AS (
  SELECT run, split_part(rel_path, '/', 1) AS checkpoint,
         CAST(regexp_extract(rel_path, 'checkpoint-(\\d+)', 1) AS BIGINT) AS step
  FROM files WHERE rel_path LIKE 'checkpoint-%/%'),
adapters AS (
  SELECT run, CASE WHEN contains(rel_path, '/') THEN split_part(rel_path, '/', 1) END AS checkpoint,
         CASE WHEN contains(rel_path, '/') THEN CAST(regexp_extract(rel_path, 'checkpoint-(\\d+)', 1) AS BIGINT)
              ELSE -1 END AS step
  FROM files WHERE rel_path LIKE '%adapter_model.safetensors'),
newest AS (
  SELECT run, checkpoint, step, concat_ws('/', replace(run, 'runs/', ''), checkpoint) AS label,
         concat_ws('/', run, checkpoint) AS path
  FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY checkpoint IS NULL DESC, step DESC) AS rn FROM adapters)
  WHERE rn = 1),
inventory AS (
  SELECT * FROM (
    SELECT run, max(CASE WHEN rel_path = 'adapter_model.safetensors' THEN 1 ELSE 0 END) AS has_adapter,
           max(CASE WHEN rel_path IN ('model.safetensors', 'pytorch_model.bin') THEN 1 ELSE 0 END) AS has_model,
           max(CASE WHEN rel_path = 'adapter_config.json' THEN 1 ELSE 0 END) AS has_config
    FROM files GROUP BY run)
  WHERE has_adapter = 1 OR has_model = 1)"""

# Run folders: events by group ``g`` of ``groups``, their kind, and the states that count.
def run_tree(group: str) -> str:
    return f"""grouped AS (
  SELECT {group} AS g, ({group}) % 6 AS kind, event_id % 3 AS b, event_id,
         ['sft ', 'DPO_', 'orpo_', 'kto [x] ', 'grpo_', 'drafts_'][CAST(({group}) % 6 + 1 AS INTEGER)] || ({group}) AS run,
         CASE WHEN event_type IN ('click', 'view', 'signup') THEN value END AS loss,
         CASE WHEN event_type IN ('purchase', 'signup') THEN value END AS eval_loss,
         CASE WHEN event_type = 'error' THEN value END AS train_runtime
  FROM events),
last_folder AS (SELECT g, max(b) AS last FROM grouped GROUP BY g),
counted AS (
  SELECT x.*, event_id AS pos FROM grouped x JOIN last_folder USING (g)
  WHERE kind IN (0, 4) OR (b = last AND NOT (kind = 3 AND last = 2))),
state_metrics AS (
  SELECT run, {LOG_METRICS}, count(*) AS total_steps,
         CASE WHEN any_value(kind) IN (0, 4) THEN NULL ELSE 'checkpoint-' || ((any_value(b) + 8) * 100) END AS best_checkpoint
  FROM counted GROUP BY run)"""


RESULTS = f"""results AS (
  SELECT run, 'runs/' || run AS model_path,
         CASE WHEN user_id % 7 <> 0 THEN p END AS perplexity,
         CASE WHEN user_id % 5 <> 0 THEN t END AS test_loss,
         CASE WHEN user_id % 3 <> 0 THEN round(m / 100, 2) END AS preference_accuracy,
         p - t AS loss_margin, n AS total_steps
  FROM (SELECT user_id, {RUN} AS run, avg(value) FILTER (WHERE event_type = 'click') AS p,
               avg(value) FILTER (WHERE event_type = 'view') AS t,
               avg(value) FILTER (WHERE event_type = 'purchase') AS m, count(*) AS n
        FROM events GROUP BY user_id))"""

GENERATED = EXCHANGES + """, generated AS (
  SELECT 'run_' || conv_id AS run, turn // 2 AS pos, u AS prompt, coalesce(a, '') AS response
  FROM exchanges)"""


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


MODEL = f"""train AS (SELECT doc_id, lang AS run, {words('text')} AS toks FROM documents),
used AS (SELECT run, unnest(toks) AS token FROM train),
counts AS (SELECT run, token, count(*) AS c FROM used GROUP BY run, token),
totals AS (SELECT run, CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM counts GROUP BY run)"""

BASE = """base AS (SELECT token, CAST(sum(c) AS BIGINT) AS c FROM counts GROUP BY token),
base_total AS (SELECT sum(c) + count(*) + 1 AS d FROM base)"""

BIGRAMS = """bigrams AS (
  SELECT run, toks[i] AS ctx, toks[i + 1] AS token FROM (
    SELECT run, toks, unnest(range(1, len(toks))) AS i FROM train)),
bigram_counts AS (SELECT run, ctx, token, count(*) AS c2 FROM bigrams GROUP BY ALL),
contexts AS (SELECT run, ctx, sum(c2) AS cx FROM bigram_counts GROUP BY ALL),
model_pairs AS (
  SELECT b.run, b.ctx, b.token, b.c2 / x.cx AS ratio, c.c
  FROM bigram_counts b JOIN contexts x ON x.run = b.run AND x.ctx = b.ctx
  JOIN counts c ON c.run = b.run AND c.token = b.token)"""


def scored(samples: str, key: str, own: bool = False) -> str:
    """Per-sample losses (order 1) of ``samples(key, toks)`` under every run, or its own."""
    own_run = "s.run = t.run" if own else "TRUE"
    return f"""uses AS (SELECT {key}, {'run, ' if own else ''}unnest(toks) AS token FROM {samples}),
weighed AS (SELECT {key}, {'run, ' if own else ''}token, count(*) AS k FROM uses GROUP BY ALL),
losses AS (
  SELECT {key.replace('conv_id', 's.conv_id').replace('doc_id', 's.doc_id').replace('side', 's.side').replace('turn', 's.turn')}, t.run,
         sum(s.k * -ln((coalesce(c.c, 0) + 1) / (t.n + t.v + 1))) / sum(s.k) AS loss,
         CAST(sum(s.k) AS BIGINT) AS num_tokens
  FROM weighed s JOIN totals t ON {own_run}
  LEFT JOIN counts c ON c.run = t.run AND c.token = s.token
  GROUP BY ALL)"""


CHAT_WORDS = CHAT + f", samples AS (SELECT conv_id, {words('text')} AS toks FROM chat)"
PREFS = """preferred AS (
  SELECT conv_id, turn, run, max(loss) FILTER (WHERE side = 'chosen') AS chosen_loss,
         max(loss) FILTER (WHERE side = 'rejected') AS rejected_loss
  FROM losses GROUP BY conv_id, turn, run),
prefs AS (
  SELECT run, count(*) FILTER (WHERE chosen_loss < rejected_loss) / count(*) AS preference_accuracy,
         count(*) FILTER (WHERE chosen_loss < rejected_loss) AS preference_correct,
         count(*) AS preference_total, avg(chosen_loss) AS avg_chosen_loss, avg(rejected_loss) AS avg_rejected_loss,
         avg(rejected_loss) - avg(chosen_loss) AS loss_margin
  FROM preferred GROUP BY run)"""
SIDES = f"""sides AS (
  SELECT conv_id, turn, 'chosen' AS side, {words('chosen')} AS toks FROM pairs
  UNION ALL SELECT conv_id, turn, 'rejected', {words('rejected')} FROM pairs)"""
PERPLEXITY = """ppl AS (
  SELECT run, sum(loss * num_tokens) / sum(num_tokens) AS test_loss,
         exp(sum(loss * num_tokens) / sum(num_tokens)) AS perplexity, CAST(sum(num_tokens) AS BIGINT) AS num_tokens
  FROM chat_losses GROUP BY run)"""


# Word models of run folders: documents by source, and the loss of each word a test text uses, under the
# run's own counts or, for runs with an adapter config, half its own and half all documents'.
RUN_MODELS = f"""train AS (
  SELECT doc_id, ['sft ', 'DPO_', 'orpo_', 'kto [x] ', 'grpo_'][number % 5 + 1] || (number % 5) AS run, toks
  FROM (SELECT doc_id, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS number, {words('text')} AS toks FROM documents)),
used AS (SELECT run, unnest(toks) AS token FROM train),
counts AS (SELECT run, token, count(*) AS c FROM used GROUP BY run, token),
totals AS (SELECT run, CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM counts GROUP BY run), {BASE},
asked AS (
  SELECT DISTINCT token FROM (SELECT unnest(toks) AS token FROM samples UNION ALL SELECT unnest(toks) FROM sides)),
word_loss AS (
  SELECT t.run, a.token, -ln(CASE WHEN t.run[1:3] IN ('sft', 'kto', 'grp')
    THEN 0.5 * (coalesce(b.c, 0) + 1) / (SELECT d FROM base_total) + 0.5 * (coalesce(c.c, 0) + 1) / (t.n + t.v + 1)
    ELSE (coalesce(c.c, 0) + 1) / (t.n + t.v + 1) END) AS loss
  FROM asked a CROSS JOIN totals t LEFT JOIN counts c ON c.run = t.run AND c.token = a.token LEFT JOIN base b ON b.token = a.token)"""


def _chat_and_prefs() -> str:
    chat_part = scored("samples", "conv_id").replace("uses", "chat_uses").replace("weighed", "chat_weighed").replace(
        "losses AS", "chat_losses AS")
    logs = LOGS + f""", run_logs AS (
      SELECT ['de', 'en', 'es', 'fr'][CAST(user_id % 4 + 1 AS INTEGER)] AS run, {LOG_METRICS}
      FROM logs GROUP BY 1)"""
    return ", ".join([MODEL, CHAT_WORDS, chat_part, PERPLEXITY, PAIRS, SIDES, scored("sides", "conv_id, turn, side"), PREFS, logs,
                      "doc_runs AS (SELECT lang AS run, count(*) AS train_rows FROM documents GROUP BY lang)"])


EVALUATED = "FROM doc_runs d LEFT JOIN run_logs l USING (run) LEFT JOIN ppl p USING (run) LEFT JOIN prefs f USING (run)"
STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"

ORACLE: dict[str, str] = {
    # ---------------------------------------------------------- prepare rows
    "sft_text": f"WITH {CHAT} SELECT conv_id, text FROM chat",
    "sft_from_pairs": f"WITH {PAIRS} SELECT conv_id, turn, chosen AS messages, score_chosen FROM pairs",
    "split_scan": """
      SELECT doc_id, 'train' AS part, n_chars FROM documents WHERE lang = 'en'
      UNION ALL SELECT * FROM (
        SELECT doc_id, 'eval', n_chars FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 100)""",
    "prepare_path": """
      SELECT doc_id, 'train' AS part, n_chars FROM documents WHERE lang = 'de'
      UNION ALL SELECT * FROM (
        SELECT doc_id, 'eval', n_chars FROM documents WHERE lang = 'es' ORDER BY doc_id LIMIT 200)
      UNION ALL SELECT doc_id, 'whole', n_chars FROM documents""",
    "seeded_order": f"""WITH {PAIRS}, unpaired AS (
        SELECT conv_id, turn, 1 AS label FROM pairs UNION ALL SELECT conv_id, turn, 0 FROM pairs)
      SELECT conv_id, turn, label,
             row_number() OVER (ORDER BY md5('42:' || conv_id || ':' || turn || ':' || label), conv_id, turn, label) - 1 AS position
      FROM unpaired""",
    "first_rows": """
      SELECT event_id, user_id, event_type FROM events ORDER BY md5('7:' || event_id), event_id
      LIMIT (SELECT count(*) // 2 FROM events)""",
    "dpo_pairs": f"WITH {PAIRS} SELECT conv_id, turn, u AS prompt, chosen, rejected FROM pairs",
    "orpo_pairs": f"""WITH {PAIRS}
      SELECT conv_id, turn, u AS prompt, chosen, rejected, score_chosen, score_rejected FROM pairs""",
    "implicit_prompt": f"""WITH {PAIRS}
      SELECT conv_id, turn, CASE WHEN a = r THEN chosen ELSE asked END AS prompt,
             CASE WHEN a = r THEN '' ELSE 'assistant: ' || a END AS chosen,
             CASE WHEN a = r THEN '' ELSE 'assistant: ' || r END AS rejected FROM pairs""",
    "kto_unpair": f"""WITH {PAIRS}
      SELECT conv_id, turn, u AS prompt, a AS completion, 1 AS label FROM pairs
      UNION ALL SELECT conv_id, turn, u, r, 0 FROM pairs""",
    "kto_text": f"""WITH {PAIRS}
      SELECT conv_id, turn, replace(u, ' ', chr(10)) AS prompt, a AS completion,
             CAST(score_chosen AS INTEGER) % 2 AS label FROM pairs""",
    "kto_sample": f"""WITH {PAIRS}, unpaired AS (
        SELECT conv_id, turn, a AS completion, 1 AS label, 'true' AS shown FROM pairs
        UNION ALL SELECT conv_id, turn, r, 0, 'false' FROM pairs)
      SELECT conv_id, turn, completion, label FROM unpaired
      ORDER BY md5('42:' || conv_id || ':' || turn || ':' || shown), conv_id, turn, label LIMIT 50""",
    "grpo_rows": f"""WITH {PAIRS}
      SELECT conv_id, turn, u AS prompt, a AS chosen, r AS rejected, score_chosen, score_rejected FROM pairs""",
    "cap_position": f"""WITH {GAPPY}
      SELECT conv_id, turn, chosen FROM (SELECT * FROM gappy ORDER BY conv_id, turn LIMIT 50)
      WHERE chosen IS NOT NULL AND rejected IS NOT NULL""",
    "cap_valid": f"""WITH {GAPPY}
      SELECT conv_id, turn, rejected FROM gappy WHERE chosen IS NOT NULL AND rejected IS NOT NULL
      ORDER BY conv_id, turn LIMIT 50""",
    "array_items": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) - 1 AS item_pos,
        md5(text) AS text_md5 FROM documents""",
    "scoring_rejects": f"""WITH {EXCHANGES}, left_out AS (
        SELECT 'test' AS part, CASE WHEN count(*) % 5 = 0 THEN 'no_text'
            WHEN count(*) FILTER (WHERE role IS NULL OR text IS NULL OR length(text) % 97 = 0) > 0 THEN 'broken_message' END AS reject_reason
        FROM conversations GROUP BY conv_id
        UNION ALL
        SELECT 'pairs', CASE WHEN p.a IS NULL OR r.a IS NULL OR length(r.a) % 3 = 0 THEN 'empty_side'
            WHEN p.u IS NULL OR length(p.u) % 97 = 0 OR length(p.a) % 97 = 0 OR length(r.a) % 97 = 0 THEN 'broken_message' END
        FROM exchanges p LEFT JOIN next_replies r ON r.conv_id = (p.conv_id + 1) % (SELECT max(conv_id) + 1 FROM conversations))
      SELECT part, reject_reason, count(*) AS n FROM left_out WHERE reject_reason IS NOT NULL GROUP BY 1, 2""",
    "valid_pairs": f"""WITH {GAPPY}
      SELECT conv_id, turn, rejected FROM gappy WHERE chosen IS NOT NULL AND rejected IS NOT NULL""",
    # ---------------------------------------------------------------- ingest
    "ingest_classify": f"WITH {RAW} SELECT * FROM records",
    "ingest_rejects": f"""WITH {RAW}
      SELECT CASE WHEN j IS NULL THEN 'bad_json' WHEN k IS NULL THEN 'non_object' ELSE 'unrecognised' END AS reject_reason,
             count(*) AS n
      FROM typed WHERE type IS NULL GROUP BY 1""",
    "ingest_parquet": f"""WITH {RAW}
      SELECT type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM records GROUP BY type
      UNION ALL
      SELECT CASE WHEN j IS NULL THEN 'bad_json' WHEN k IS NULL THEN 'non_object' ELSE 'unrecognised' END, count(*), NULL
      FROM typed WHERE type IS NULL GROUP BY 1""",
    "table_split": "SELECT doc_id, lang AS split, n_chars FROM documents WHERE lang = 'fr'",
    "strict_list": "SELECT doc_id, i AS item_pos, md5(text) AS chosen_md5 FROM documents, (VALUES (0), (1)) AS p(i)",
    "typed_path": """
      SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang""",
    "contract_report": f"""WITH {RAW}
      SELECT m.method, count(*) FILTER (WHERE CASE m.method
        WHEN 'sft' THEN list_has_any(k, ['messages', 'text', 'prompt'])
        WHEN 'kto' THEN list_has_all(k, ['prompt', 'completion', 'label']) OR list_has_all(k, ['chosen', 'rejected'])
        WHEN 'grpo' THEN list_contains(k, 'prompt')
        ELSE list_has_all(k, ['chosen', 'rejected']) END) AS n
      FROM typed, (VALUES ('sft'), ('dpo'), ('orpo'), ('kto'), ('grpo')) AS m(method) GROUP BY m.method""",
    # ------------------------------------------------------------------ text
    "chat_prompt": f"""
      SELECT conv_id, {STRIP.format(
        "coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'system'), '') || chr(10) || 'User: ' || "
        "coalesce(max_by(text, turn) FILTER (WHERE role = 'user'), '') || chr(10) || 'Assistant: '")} AS prompt
      FROM conversations GROUP BY conv_id""",
    "last_assistant": f"""WITH {CHAT}, last AS (
        SELECT conv_id, max_by(text, turn) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
      SELECT c.conv_id, coalesce(l.reply, to_json(c.messages)::VARCHAR) AS reply
      FROM chat c LEFT JOIN last l USING (conv_id)""",
    "gen_prompt": f"""WITH {EXCHANGES}
      SELECT conv_id, turn, 'User: ' || u || chr(10) || 'Assistant:' AS prompt, 'user: ' || u AS as_chat
      FROM exchanges WHERE trim(u) <> ''""",
    "reply_extract": f"""WITH {EXCHANGES}, generated AS (
        SELECT conv_id, turn, u, CASE WHEN conv_id % 2 = 0 THEN 'User: ' || u || chr(10) || 'Assistant:  ' || a || chr(10)
                                ELSE u || chr(10) || ' ' || a END AS g FROM exchanges WHERE a IS NOT NULL)
      SELECT conv_id, turn, {STRIP.format("CASE WHEN contains(g, 'Assistant:') THEN string_split(g, 'Assistant:')[-1] "
                                    "ELSE substr(g, length(u) + 1) END")} AS reply FROM generated""",
    "message_literal": f"WITH {CHAT} SELECT conv_id, text FROM chat",
    "truncate_tokens": f"""
      SELECT doc_id, CAST(len(t) AS INTEGER) AS num_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
      FROM (SELECT doc_id, {words('text')}[1:512] AS t FROM documents)""",
    # --------------------------------------------------------------- rewards
    "distinct_char_reward": """
      SELECT conv_id, turn, CAST(len(list_distinct(regexp_extract_all(text, '(?s).'))) AS DOUBLE) AS reward
      FROM conversations WHERE role = 'assistant'""",
    "mean_pool": f"WITH {MEANS} SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(x, 6) AS value FROM dim_means",
    "cosine_to_mean": f"WITH {TRIPLES} SELECT vec_id, round(own, 6) AS own, round(next, 6) AS next FROM cosines",
    "similarity_reward": f"WITH {TRIPLES} SELECT vec_id, round(reward, 6) AS reward FROM rewarded",
    "group_advantage": f"""WITH {TRIPLES}
      SELECT vec_id, prompt_id, round((reward - avg(reward) OVER w)
             / (coalesce(stddev_samp(reward) OVER w, 0) + 0.0001), 4) AS advantage
      FROM rewarded WINDOW w AS (PARTITION BY prompt_id)""",
    "best_of_group": f"""WITH {TRIPLES}
      SELECT prompt_id, vec_id, round(reward, 6) AS reward FROM (
        SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY reward DESC, vec_id) AS rn FROM rewarded)
      WHERE rn = 1""",
    "zero_scores": """
      SELECT count(*) AS n_rows, round(avg(CASE
        WHEN (doc_id % 3 = 0 OR n_chars % 3 = 0) AND (doc_id % 2 = 0 OR n_chars % 2 = 0) THEN 1.0 ELSE 0.0 END), 6) AS zero_share
      FROM documents""",
    # ----------------------------------------------------------- runs on disk
    "train_log_metrics": f"""WITH {LOGS}, rolled AS (SELECT run, {LOG_METRICS} FROM logs GROUP BY run),
      facts AS (
        SELECT {RUN} AS run, count(*) AS total_steps,
               'checkpoint-' || (min_by(event_id, value * 1e9 + event_id) FILTER (WHERE event_type = 'purchase'))
                 AS best_checkpoint
        FROM events GROUP BY 1)
      SELECT run, total_steps, best_checkpoint, round(initial_train_loss, 6) AS initial_train_loss,
             round(final_train_loss, 6) AS final_train_loss, round(best_eval_loss, 6) AS best_eval_loss,
             round(final_eval_loss, 6) AS final_eval_loss, round(training_time_seconds, 6) AS training_time_seconds,
             round(training_time_seconds / 3600, 6) AS training_time_hours
      FROM facts JOIN rolled USING (run)""",
    "metrics_by_group": f"""WITH {LOGS}, rolled AS (
        SELECT run, month, CAST(GROUPING(run, month) AS INTEGER) AS grouping, count(*) AS entries, {LOG_METRICS}
        FROM logs GROUP BY GROUPING SETS ((run, month), (run), ()))
      SELECT run, month, grouping, entries, round(initial_train_loss, 6) AS initial_train_loss,
             round(final_train_loss, 6) AS final_train_loss, round(best_eval_loss, 6) AS best_eval_loss,
             round(final_eval_loss, 6) AS final_eval_loss, round(training_time_seconds, 6) AS training_time_seconds
      FROM rolled""",
    "latest_adapter": f"WITH {FILES} SELECT run, checkpoint, step, label, path FROM newest",
    "latest_checkpoint": f"WITH {FILES} SELECT run, max_by(checkpoint, step) AS checkpoint FROM checkpoints GROUP BY run",
    "latest_checkpoint_name": f"WITH {FILES} SELECT run, max(checkpoint) AS checkpoint FROM checkpoints GROUP BY run",
    "state_files": f"""WITH {FILES}, last AS (SELECT run, max_by(checkpoint, step) AS checkpoint FROM checkpoints GROUP BY run)
      SELECT DISTINCT f.run, f.rel_path FROM files f JOIN last l
        ON l.run = f.run AND f.rel_path = l.checkpoint || '/trainer_state.json'""",
    "run_folder_scan": f"""WITH {run_tree('user_id')}, folders AS (SELECT DISTINCT run, g, kind, b FROM grouped),
      roots AS (SELECT DISTINCT run, g, kind FROM grouped),
      names(kind, name) AS (VALUES (0, 'adapter_model.safetensors'), (0, 'adapter_config.json'), (1, 'model.safetensors'),
        (2, 'adapter_model.safetensors'), (3, 'adapter_model.safetensors'), (3, 'adapter_config.json'),
        (4, 'pytorch_model.bin'), (4, 'adapter_config.json'), (5, 'notes.txt'))
      SELECT run, 'checkpoint-' || ((b + 8) * 100) || '/adapter_model.safetensors' AS rel_path,
             CAST(length('checkpoint-' || ((b + 8) * 100)) AS BIGINT) AS bytes FROM folders
      UNION ALL SELECT run, 'checkpoint-' || ((b + 8) * 100) || '/trainer_state.json', NULL FROM folders
        WHERE NOT (kind = 3 AND b = 2)
      UNION ALL SELECT run, 'trainer_state.json', NULL FROM roots WHERE kind IN (0, 4)
      UNION ALL SELECT run, name, CAST(length(CAST(g AS VARCHAR)) AS BIGINT) FROM roots JOIN names USING (kind)""",
    "trainer_state_read": f"""WITH {run_tree('user_id')}
      SELECT run, total_steps, best_checkpoint, round(initial_train_loss, 6) AS initial_train_loss,
             round(final_train_loss, 6) AS final_train_loss, round(best_eval_loss, 6) AS best_eval_loss,
             round(final_eval_loss, 6) AS final_eval_loss, round(training_time_seconds, 6) AS training_time_seconds,
             round(training_time_seconds / 3600, 6) AS training_time_hours
      FROM state_metrics""",
    "run_inventory": f"""WITH {FILES}
      SELECT run, has_adapter, has_model, has_config, CASE WHEN has_adapter = 1 THEN 'LoRA' ELSE 'Full' END AS kind,
             CASE WHEN has_config = 1 THEN 'lora' ELSE 'full' END AS load_as,
             CASE WHEN has_config = 1 THEN 'models/base' ELSE run END AS model,
             CASE WHEN has_config = 1 THEN run END AS adapter
      FROM inventory""",
    "run_filter": f"""WITH {FILES}
      SELECT run, CASE WHEN has_adapter = 1 THEN 'LoRA' ELSE 'Full' END AS kind
      FROM inventory WHERE contains(run, 'dpo') OR contains(run, 'kto')""",
    "method_lists": "SELECT DISTINCT user_id, event_type AS name FROM events",
    "catalogue_counts": f"""WITH {FILES}
      SELECT 'runs' AS what, count(*) AS n FROM inventory
      UNION ALL SELECT 'filtered', count(*) FROM inventory WHERE contains(run, 'grpo')
      UNION ALL SELECT 'adapters', count(*) FROM newest""",
    "model_resolve": f"""WITH {FILES}, known AS (SELECT run AS path FROM newest UNION ALL SELECT 'runs/base'),
      asked AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'runs/' || {RUN} WHEN 'view' THEN {RUN}
                  WHEN 'signup' THEN 'base' WHEN 'error' THEN 'base' ELSE 'old_' || {RUN} END AS r FROM events)
      SELECT a.event_id, coalesce(g.path, u.path) AS resolved
      FROM asked a LEFT JOIN known g ON g.path = a.r LEFT JOIN known u ON u.path = 'runs/' || a.r""",
    "label_paths": f"""WITH {FILES}, choices AS (
        SELECT event_id, CASE WHEN event_type = 'error' THEN '(仅基座模型)' ELSE {RUN} || CASE WHEN user_id % 20 < 6 THEN ''
               ELSE '/checkpoint-' || ((event_id % 15 + 1) * 100) END END AS label FROM events)
      SELECT c.event_id, c.label, coalesce(n.path, '') AS path FROM choices c LEFT JOIN newest n USING (label)""",
    "label_choices": f"""WITH {FILES}
      SELECT '(仅基座模型)' AS label, '' AS path UNION ALL SELECT label, path FROM newest""",
    # ------------------------------------------------------------ word models
    "lm_fit": f"WITH {MODEL} SELECT run, token, c FROM counts",
    "lm_totals": f"WITH {MODEL} SELECT run, n, v FROM totals",
    "lm_pairs": f"WITH {MODEL}, {BIGRAMS} SELECT run, ctx, token, c2 AS c FROM bigram_counts",
    "lm_overlay": f"""WITH {MODEL}, {BASE}
      SELECT t.run, b.token, round(ln(0.5 * (b.c + 1) / (SELECT d FROM base_total)
             + 0.5 * (coalesce(c.c, 0) + 1) / (t.n + t.v + 1)), 6) AS log_p
      FROM base b CROSS JOIN totals t LEFT JOIN counts c ON c.run = t.run AND c.token = b.token""",
    "sequence_loss": f"""WITH {MODEL}, {CHAT_WORDS}, {scored('samples', 'conv_id')}
      SELECT conv_id, run, round(loss, 6) AS loss, num_tokens FROM losses""",
    "sequence_loss_own": f"""WITH {MODEL}, {scored('train', 'doc_id', own=True)}
      SELECT doc_id, run, round(loss, 6) AS loss, num_tokens FROM losses""",
    "sequence_loss_pairs": f"""WITH {MODEL}, {BIGRAMS}, {CHAT_WORDS}, steps AS (
        SELECT conv_id, len(toks) AS num_tokens, toks[i] AS ctx, toks[i + 1] AS token
        FROM (SELECT conv_id, toks, unnest(range(1, len(toks))) AS i FROM samples))
      SELECT s.conv_id, t.run,
             round(avg(-ln(0.5 * coalesce(m.ratio, 0) + 0.5 * (coalesce(c.c, 0) + 1) / (t.n + t.v + 1))), 5) AS loss,
             max(s.num_tokens) AS num_tokens
      FROM steps s CROSS JOIN totals t LEFT JOIN counts c ON c.run = t.run AND c.token = s.token
      LEFT JOIN model_pairs m ON m.run = t.run AND m.ctx = s.ctx AND m.token = s.token
      GROUP BY s.conv_id, t.run""",
    "overlay_loss": f"""WITH {MODEL}, {BASE}, {CHAT_WORDS}, uses AS (SELECT conv_id, unnest(toks) AS token FROM samples)
      SELECT s.conv_id, t.run, round(avg(-ln(0.5 * (coalesce(b.c, 0) + 1) / (SELECT d FROM base_total)
             + 0.5 * (coalesce(c.c, 0) + 1) / (t.n + t.v + 1))), 5) AS loss, count(*) AS num_tokens
      FROM uses s CROSS JOIN totals t LEFT JOIN base b ON b.token = s.token
      LEFT JOIN counts c ON c.run = t.run AND c.token = s.token GROUP BY s.conv_id, t.run""",
    "perplexity": f"""WITH {MODEL}, {CHAT_WORDS},
      {scored('samples', 'conv_id').replace('losses AS', 'chat_losses AS')}, {PERPLEXITY}
      SELECT run, round(test_loss, 6) AS test_loss, round(perplexity, 4) AS perplexity, num_tokens FROM ppl""",
    "preference_metrics": f"""WITH {MODEL}, {PAIRS}, {SIDES}, {scored('sides', 'conv_id, turn, side')}, {PREFS}
      SELECT run, round(preference_accuracy, 6) AS preference_accuracy, preference_correct, preference_total,
             round(avg_chosen_loss, 6) AS avg_chosen_loss, round(avg_rejected_loss, 6) AS avg_rejected_loss,
             round(loss_margin, 6) AS loss_margin FROM prefs""",
    # -------------------------------------------------------------- reporting
    "eval_table": f"""WITH {_chat_and_prefs()}
      SELECT run, train_rows, round(initial_train_loss, 4) AS initial_train_loss,
             round(final_train_loss, 4) AS final_train_loss, round(best_eval_loss, 4) AS best_eval_loss,
             round(final_eval_loss, 4) AS final_eval_loss, round(training_time_seconds, 4) AS training_time_seconds,
             round(test_loss, 4) AS test_loss, round(perplexity, 4) AS perplexity,
             round(preference_accuracy, 4) AS preference_accuracy, preference_correct, preference_total,
             round(avg_chosen_loss, 4) AS avg_chosen_loss, round(avg_rejected_loss, 4) AS avg_rejected_loss,
             round(loss_margin, 4) AS loss_margin {EVALUATED}""",
    "summary_text": f"""WITH {_chat_and_prefs()}
      SELECT run, CASE WHEN best_eval_loss <> 0 THEN printf('%.4f', best_eval_loss) ELSE 'N/A' END AS val_loss,
             CASE WHEN perplexity <> 0 THEN printf('%.2f', perplexity) ELSE 'N/A' END AS perplexity,
             CASE WHEN preference_accuracy <> 0 THEN printf('%.2f%%', preference_accuracy * 100) ELSE 'N/A' END
               AS preference_accuracy {EVALUATED}""",
    "evaluate_runs": f"""WITH {run_tree('user_id % 6')}, {CHAT_WORDS}, {PAIRS}, {SIDES}, {RUN_MODELS},
      heard AS (SELECT token, count(*) AS k FROM (SELECT unnest(toks) AS token FROM samples) GROUP BY token),
      ppl AS (SELECT run, sum(k * loss) / sum(k) AS test_loss FROM heard JOIN word_loss USING (token) GROUP BY run),
      uses AS (SELECT conv_id, turn, side, token, count(*) AS k
        FROM (SELECT conv_id, turn, side, unnest(toks) AS token FROM sides) GROUP BY ALL),
      losses AS (SELECT conv_id, turn, side, run, sum(k * loss) / sum(k) AS loss
        FROM uses JOIN word_loss USING (token) GROUP BY ALL), {PREFS},
      found AS (SELECT DISTINCT run FROM grouped WHERE kind < 5)
      SELECT run, run AS model_name, 'exp/runs/' || run AS model_path, round(initial_train_loss, 4) AS initial_train_loss,
             round(final_train_loss, 4) AS final_train_loss, round(best_eval_loss, 4) AS best_eval_loss,
             round(final_eval_loss, 4) AS final_eval_loss, total_steps, best_checkpoint,
             round(training_time_seconds, 4) AS training_time_seconds,
             round(training_time_seconds / 3600, 4) AS training_time_hours, round(exp(test_loss), 4) AS perplexity,
             round(test_loss, 4) AS test_loss, round(preference_accuracy, 4) AS preference_accuracy, preference_correct,
             preference_total, round(avg_chosen_loss, 4) AS avg_chosen_loss,
             round(avg_rejected_loss, 4) AS avg_rejected_loss, round(loss_margin, 4) AS loss_margin
      FROM found LEFT JOIN state_metrics USING (run) LEFT JOIN ppl USING (run) LEFT JOIN prefs USING (run)""",
    "leaderboard_a": f"""WITH {RESULTS}
      SELECT run AS model_name, model_path, round(perplexity, 6) AS perplexity, round(test_loss, 6) AS test_loss,
             CAST(NULL AS DOUBLE) AS training_time_hours, total_steps
      FROM results ORDER BY perplexity DESC NULLS LAST, test_loss DESC NULLS LAST, run""",
    "leaderboard_b": f"""WITH {RESULTS}
      SELECT run AS model_name, model_path, round(preference_accuracy, 6) AS preference_accuracy,
             round(loss_margin, 6) AS loss_margin, round(perplexity, 6) AS perplexity, round(test_loss, 6) AS test_loss,
             CAST(NULL AS DOUBLE) AS training_time_hours, total_steps,
             CAST(NULL AS DOUBLE) AS best_eval_loss, CAST(NULL AS DOUBLE) AS final_eval_loss
      FROM results ORDER BY preference_accuracy DESC NULLS LAST, loss_margin DESC NULLS LAST, run""",
    "results_roundtrip": f"""WITH {RESULTS}
      SELECT run, model_path, round(perplexity, 6) AS perplexity, round(test_loss, 6) AS test_loss, total_steps
      FROM results""",
    "run_samples": f"""WITH {GENERATED}, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos) - 1 AS i FROM generated WHERE pos < 3)
      SELECT run, CAST(i AS INTEGER) AS i, prompt, response FROM ranked""",
    "samples_of_run": f"""WITH {GENERATED}
      SELECT run, to_json(list({{'prompt': prompt, 'response': response}} ORDER BY pos))::VARCHAR AS samples
      FROM generated WHERE run = 'run_3' AND pos < 3 GROUP BY run""",
    # ---------------------------------------------------------- own functions
}
ORACLE["perplexity_samples"] = ORACLE["perplexity"]
