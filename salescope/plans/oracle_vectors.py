"""DuckDB SQL oracles for hashed embeddings, vector search, retrieval context and prompts."""

from __future__ import annotations

from salescope.plans.oracle import ORACLE
from salescope.plans.oracle_grid import _SPACES

# Fixed values, written out apart from the implementation's.
DEFAULT_DIM = 262144
NO_FACTS = "No relevant facts found."
_PAD = " " * 8
CHAT_PROMPT = "\n".join(["", *(_PAD + x for x in (
    "You are a Senior Business Intelligence chatbot.",
    "Answer the user's business question using ONLY the provided business facts from our data catalog.",
    "",
    "Rules:",
    "1. Base your answers strictly on the facts listed in the context.",
    "2. If the context does not contain the answer, say \"I don't have that specific data in my current analysis, "
    "but I can help you analyze the dataset if you tell me what you're looking for.\"",
    "3. Do not make up any numbers or insights.",
    "4. Refer to the specific numbers (e.g. Sales, Profits, Discounts) in your response.",
    "",
    "Retrieved Business Facts (Context):",
    "{context}",
    "",
    "Conversation History:",
    "{history}",
    "",
    "User Question: {question}",
    "",
    "Business Answer:",
    ""))])

_SPLIT = r"[^\p{L}\p{N}]+"


def _sparse(src: str, id_col: str, text_col: str, name: str, dim: int = DEFAULT_DIM) -> str:
    """CTEs ``{name}`` = (id, b, wt): hashed word counts, L2-normalised."""
    return f"""
{name}_w AS (SELECT {id_col} AS id, unnest(string_split_regex(lower({text_col}), '{_SPLIT}')) AS w
             FROM {src}),
{name}_c AS (SELECT id, (('0x' || substr(md5(w), 1, 8))::BIGINT % {dim})::INTEGER AS b, count(*) AS c
             FROM {name}_w WHERE w <> '' GROUP BY ALL),
{name} AS (SELECT id, b, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS wt FROM {name}_c)"""


def _ranked(q: str, c: str, k: int) -> str:
    """CTE ``rk``: every (query, corpus row) with a vector, d2 = 2 - 2 dot, top-k by (d2, id)."""
    return f"""
dot AS (SELECT {q}.id AS qid, {c}.id AS cid, sum({q}.wt * {c}.wt) AS dot
        FROM {q} JOIN {c} USING (b) GROUP BY ALL),
qs AS (SELECT DISTINCT id AS qid FROM {q}),
cs AS (SELECT DISTINCT id AS cid FROM {c}),
pairs AS (SELECT qs.qid, cs.cid, 2 - 2 * coalesce(dot.dot, 0) AS d2
          FROM qs CROSS JOIN cs LEFT JOIN dot USING (qid, cid)),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d2, 9), cid) AS rank
                      FROM pairs) WHERE rank <= {k})"""


ORACLE["embed_hash"] = "WITH " + _sparse("documents", "doc_id", "text", "dv") + """
SELECT id AS doc_id, b AS bucket, round(wt, 6) AS weight FROM dv"""

ORACLE["knn_embeddings"] = """
WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
           FROM embeddings),
c AS (SELECT label, pos, avg(x) AS cx FROM e GROUP BY label, pos),
d AS (SELECT c.label, e.vec_id, sum((e.x - c.cx) * (e.x - c.cx)) AS d2
      FROM e JOIN c ON e.pos = c.pos GROUP BY c.label, e.vec_id)
SELECT label, rank, vec_id, round(d2, 6) AS d2
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(d2, 9), vec_id) AS rank FROM d)
WHERE rank <= 5"""

ORACLE["text_search"] = "WITH " + _sparse("documents", "doc_id", "text", "dv") + "," + \
    _sparse("benchmark", "item_id", "text", "qv") + "," + _ranked("qv", "dv", 5) + """
SELECT rk.qid AS item_id, rk.rank, rk.cid AS doc_id, round(rk.d2, 6) AS d2, d.text
FROM rk JOIN documents d ON d.doc_id = rk.cid"""


def _rag_ctes() -> str:
    facts_sql = ORACLE["facts"]
    return f"""
WITH facts AS ({facts_sql}),
questions AS (SELECT conv_id || '/' || turn AS qid, conv_id, turn AS q_turn, text AS question
              FROM conversations WHERE role = 'user'),""" + \
        _sparse("facts", "fact_id", "text", "fv") + "," + \
        _sparse("questions", "qid", "question", "qv") + "," + _ranked("qv", "fv", 5) + f""",
ctx AS (SELECT rk.qid, string_agg('- ' || f.text, chr(10) ORDER BY rk.rank) AS context
        FROM rk JOIN facts f ON f.fact_id = rk.cid GROUP BY rk.qid),
context AS (SELECT q.qid, q.conv_id, q.q_turn, coalesce(ctx.context, '{NO_FACTS}') AS context
            FROM questions q LEFT JOIN ctx USING (qid))"""


ORACLE["rag_context"] = _rag_ctes() + """
SELECT conv_id, q_turn, context FROM context"""


def _sql_template(template: str, values: dict[str, str]) -> str:
    parts = []
    rest = template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        parts.append("'" + head.replace("'", "''") + "'")
        parts.append(values[name])
    parts.append("'" + rest.replace("'", "''") + "'")
    return " || ".join(parts)


ORACLE["prompt_table"] = _rag_ctes() + """,
hist AS (SELECT q.qid,
                string_agg(upper(substr(c.role, 1, 1)) || lower(substr(c.role, 2)) || ': ' || c.text
                           || chr(10), '' ORDER BY c.turn) AS history
         FROM conversations c JOIN questions q ON c.conv_id = q.conv_id AND c.turn < q.q_turn
         GROUP BY q.qid)
SELECT q.conv_id, q.q_turn, """ + _sql_template(CHAT_PROMPT, {
    "context": "x.context", "history": "coalesce(h.history, '')", "question": "q.question"}) + """ AS prompt
FROM questions q LEFT JOIN context x USING (qid) LEFT JOIN hist h USING (qid)"""


ORACLE["index_search"] = """WITH clean AS (
  SELECT doc_id, trim(replace(text, chr(10), ' '), '""" + _SPACES + """') AS text FROM documents),
stored AS (SELECT * FROM clean WHERE text <> '')""" + "," + \
    _sparse("stored", "doc_id", "text", "dv") + "," + \
    _sparse("benchmark", "item_id", "text", "qv") + "," + _ranked("qv", "dv", 2) + """
SELECT rk.qid AS item_id, rk.rank, rk.cid AS doc_id, round(rk.d2, 6) AS d2, d.text
FROM rk JOIN stored d ON d.doc_id = rk.cid"""

ORACLE["text_search_pruned"] = "WITH " + _sparse("documents", "doc_id", "text", "dv") + "," + \
    _sparse("benchmark", "item_id", "text", "qv") + "," + _ranked("qv", "dv", 5) + """
SELECT qid AS item_id, rank, cid AS doc_id, round(d2, 6) AS d2 FROM rk"""

ORACLE["knn_pruned"] = """
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS near_id, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM e a JOIN e b ON a.pos = b.pos GROUP BY ALL)
SELECT vec_id, rank, near_id, round(d2, 6) AS d2
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d2, 9), near_id) AS rank FROM d) WHERE rank <= 3"""

_LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (((length({0}) - length(replace({0}, c, '')))::DOUBLE / greatest(length({0}), 1))::FLOAT)::DOUBLE)"

ORACLE["dense_index_search"] = """WITH stored AS (SELECT * FROM (
  SELECT doc_id, trim(replace(text, chr(10), ' '), '""" + _SPACES + """') AS text FROM documents) WHERE text <> ''),
d AS (SELECT doc_id, """ + _LETTERS.format("text") + """ AS v FROM stored),
q AS (SELECT item_id, """ + _LETTERS.format("text") + """ AS v FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT item_id, doc_id, list_sum(list_transform(range(1, 27), lambda i: (q.v[i] - d.v[i]) * (q.v[i] - d.v[i]))) AS d2 FROM q CROSS JOIN d),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(d2, 9), doc_id) AS rank FROM p) WHERE rank <= 2)
SELECT rk.item_id, rk.rank, rk.doc_id, round(rk.d2, 6) AS d2, stored.text FROM rk JOIN stored USING (doc_id)"""
