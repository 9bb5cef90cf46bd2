"""The queries of the training-data operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import fold_of, table


#: lower() of A-Z alone, and the white space of the contracts.
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold_of(F.col("doc_id"), 5) != 0)
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.exact_dedup import exact_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g USING (text)
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.line_dedup import line_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")



OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, i, line, {LOWER.format(f"trim(line, {BLANKS})")} AS key
      FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
h AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT l.*, h.key IS NOT NULL AND l.doc_id <> h.top AS gone FROM l LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.jaccard_join import jaccard_links

    return jaccard_links(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Shingle sets as lists of words, links with their number by document, and the least document that links reach.
OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id,
       (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links FROM d LEFT JOIN n USING (doc_id)
"""


#: The tool of the chat query.
TOOLS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("search", "after", "string", False),
    ("calculate", "expression", "string", True),
    ("fetch", "url", "string", True),
]


def as_tool_dialogue(conversations: DataFrame) -> DataFrame:
    """Plain conversations as dialogues with a tool: a user's turn becomes a call of ``search`` with its text, and the turn after it the result.

    Every second call waits for the result of the call before it. All other turns stay messages.
    """
    turn = F.col("turn")
    name = lambda t: F.concat(F.lit("c"), t.cast("string"))
    after = F.when(turn % 4 == 2, F.struct(name(turn - 2).alias("$result")))
    call = F.struct(name(turn).alias("id"), F.lit("search").alias("name"), F.struct(F.coalesce("text", F.lit("")).alias("query"), after.alias("after")).alias("arguments"))
    result = F.struct(name(turn - 1).alias("tool_call_id"), F.col("text").alias("content"))
    asks, answers = F.col("role") == "user", F.col("role") == "assistant"
    role = F.when(asks, "assistant").when(answers, "tool").otherwise(F.col("role"))
    text = F.when(asks, F.to_json(F.struct(F.array(call).alias("tool_calls")))).when(answers, F.to_json(result)).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.chat_format import TOOL_SCHEMA, format_chats

    return format_chats(as_tool_dialogue(table(spark, sf_dir, "conversations")), spark.createDataFrame(TOOLS, TOOL_SCHEMA))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.sentencepiece_fst import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False).drop("text")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.maxent_lm import score_lm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_lm(docs, fold_of(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.decontaminate import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "n_items", "items", "share")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.secret_scan import BASE_RULES, scan_secrets, spans_text

    docs = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in BASE_RULES]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return docs.select("doc_id", *[count(k) for k in kinds], F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


#: The rules of the URL query, as its contract has them.
CONTRACT_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: The rules of its SQL, where the verdicts of the two under net/ are the other way round, and the domain labels of its list.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/")]
LISTED_LABELS = ["spam-farm", "cheap-pills", "adult-x", "ads-track", "casino-win", "free-bets"]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.url_filter import filter_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = F.col("host").rlike(rf"(^|\.)({'|'.join(LISTED_LABELS)})\.[^.]+\.[^.]+$")
    return filter_urls(pages, CONTRACT_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = rf"""
WITH p AS (SELECT page_id, {LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{x}', '{x.split('/', 1)[0]}', '/{x.split('/', 1)[1]}')" for v, x in URL_RULES)}) AS t(what, rule, domain, start)),
m AS (SELECT p.page_id, p.host, p.path, arg_max(rule, length(rule)) AS rule, arg_max(what, length(rule)) AS what
      FROM p LEFT JOIN r ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(what, CASE WHEN regexp_matches(host, '(^|\.)({"|".join(LISTED_LABELS)})\.[^.]+\.[^.]+$') THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_decontamination": op7_decontamination,
        "op8_line_dedup": op8_line_dedup,
        "op9_secret_scan": op9_secret_scan,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op8_line_dedup": OP8_SQL, "op10_url_filter": OP10_SQL}
