"""The registered queries of this subpackage: thin calls of the operators that derive the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The url rules of op1.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import rule_table, url_filter

    return url_filter(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_scores

    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(4))
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=fold("__key") != 2)
    return scores.select("doc_id", (fold("doc_id") == 2).alias("held_out"), "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_benchmark

    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_sampling import encode_pieces

    found = encode_pieces(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", "lossless")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scans import joined, secret_spans

    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("long")
    every = joined(F.array_sort(F.concat("__base", "__random")))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), every.alias("spans"))


#: Parameters of the one tool that op10's messages call.
LOOKUP = [("lookup", "n", "integer", True), ("lookup", "after", "object", False)]


def tool_chats(conversations: DataFrame) -> DataFrame:
    """conversations with tool calls in them, as the table has none: by the number k of characters of a text,

    * an answer of the assistant at turn t calls ``lookup`` (``search``, which no schema has, if k % 17 = 0) as ``call-t``, with n = k (as
      a string if k % 5 = 0, left out if else k % 7 = 0) and, as ``after``, the result of call t + 2 (k % 3 = 0) or t - 2 (k % 3 = 1);
    * a user's message from turn 2 on is the result of the call at t - 1 (of ``call-none`` if k % 11 = 0), with role tool.

    So there are calls that are linked, unanswered, invalid, out of order and in rings, and results without a call.
    """
    k = F.coalesce(F.length("text"), F.lit(0))
    call = lambda shift: F.struct(F.concat(F.lit("call-"), F.col("turn") + shift).alias("$result"))
    n = F.when(k % 5 == 0, F.to_json(F.struct(k.cast("string").alias("n")))).when(k % 7 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(k.alias("n"))))
    after = F.when(k % 3 == 0, F.to_json(F.struct(call(2).alias("after")))).when(k % 3 == 1, F.to_json(F.struct(call(-2).alias("after")))).otherwise(F.lit("{}"))
    arguments = F.concat(F.lit("{"), F.concat_ws(",", *(F.when(x != "{}", F.substring(x, F.lit(2), F.length(x) - 2)) for x in (n, after))), F.lit("}"))
    name = F.when(k % 17 == 0, "search").otherwise("lookup")
    made = F.struct(F.concat(F.lit("call-"), "turn").alias("id"), name.alias("name"), arguments.alias("arguments"))
    asked = F.to_json(F.struct(F.col("text").alias("content"), F.array(made).alias("tool_calls")))
    reply = F.when(k % 11 == 0, "call-none").otherwise(F.concat(F.lit("call-"), F.col("turn") - 1))
    answered = F.to_json(F.struct(F.col("text").alias("content"), reply.alias("tool_call_id")))
    result = (F.col("role") == "user") & (F.col("turn") > 1)
    body = F.when(F.col("role") == "assistant", asked).when(result, answered).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", F.when(result, "tool").otherwise(F.col("role")).alias("role"), body.alias("text"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_chats, parameter_table

    return format_chats(tool_chats(table(spark, sf_dir, "conversations")), parameter_table(spark, LOOKUP))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_quality_classifier, op3_decontamination, op4_quality_rules, op5_token_counts, op6_piece_sampling, op7_sharding, op8_ngram_jaccard_join, op9_secret_scans, op10_chat_formatting)}

_ALNUM, _NOT_SPACE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _rule_sql() -> str:
    cases = []
    for rule, verdict in sorted(URL_RULES, key=lambda r: -len(r[0])):
        host, path = rule.split("/", 1)
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule}|{verdict}'")
    return "CASE " + " ".join(cases) + " ELSE '|allow' END"


ORACLES: dict[str, str] = {
    "op1_url_filters": f"""
        WITH parts AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_LOWER}) AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        judged AS (SELECT *, {_rule_sql()} AS best FROM parts)
        SELECT page_id, host, path, nullif(split_part(best, '|', 1), '') AS rule, split_part(best, '|', 2) AS verdict FROM judged""",
    # the messages of tool_chats(); a chain of waits has at most 16 steps, unless it is a ring
    "op10_chat_formatting": """
        WITH RECURSIVE m AS MATERIALIZED (
            SELECT row_number() OVER () AS id, conv_id, turn, text, coalesce(length(text), 0) AS k, role = 'assistant' AS calls, role = 'user' AND turn > 1 AS replies,
                   CASE WHEN role = 'user' AND turn > 1 THEN 'tool' ELSE role END AS role
            FROM conversations),
        results AS (SELECT id, conv_id, turn, CASE WHEN k % 11 <> 0 THEN turn - 1 END AS call FROM m WHERE replies),
        called AS MATERIALIZED (
            SELECT m.id, m.conv_id, m.turn, r.id AS result, CASE k % 3 WHEN 0 THEN m.turn + 2 WHEN 1 THEN m.turn - 2 END AS after,
                   k % 17 = 0 OR k % 5 = 0 OR k % 7 = 0 AS invalid
            FROM m LEFT JOIN results r ON r.conv_id = m.conv_id AND r.call = m.turn WHERE calls),
        edges AS MATERIALIZED (
            SELECT id AS before, result AS after FROM called WHERE result IS NOT NULL
            UNION ALL SELECT y.result, x.id FROM called x JOIN called y ON y.conv_id = x.conv_id AND y.turn = x.after WHERE y.result IS NOT NULL),
        paths(id, latest, level) AS (
            SELECT id, turn, 0 FROM m
            UNION SELECT m.id, greatest(p.latest, m.turn), p.level + 1 FROM paths p JOIN edges e ON e.before = p.id JOIN m ON m.id = e.after WHERE p.level < 17),
        placed AS (SELECT id, max(latest) AS latest, max(level) AS level FROM paths GROUP BY id),
        ordered AS (SELECT m.*, CASE WHEN level < 17 THEN latest ELSE turn END AS latest, CASE WHEN level < 17 THEN level ELSE 0 END AS level FROM m JOIN placed USING (id))
        SELECT o.conv_id, o.turn, row_number() OVER (PARTITION BY o.conv_id ORDER BY o.latest, o.level, o.turn, o.role) - 1 AS place, o.role,
               '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || CAST(to_json(text) AS VARCHAR) || ',' END || '"role":"' || o.role || '"'
               || CASE WHEN replies THEN ',"tool_call_id":"call-' || CASE WHEN k % 11 = 0 THEN 'none' ELSE CAST(o.turn - 1 AS VARCHAR) END || '"'
                       WHEN calls THEN ',"tool_calls":[{"arguments":{' || concat_ws(',',
                            CASE k % 3 WHEN 0 THEN '"after":{"$result":"call-' || (o.turn + 2) || '"}' WHEN 1 THEN '"after":{"$result":"call-' || (o.turn - 2) || '"}' END,
                            CASE WHEN k % 5 = 0 THEN '"n":"' || k || '"' WHEN k % 7 <> 0 THEN '"n":' || k END)
                            || '},"id":"call-' || o.turn || '","name":"' || CASE WHEN k % 17 = 0 THEN 'search' ELSE 'lookup' END || '"}]' ELSE '' END || '}' AS json,
               CASE WHEN replies AND EXISTS (SELECT 1 FROM called c WHERE c.result = o.id) THEN 'linked' WHEN replies THEN 'orphan'
                    WHEN c.invalid THEN 'invalid' WHEN c.id IS NOT NULL AND c.result IS NULL THEN 'unanswered' WHEN c.id IS NOT NULL THEN 'ok' END AS status
        FROM ordered o LEFT JOIN called c ON c.id = o.id""",
    "op3_decontamination": rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_ALNUM}') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_ALNUM}') AS w FROM benchmark),
        sized AS (SELECT item_id, w, least(len(w), 10) AS size FROM b WHERE len(w) > 0),
        wanted AS (SELECT DISTINCT item_id, size, array_to_string(w[i + 1 : i + size], ' ') AS words FROM (SELECT *, unnest(range(len(w) - size + 1)) AS i FROM sized)),
        sizes AS (SELECT DISTINCT size FROM wanted),
        seen AS (SELECT rid, size, i, array_to_string(w[i + 1 : i + size], ' ') AS words FROM (SELECT rid, w, size, unnest(range(len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
        hits AS MATERIALIZED (SELECT rid, item_id, seen.size, i FROM seen JOIN wanted USING (size, words)),
        covered AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS place FROM hits) GROUP BY rid),
        items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)""",
    "op4_quality_rules": rf"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_NOT_SPACE}') AS w FROM documents),
        windows AS MATERIALIZED (SELECT rid, i, array_to_string(w[i + 1 : i + 5], ' ') AS five FROM (SELECT rid, w, unnest(range(greatest(len(w) - 4, 0))) AS i FROM d)),
        again AS (SELECT rid, five FROM windows GROUP BY ALL HAVING count(*) > 1),
        repeats AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS place FROM windows JOIN again USING (rid, five)) GROUP BY rid),
        split AS (SELECT rid, host, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM d),
        lines AS MATERIALIZED (SELECT *, regexp_extract_all(translate(line, {_LOWER}), '{_NOT_SPACE}') AS lw, array_to_string(lw, ' ') AS norm FROM split WHERE regexp_matches(line, '{_NOT_SPACE}')),
        dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
        docs AS (SELECT rid, string_agg(norm, chr(10) ORDER BY line_no) AS doc FROM lines GROUP BY rid),
        over AS (SELECT host, norm FROM lines JOIN docs USING (rid) GROUP BY ALL HAVING count(DISTINCT doc) > 20),
        removed AS (SELECT rid, sum(len(lw)) AS n FROM lines JOIN over USING (host, norm) GROUP BY rid),
        counted AS (
            SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS gone
            FROM d LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN removed USING (rid)),
        judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT (gone > 0 AND n_words - gone < CAST(0.15 AS DOUBLE) * n_words) AS kept
        FROM judged""",
    "op8_ngram_jaccard_join": rf"""
        WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_NOT_SPACE}') AS w FROM documents),
        grams AS MATERIALIZED (
            SELECT DISTINCT rid, array_to_string(w[i + 1 : i + 3], ' ') AS g FROM (SELECT rid, w, unnest(range(greatest(len(w) - 2, least(len(w), 1)))) AS i FROM d)),
        sizes AS MATERIALIZED (SELECT rid, count(*) AS n FROM grams GROUP BY rid),
        common AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.rid <> b.rid GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        labels(it, rid, l, moved) AS (
            SELECT 0, rid, doc_id, true FROM d
            UNION ALL
            SELECT it + 1, rid, least(l, coalesce(c, l)), coalesce(c < l, false) FROM (
                SELECT p.it, p.rid, p.l, m.c FROM labels p LEFT JOIN (SELECT b, min(q.l) AS c FROM labels q JOIN links ON a = q.rid GROUP BY b) m ON m.b = p.rid)
            WHERE (SELECT bool_or(moved) FROM labels))
        SELECT doc_id, coalesce(n, 0) AS n_shingles, l AS component_id FROM labels JOIN d USING (rid) LEFT JOIN sizes USING (rid) WHERE it = (SELECT max(it) FROM labels)""",
}
