"""The registered queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (bpe, byte_cnn, chat, cross_tokens, decontaminate, hmm, near_dup, quality_rules, repair, suffix_dedup, url_filters,
                            warc, wrapper)
from tallyframe.plans.registry import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer file of the contracts lies."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    back = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


#: Fixed value: the conversation that the contract adds.
ADDED_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


@query("op2_chat_formatting", oracle=r"""
    WITH rows AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
    marked AS (SELECT *, role = 'assistant' AS trained,
                 16 + length(role) + length(regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g')) AS chars FROM rows)
    SELECT conv_id, count(*)::BIGINT AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      sum(CASE WHEN trained THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
      sha256(string_agg(CASE WHEN trained THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
      sum(chars)::BIGINT AS formatted_chars
    FROM marked GROUP BY conv_id
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(ADDED_CONVERSATION, rows.schema))
    back = chat.read_turns(chat.format_turns(chat.canonical_turns(rows)))
    nl = F.lit("\n")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl)), ""), 256).alias("turns_sha256"),
        F.length(F.array_join("trained", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("trained", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op4_suffix_array_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = quality_rules.quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          "base_failed", "kept", "posterior")


@query("op3_lm_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(table(spark, sf_dir, "documents"))


#: Fixed values: the rules of the contract.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/"))


@query("op6_url_filters", oracle="""
    WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
           ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    urls AS (SELECT row_number() OVER () AS n, page_id,
               translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    best AS (SELECT u.n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
               arg_max(r.verdict, length(r.host || r.path)) AS verdict
             FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host))
                                     AND starts_with(u.path, r.path) GROUP BY u.n)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (n)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, URL_RULES)[["page_id", "host", "path", "rule", "verdict"]]


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = byte_cnn.score(docs, byte_cnn.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", byte_cnn.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query("op9_warc", oracle="""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    m AS (SELECT html, max(page_id) AS last FROM p GROUP BY html)
    SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes,
      array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)
        for i in range(32)], '') AS payload_digest,
      CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
    FROM p JOIN m ON p.html = m.html
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_benchmark_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_html_extraction", oracle=r"""
    WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
    t AS (SELECT page_id, url, replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g'),
                 '&amp(;?)', chr(1), 'g'), '&quot;', '"'), chr(1), '&') AS x FROM a)
    SELECT page_id, url, trim(regexp_replace(x, '[\s\x{a0}]+', ' ', 'g')) AS text,
      length(trim(regexp_replace(x, '[\s\x{a0}]+', ' ', 'g')))::BIGINT AS n_chars FROM t
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = wrapper.main_texts(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _repair_sql() -> str:
    """The automaton of the contract, one row of a conversation after the other."""
    dead, far = "1000000", "1000000"

    def step(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}}"

    def insert(state: str, role: str) -> str:
        return step(state, "5", "I", f"chr(10) || '{role}:'")

    def rerole(state: str, role: str) -> str:
        return step(state, f"1 + r.extra + r.dead * {dead}", "R", f"chr(10) || '{role}:' || r.text")

    def keep(state: str, initial: str) -> str:
        return step(state, f"r.extra + r.dead * {dead} + (r.initial <> '{initial}')::INT * {dead}", "K", "chr(10) || r.role || ':' || r.text")

    def drop(state: str) -> str:
        return step(state, "2", "D")

    closed = (f"least(b2, {insert('b0', 'user')}, {insert('b1', 'user')}, {insert('b3', 'user')})",
              f"least(b3, {insert('b2', 'assistant')}, {insert('m0', 'assistant')}, {insert('m1', 'assistant')})")
    start = "{'c': 0, 'a': '', 't': ''}"
    none = f"{{'c': {far}, 'a': '', 't': ''}}"
    to_user = ", ".join(f"{keep(s, 'u')}, {rerole(s, 'user')}" for s in ("b0", "b1", "i3"))
    return rf"""
    WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    coded AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
        lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 20 AS kind FROM named),
    damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE kind <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
        left(role, 1) AS initial FROM damaged),
    judged AS (SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen,
        regexp_extract(text, '([^ 	-])[ 	-]*$', 1) NOT IN ('.', '!', '?') AS open,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
    faults AS (SELECT conv_id, n, turn, role, initial, text, blank, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND open AS truncated,
        coalesce(illegal, false) AS illegal, (blank OR seen)::INT AS dead,
        (NOT blank AND NOT seen AND open)::INT * 5 AS extra FROM judged),
    ids AS (SELECT DISTINCT conv_id FROM conversations),
    walk AS (SELECT conv_id, 0::BIGINT AS n, {start} AS b0, {none} AS b1, {none} AS b2, {none} AS b3 FROM ids
      UNION ALL
      SELECT conv_id, n, {drop('b0')}, least({drop('b1')}, {keep('b0', 's')}), least({drop('i2')}, {to_user}),
        least({drop('i3')}, {keep('i2', 'a')}, {rerole('i2', 'assistant')})
      FROM (SELECT w.conv_id, r.n, b0, b1, r, {closed[0]} AS i2, {closed[1]} AS i3
            FROM (SELECT *, {insert('b0', 'user')} AS m0, {insert('b1', 'user')} AS m1 FROM walk) w
            JOIN faults r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = w.n + 1)),
    ends AS (SELECT conv_id, least(b0, {closed[1]}) AS e
      FROM (SELECT *, {insert('b0', 'user')} AS m0, {insert('b1', 'user')} AS m1 FROM
            (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS latest FROM walk) WHERE latest = 1)),
    counts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(blank) AS blank,
        count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal FROM faults GROUP BY conv_id)
    SELECT ends.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
      coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, e.c::BIGINT AS cost, e.a AS audit,
      sha256(substr(e.t, 2)) AS repaired_sha256
    FROM ends LEFT JOIN counts ON ends.conv_id IS NOT DISTINCT FROM counts.conv_id
"""


@query("op12_conversation_repair", oracle=_repair_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = repair.repair(repair.damage(rows), rows)
    return fixed.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@query("op13_cross_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    aligned = cross_tokens.align_texts(table(spark, sf_dir, "documents"), *paths)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
