"""One registered query per operator, over its whole table, and the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    chat, decontamination, fingerprints, html_extraction, licenses, packing, phrases, quality_rules, simhash, spelling,
    toxicity, url_filters, warc,
)
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer() -> str:
    """The public vocabulary file of the packing contract."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@register
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The rules of the contract.
URL_RULES = [
    url_filters.Rule("net", "/", "block"), url_filters.Rule("example.net", "/en/", "allow"),
    url_filters.Rule("example.com", "/de/", "block"), url_filters.Rule("org", "/fr/", "allow"),
]


@register
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(pages, URL_RULES, url_filters.learn(url_filters.labelled_urls(spark)))


@register
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_revisit_bytes=0)


ORACLES["op4_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST(('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1,
        1)), 'string_agg', '') AS payload_digest, max(page_id) OVER (PARTITION BY h, payload_bytes) AS owner FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM owner THEN NULL ELSE owner END AS refers_to
FROM d"""


@register
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(), packing.Capacity(), end_id=2)


@register
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Tools of the view below; some of its calls break their schemas on purpose.
TOOLS = [
    chat.Tool("search", (chat.Field("query", "string"), chat.Field("limit", "integer"))),
    chat.Tool("translate", (chat.Field("text", "string"), chat.Field("to", "string"))),
    chat.Tool("summarise", (chat.Field("text", "string"), chat.Field("words", "integer", required=False))),
]


def tool_messages(conversations: DataFrame) -> DataFrame:
    """conversations as tool traffic: user turns are calls, assistant turns their results, system turns plain.

    In the second half of every four turns a call needs the one before it.
    """
    n, user = F.length("text"), F.col("role") == "user"

    def arguments(*fields):
        return F.to_json(F.struct(*(f.alias(k) for k, f in fields)))

    text = ("text", F.col("text"))
    made = (
        F.when(F.col("turn") % 3 == 0, F.when(n % 7 == 0, arguments(("query", F.col("text")), ("limit", F.lit("ten"))))
               .otherwise(arguments(("query", F.col("text")), ("limit", n % 20))))
        .when(F.col("turn") % 3 == 1, F.when(n % 5 == 0, arguments(text)).otherwise(arguments(("to", F.lit("en")), text)))
        .otherwise(F.when(n % 6 == 0, arguments(text, ("style", F.lit("short")))).otherwise(arguments(("words", n), text)))
    )

    def call(turn):
        return F.concat_ws("-", F.lit("call"), "conv_id", turn)

    reply = F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn", F.when(user, "call").when(reply, "result").otherwise("message").alias("kind"),
        F.when(user, "assistant").when(reply, "tool").otherwise(F.col("role")).alias("role"),
        F.when(~user, F.col("text")).alias("text"),
        F.when(user, call(F.col("turn"))).when(reply, call(F.col("turn") - 1)).alias("call_id"),
        F.when(user, F.element_at(F.array(*map(F.lit, ("search", "translate", "summarise"))),
                                  (F.col("turn") % 3 + 1).cast("int"))).alias("name"),
        F.when(user, made).alias("arguments"),
        F.when(user & (F.col("turn") % 4 >= 2), F.array(call(F.col("turn") - 2))).alias("needs"),
    )


@register
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(tool_messages(table(spark, sf_dir, "conversations")), TOOLS)


# In the view no chain of needs is longer than one, and every call id is used by one call.
ORACLES["op7_chat_formatting"] = """
WITH m AS (
  SELECT conv_id, turn, text, length(text) AS n, role AS r,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'tool' ELSE role END AS role,
         CASE role WHEN 'user' THEN 'call-' || conv_id || '-' || turn
                   WHEN 'assistant' THEN 'call-' || conv_id || '-' || (turn - 1) END AS call_id,
         CASE WHEN role = 'user' AND turn % 4 >= 2 THEN 'call-' || conv_id || '-' || (turn - 2) END AS need
  FROM conversations),
c AS (SELECT call_id FROM m WHERE kind = 'call'),
res AS (SELECT call_id, count(*) AS results FROM m WHERE kind = 'result' GROUP BY call_id),
lev AS (SELECT m.call_id, CASE WHEN p.call_id IS NULL THEN 0 ELSE 1 END AS level
        FROM m LEFT JOIN c p ON m.need = p.call_id WHERE m.kind = 'call'),
j AS (SELECT m.*, coalesce(results, 0) AS results, lev.level AS call_level FROM m
      LEFT JOIN res ON m.call_id = res.call_id LEFT JOIN lev ON m.call_id = lev.call_id),
a AS (SELECT *,
        CASE turn % 3 WHEN 0 THEN CASE WHEN n % 7 = 0 THEN json_object('limit', 'ten', 'query', text)
                                       ELSE json_object('limit', n % 20, 'query', text) END
                      WHEN 1 THEN CASE WHEN n % 5 = 0 THEN json_object('text', text) ELSE json_object('text', text, 'to', 'en') END
                      ELSE CASE WHEN n % 6 = 0 THEN json_object('style', 'short', 'text', text)
                                ELSE json_object('text', text, 'words', n) END END AS args,
        CASE turn % 3 WHEN 0 THEN CASE WHEN n % 7 = 0 THEN 'type limit' ELSE '' END
                      WHEN 1 THEN CASE WHEN n % 5 = 0 THEN 'missing to' ELSE '' END
                      ELSE CASE WHEN n % 6 = 0 THEN 'unknown style' ELSE '' END END AS wrong
      FROM j)
SELECT conv_id, turn, kind, call_id,
       CASE kind WHEN 'call' THEN CASE WHEN results > 0 THEN 'linked' ELSE 'pending' END
                 WHEN 'result' THEN CASE WHEN call_level IS NULL THEN 'orphan' WHEN results > 1 THEN 'duplicate' ELSE 'linked' END
                 ELSE 'plain' END AS status,
       CAST(coalesce(call_level, 0) AS INTEGER) AS level,
       CASE WHEN kind = 'call' THEN wrong ELSE '' END AS errors,
       CASE kind WHEN 'call' THEN '{"arguments":' || CAST(args AS VARCHAR) || ',"call_id":' || to_json(call_id) || ',"name":"'
                 || ['search', 'translate', 'summarise'][turn % 3 + 1] || '"'
                 || CASE WHEN need IS NULL THEN '' ELSE ',"needs":[' || to_json(need) || ']' END || ',"role":"assistant"}'
            WHEN 'result' THEN '{"call_id":' || to_json(call_id) || ',"role":"tool","text":' || to_json(text) || '}'
            ELSE '{"role":' || to_json(role) || ',"text":' || to_json(text) || '}' END AS message
FROM a"""


@register
def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.notices(spark))


def _license_sql() -> str:
    """Containment of every template in every window of its grid, without signatures."""
    rows = ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(licenses.NOTICES))
    word = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"
    return f"""
WITH n(template, license, text) AS (VALUES {rows}),
tw AS (SELECT template, license, regexp_extract_all(lower(text), '{word}') AS w FROM n),
ts AS (SELECT template, license, unnest(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s,
              len(w) - 4 AS n FROM tw WHERE len(w) >= 5),
t AS (SELECT template, license, s, n, CAST(ceil(n * 1.5) AS BIGINT) AS width, CAST(ceil(n / 4.0) AS BIGINT) AS stride,
             count(DISTINCT s) OVER (PARTITION BY template) AS size FROM (SELECT DISTINCT * FROM ts)),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{word}') AS w FROM documents),
ds AS (SELECT doc_id, unnest(range(len(w) - 4)) AS pos, w FROM dw WHERE len(w) >= 5),
h AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS s FROM ds),
c AS (SELECT doc_id, template, license, size, s, stride,
             unnest(range(greatest(0, CAST(floor((pos - width) / stride) AS BIGINT) + 1), pos // stride + 1)) AS cell
      FROM h JOIN t USING (s)),
k AS (SELECT doc_id, template, license, cell * stride AS start, count(DISTINCT s) / any_value(size) AS containment
      FROM c GROUP BY ALL)
SELECT doc_id, license, max(containment) AS containment, CAST(min(start) AS BIGINT) AS first_word,
       count(*) AS windows
FROM (SELECT doc_id, template, license, start, max(containment) AS containment FROM k GROUP BY ALL)
WHERE containment >= 0.8 GROUP BY doc_id, license"""


ORACLES["op8_license_scans"] = _license_sql()


@register
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@register
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3)


# The pages' layout, with their character references, written out as patterns.
ORACLES["op9_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(
        regexp_split_to_array(regexp_replace(replace(h, '<br>', ' '), '</?b>', '', 'g'), '</?(?:p|h1)>'),
        lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'),
                  '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))),
        lambda x: x <> '') AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t"""


@register
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_phrase_collocations"] = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')),
       '[^ \t]+') AS w FROM documents),
one AS (SELECT lang, unnest(w) AS phrase FROM piece),
n AS (SELECT lang, count(*) AS n FROM one GROUP BY lang),
two AS (SELECT lang, unnest(list_zip(w[:-2], w[2:])) AS z FROM piece WHERE len(w) > 1),
three AS (SELECT lang, unnest(list_zip(w[:-3], w[2:-2], w[3:])) AS z FROM piece WHERE len(w) > 2),
f AS (SELECT lang, phrase, count(*) AS f FROM one GROUP BY ALL HAVING count(*) >= 10),
f2 AS (SELECT lang, z[1] AS x, z[2] AS y, count(*) AS a FROM two GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, z[1] AS x, z[2] AS y, z[3] AS z, count(*) AS a FROM three GROUP BY ALL HAVING count(*) >= 10),
cut AS (
  SELECT lang, x || ' ' || y AS phrase, a, 1 AS k, l.f AS l, r.f AS r, 2 AS size
  FROM f2 JOIN f l USING (lang) JOIN f r USING (lang) WHERE l.phrase = x AND r.phrase = y
  UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.a, 1, l.f, r.a, 3
  FROM f3 JOIN f l ON l.lang = f3.lang AND l.phrase = f3.x JOIN f2 r ON r.lang = f3.lang AND r.x = f3.y AND r.y = f3.z
  UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.a, 2, l.a, r.f, 3
  FROM f3 JOIN f2 l ON l.lang = f3.lang AND l.x = f3.x AND l.y = f3.y JOIN f r ON r.lang = f3.lang AND r.phrase = f3.z),
scored AS (SELECT *, CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS score FROM cut),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (SELECT lang, phrase, max(a) AS around FROM (
  SELECT lang, x || ' ' || y AS phrase, a FROM f3 UNION ALL SELECT lang, y || ' ' || z, a FROM f3) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN around USING (lang, phrase) WHERE around IS NULL OR 100 * around < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


@register
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@register
def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))
