"""The operators of this package over the driver's tables, and the SQL that answers those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import decontaminate, divergence, hmm, jaccard, language, near, packing, pii, repair, repeats, sharding, topk, urls
from tidegate.llm.store import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = r"'[^\x20\x09-\x0D]+'"


@query(
    "op10_minhash",
    f"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), {WORDS}) AS ws
        FROM documents
    ), s AS (
        SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
            ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS sh
        FROM w
    ), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
    p AS (
        SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS c
        FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
    ), l AS (SELECT u, v FROM p WHERE 100 * c >= 85 * (nu + nv - c)),
    b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
    r AS (SELECT doc_id, doc_id AS m FROM s UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.m)
    SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(m) AS component_id, s.doc_id = min(m) AS kept
    FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, sh
    """,
)
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.linked(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query(
    "op9_repeats",
    f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
    v AS (
        SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)
    ), r AS (SELECT doc_id, i FROM v WHERE h IN (SELECT h FROM v GROUP BY h HAVING count(*) > 1)),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
    g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
    k AS (
        SELECT w.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS m,
            [ws[i] FOR i IN range(1, len(ws) + 1) IF NOT list_contains(coalesce(gone, []), i)] AS kept
        FROM w LEFT JOIN g ON g.doc_id = w.doc_id
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed,
        sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
    FROM k
    """,
)
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"), width=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=1024, end=2)


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleaved(table(spark, sf_dir, "documents"), shards=16)
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


@query(
    "op3_topk",
    """
    WITH e AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
        FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
    """,
)
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = (
        table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull() & finite).select("vec_id", scaled.alias("vector"))
    )
    return topk.best(vectors, F.col("vec_id") % 50 == 0, k=5)


RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}')"


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _node(url: str) -> str:
    query = f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^?#]*\\?([^#]*)', 1)"
    query = f"regexp_replace(regexp_replace({query}, '(^|&)(utm_[^&=]*|gclid|fbclid)=[^&]*', '', 'g'), '^&', '')"
    name = f"concat_ws('?', {_host(url)} || regexp_replace({_path(url)}, '/$', ''), nullif({query}, ''))"
    return f"CASE WHEN {_host(url)} <> '' THEN {name} END"


def _found(tag: str, value: str) -> str:
    return f"list_transform(regexp_extract_all(html, {_sql_text(tag)}), lambda t: regexp_extract(t, {_sql_text(value)}, 1))"


def _plain(path: str) -> str:
    """A path with its dots resolved."""
    step = "CASE WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] WHEN x[1] = '.' THEN a ELSE a || x END"
    return f"array_to_string(list_reduce([[s] FOR s IN string_split({path}, '/')], lambda a, x: {step}), '/')"


URL_SQL = f"""
WITH RECURSIVE rules(rule_host, rule_path, action) AS (VALUES {", ".join(map(str, RULES))}),
links AS (
    SELECT url, unnest({_found(urls.CANONICAL, urls.HREF)} || {_found(urls.REFRESH, urls.CONTENT_URL)}
        || {_found(urls.OG_URL, urls.CONTENT)}) AS href
    FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
), cut AS (
    SELECT url, href, 'http://' || {_host("url")} AS root, regexp_extract(href, '^([^?#]*)', 1) AS own,
        regexp_extract(href, '(?s)^[^?#]*(.*)$', 1) AS rest,
        CASE WHEN regexp_replace({_path("url")}, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace({_path("url")}, '[^/]*$', '') END AS folder
    FROM links
), targets AS (
    SELECT url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
        WHEN starts_with(href, '//') THEN 'http:' || href
        WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(href, '#') OR {_host("url")} = '' THEN NULL
        WHEN starts_with(href, '/') THEN root || {_plain("own")} || rest
        WHEN starts_with(href, '?') THEN root || {_path("url")} || href
        ELSE root || {_plain("folder || own")} || rest END AS target
    FROM cut WHERE href <> ''
), addresses AS (
    SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT url FROM targets WHERE target IS NOT NULL
    UNION SELECT target FROM targets WHERE target IS NOT NULL
), parts AS (SELECT url, {_host("url")} AS host, {_path("url")} AS path, {_node("url")} AS node FROM addresses),
decided AS (
    SELECT url, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        arg_max(action, length(rule_host || rule_path)) AS action
    FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY url
), edges AS (
    SELECT {_node("url")} AS u, {_node("target")} AS v FROM targets WHERE target IS NOT NULL
), both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reached(node, member) AS (
    SELECT DISTINCT node, node FROM parts WHERE node IS NOT NULL
    UNION SELECT r.node, b.v FROM reached r JOIN both_ways b ON b.u = r.member
), verdicts AS (
    SELECT r.node, bool_or(coalesce(d.action = 'block', false)) AND NOT bool_or(coalesce(d.action = 'allow', false)) AS blocked
    FROM reached r JOIN parts p ON p.node = r.member LEFT JOIN decided d ON d.url = p.url GROUP BY r.node
)
SELECT page_id, {_host("pages.url")} AS host, {_path("pages.url")} AS path, d.rule,
    coalesce(d.action, CASE WHEN v.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN decided d ON d.url = pages.url LEFT JOIN verdicts v ON v.node = {_node("pages.url")}
"""


@query("op1_urls", URL_SQL)
def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), RULES)


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.trained(docs.filter(language.fold(4) != 2))
    found = language.identified(docs, model, ["doc_id"])
    return found.select("doc_id", (language.fold(4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


@query("op5_hmm")
def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(table(spark, sf_dir, "documents"), language.fold(5) == 1)


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.reported(table(spark, sf_dir, "documents"))


@query(
    "op13_jaccard",
    f"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), {WORDS}) AS ws
        FROM documents
    ), s AS (
        SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
            ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh
        FROM w
    ), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
    p AS (
        SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS c
        FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
    ), l AS (SELECT u, v FROM p WHERE 100 * c >= 80 * (nu + nv - c)),
    b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
    r AS (SELECT doc_id, doc_id AS m FROM s UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.m)
    SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(m) AS component_id
    FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, sh
    """,
)
def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"), size=5, percent=80)


SHARES = "1 + (CAST(1000000000 AS HUGEINT) * ({} + 5)) // ({} + 5 * v)"
SOURCES_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts
    FROM documents
), e AS (SELECT id, lang, source, unnest(ts) AS t FROM d),
kept AS (SELECT lang, t FROM e GROUP BY lang, t HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, t, count(*) AS n FROM e JOIN kept USING (lang, t) GROUP BY ALL),
l AS (SELECT lang, t, sum(n) AS n FROM c GROUP BY ALL),
g AS (
    SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = o.lang AND c.source = o.source), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM d) o
), w AS (SELECT lang, sum(total) AS total FROM g GROUP BY lang),
p AS (
    SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, {SHARES.format("coalesce(c.n, 0)", "total")} AS p
    FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t
), q AS (
    SELECT l.lang, l.t, {SHARES.format("l.n", "total")} AS q FROM l JOIN w ON w.lang = l.lang JOIN v ON v.lang = l.lang
), f AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL
), r AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL
    SELECT p.lang, p.source, 'term', p.t, p - q FROM p JOIN q ON q.lang = p.lang AND q.t = p.t WHERE n > 0 AND p > q
), k AS (
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
        CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM r
)
SELECT * FROM k WHERE part = 'pair' OR rank <= 50
"""


@query("op11_divergence", SOURCES_SQL)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"), least=30, top=50)


CRC = """
xor(4294967295, list_reduce(
    [4294967295::UBIGINT] || [ascii(x)::UBIGINT FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')],
    lambda c, b: list_reduce([xor(c, b)] || [0::UBIGINT FOR z IN range(8)], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))
))
"""
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _way(state: str, cost: str, letters: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letters}'}}"


def _if(condition: str, way: str) -> str:
    return f"CASE WHEN {condition} THEN {way} ELSE {{'c': 1000000000, 'a': ''}} END"


def _kept(initial: str, *states: str) -> str:
    return ", ".join(_if(f"stays AND c = '{initial}'", _way(s, "t", "K")) for s in states)


def _reroled(*states: str) -> str:
    return ", ".join(_if("stays", _way(s, "2 + t", "R")) for s in states)


INSERTED = f"""
s0, s1, list_min([s2, {_way("s0", "2", "I")}, {_way("s1", "2", "I")}, {_way("s3", "2", "I")}]) AS i2,
list_min([s3, {_way("s2", "2", "I")}, {_way("s0", "4", "II")}, {_way("s1", "4", "II")}]) AS i3
"""
CONVERSATIONS_SQL = f"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC} % 20 AS h FROM conversations),
d AS (
    SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
        CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM h WHERE h <> 0
), o AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS c,
        rtrim(text, {BLANKS}) AS z
    FROM d
), f AS (
    SELECT *, CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN right(z, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS joint
    FROM o
), k AS (SELECT conv_id, i, c, fault NOT IN ('blank', 'duplicate') AS stays, (fault = 'truncated')::INT AS t FROM f),
walk AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS s0, {{'c': 1000000000, 'a': ''}} AS s1,
        {{'c': 1000000000, 'a': ''}} AS s2, {{'c': 1000000000, 'a': ''}} AS s3
    FROM conversations
    UNION ALL
    SELECT conv_id, i, {_way("s0", "3", "D")}, list_min([{_way("s1", "3", "D")}, {_kept("s", "s0")}]),
        list_min([{_way("i2", "3", "D")}, {_kept("u", "s0", "s1", "i3")}, {_reroled("s0", "s1", "i3")}]),
        list_min([{_way("i3", "3", "D")}, {_kept("a", "i2")}, {_reroled("i2")}])
    FROM (SELECT w.conv_id, k.i, k.c, k.stays, k.t, {INSERTED} FROM walk w JOIN k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.i = w.i + 1)
), e AS (
    SELECT conv_id, list_min([s0, i3]) AS b FROM (
        SELECT conv_id, {INSERTED} FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
), a AS (SELECT conv_id, b.c AS cost, b.a AS audit, unnest(range(1, length(b.a) + 1)) AS j FROM e),
m AS (
    SELECT conv_id, j, audit[j] AS x,
        count(*) FILTER (audit[j] <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i,
        count(*) FILTER (audit[j] <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS n
    FROM a
), r AS (
    SELECT m.conv_id, m.j, m.x, m.n, o.role, o.text,
        max((m.n = 1 AND m.x = 'K' AND o.c = 's')::INT) OVER (PARTITION BY m.conv_id) AS s
    FROM m LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM m.conv_id AND o.i = m.i AND m.x <> 'I' WHERE m.x <> 'D'
), w AS (
    SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (n - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
        || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS lines
    FROM r GROUP BY conv_id
), n AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (joint NOT IN ('su', 'ua', 'au')) AS illegal
    FROM f GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b.c AS BIGINT) AS cost, b.a AS audit,
    sha256(coalesce(lines, '')) AS repaired_sha256
FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def damaged(turns: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The damage of the contract: the rows, which of them are gone, and how often each stands there."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))) % 20
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    return rows, F.col("fault") == 0, F.when(F.col("fault") == 3, 2).otherwise(1)


@query("op12_conversations", CONVERSATIONS_SQL)
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.Repair(*damaged(table(spark, sf_dir, "conversations"))).summary()
