"""Personal data: exact base kinds, and identifiers that bootstrapped contexts discover.

Base kinds are found by their patterns and checks (octets, Luhn sum, number of digits). Seeds are the base spans, and
long tokens that mix letters and digits. A pattern is a label before a token with a digit (``key=``, ``id:``, ``token =``).
Patterns and the values they stand before form a graph, which is scored in rounds: a pattern by the mean score of its
different values, a value by its best pattern, seeds with 1. A pattern counts if enough values of high score support
it, seeds or not. After ``ROUNDS`` rounds the values of high score are known like seeds, all others start anew, and
the rounds are repeated until no further pattern reaches a high score. Values behind such a pattern are reported as
kind ``id``, also those that no seed resembles.

Positions are code points, ends exclusive. A span's place is the sum of the lengths of what stands before it, a window
over the text's matches; texts without a digit or ``@`` are only scanned. Null text is empty. Spans belong to
(doc_id, text), so repeated rows get the same ones. Extra columns are ignored (or kept, by ``masked``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.store import saved

KINDS = ("email", "ip", "card", "phone", "id")
# A run that a match may start in is entered only at its beginning, or where the last match ended: the same matches,
# in linear time. Repetitions that nothing follows don't give back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+",
}
ROUNDS = 3
CONFIDENT = 0.6
SUPPORT = 5
#: Pseudo-values of score 0 that every pattern starts with.
DOUBT = 1.0
SECRET = 16


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    number = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)
        ),
    )
    return F.aggregate(number, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _matches(texts: DataFrame, kind: str) -> DataFrame:
    """Rows (id, text_hash, kind, start, end, found, left) of a pattern's matches; ``left`` is the text just before."""
    pattern = F.lit(PATTERNS[kind])
    parts = F.transform(
        F.arrays_zip(F.split("text", PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("found")),
        lambda x: F.struct(F.length(x["gap"]).alias("skip"), F.right(x["gap"], F.lit(64)).alias("left"), x["found"].alias("found")),
    )
    if kind == "email":
        texts = texts.filter(F.col("text").contains("@"))
    rows = texts.select("id", "text_hash", F.posexplode(parts).alias("n", "m")).select("id", "text_hash", "n", "m.*")
    before = Window.partitionBy("id", "text_hash").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("skip") + F.coalesce(F.length("found"), F.lit(0))).over(before)
    return (
        rows.withColumn("end", end)
        .filter(F.col("found").isNotNull())
        .select(
            "id", "text_hash", F.lit(KINDS.index(kind)).alias("kind"), (F.col("end") - F.length("found")).alias("start"), "end", "found", "left"
        )
    )


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn("text_hash", F.xxhash64(text))


def _marked(text: str) -> Column:
    """Whether there may be a span: all kinds hold a digit or ``@``."""
    return F.col(text).rlike("[0-9@]")


def _discovered(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """The tokens that patterns of high confidence stand before: rows (id, text_hash, kind, start, end)."""
    key = ["id", "text_hash"]
    label = F.regexp_extract("found", r"^(.*[=:#])[^=:#]*[0-9]", 1)
    # the last word of the text before, or the last two if that is a sign alone
    word = F.regexp_extract("left", r"([^\x20\x09-\x0D]*[A-Za-z][^\x20\x09-\x0D]*[\x20]?[=:#]+)[\x20]*$", 1)
    rest = F.substring("found", F.length(label) + 1, F.lit(1 << 30))
    # signs at both ends go, each side read once from its end
    signs = lambda text: F.length(F.regexp_extract(text, r"^[^A-Za-z0-9]*+", 0))
    lead = signs(rest)
    value = F.substring(rest, lead + 1, F.greatest(F.length(rest) - lead - signs(F.reverse(rest)), F.lit(0)))
    start = F.col("start") + F.length(label) + lead
    tokens = tokens.select(
        *key,
        F.lower(F.when(label != "", label).otherwise(word)).alias("pattern"),
        F.lower(value).alias("value"),
        start.alias("start"),
        (start + F.length(value)).alias("end"),
    ).filter("value <> ''")
    # which tokens a base span covers, at least in part; a text's spans meet only its own tokens, along its length
    spans = base.select(*key, "start", "end", F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("value"))
    along = Window.partitionBy(*key).orderBy("start", F.col("value").isNotNull().cast("int"), "end")
    reach = F.max(F.when(F.col("value").isNull(), F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(F.when(F.col("value").isNull(), F.col("start")), ignorenulls=True).over(
        along.rowsBetween(0, Window.unboundedFollowing)
    )
    mixed = F.length(F.regexp_replace("value", "[^0-9]", "")) >= SECRET // 4
    secret = (F.length("value") >= SECRET) & mixed & F.col("value").rlike("^[a-z0-9_-]++$") & F.col("value").rlike("[a-z]")
    seen = (
        tokens.select(*spans.columns)
        .union(spans)
        .withColumn("reach", reach)
        .withColumn("following", following)
        .filter("value is not null and pattern <> ''")
        .withColumn("covered", F.coalesce((F.col("reach") > F.col("start")) | (F.col("following") < F.col("end")), F.lit(False)))
        .withColumn("seed", F.col("covered") | secret)
    )
    seen = saved(seen.select(*key, "start", "end", "pattern", "value", "covered", "seed"), "labelled")
    graph = saved(seen.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "graph")
    sure = 0
    while True:
        values = graph.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("s"))
        for _ in range(ROUNDS):
            patterns = (
                graph.join(values, "value")
                .groupBy("pattern")
                .agg((F.sum("s") / (F.count("*") + DOUBT)).alias("p"), F.count_if(F.col("s") >= CONFIDENT).alias("support"))
                .filter(F.col("support") >= SUPPORT)
            )
            patterns = saved(patterns, "patterns")
            best = graph.join(patterns, "pattern", "left").groupBy("value")
            values = saved(best.agg(F.greatest(F.max(F.col("seed").cast("double")), F.coalesce(F.max("p"), F.lit(0.0))).alias("s")), "values")
        found = patterns.filter(F.col("p") >= CONFIDENT).count()
        if found == sure:  # further values are known only behind further patterns
            break
        sure = found
        graph = saved(graph.join(values, "value").select("pattern", "value", (F.col("s") >= CONFIDENT).alias("seed")), "graph")
    sure = patterns.filter(F.col("p") >= CONFIDENT).select("pattern")
    return (
        seen.filter("not covered").join(sure, "pattern").select(*key, F.lit(KINDS.index("id")).alias("kind"), "start", "end").distinct()
    )


def spans(docs: DataFrame) -> DataFrame:
    """``id, text_hash, kind, start, end``: all spans of the different (doc_id, text) of ``docs``; kind counts in KINDS."""
    marked = docs.select("doc_id", "text").filter(_marked("text"))
    texts = saved(_keyed(marked).select("id", "text_hash", "text").dropDuplicates(["id", "text_hash"]), "marked")
    base = None
    for kind in KINDS[:-1]:
        found = _matches(texts, kind).filter(_valid(kind, F.col("found"))).drop("found", "left")
        base = found if base is None else base.union(found)
    base = saved(base, "base")
    more = _discovered(_matches(texts, "id"), base)
    return saved(base.union(more.select(*base.columns)), "spans")


def _listed(rows: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    text = F.transform(F.sort_array(rows), lambda r: F.concat_ws(":", F.get(names, r["kind"]), r["start"].cast("string"), r["end"].cast("string")))
    return F.array_join(text, ",")


def reported(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id``, the numbers of its base spans, the digest of their list, and the list of all spans."""
    row = F.struct("start", "kind", "end")
    base = F.col("kind") < KINDS.index("id")
    by_text = (
        spans(docs)
        .groupBy("id", "text_hash")
        .agg(
            *(F.count_if(F.col("kind") == n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)),
            F.collect_list(F.when(base, row)).alias("base"),
            F.collect_list(row).alias("every"),
        )
    )
    found = _keyed(docs.select("doc_id", "text")).select("doc_id", "id", "text_hash").join(by_text, ["id", "text_hash"], "left")
    return found.select(
        "doc_id",
        *(F.coalesce(f"n_{kind}", F.lit(0)).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(F.coalesce(_listed(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_listed(F.col("every")), F.lit("")).alias("spans"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans count as the first of them."""
    key = ["id", "text_hash"]
    along = Window.partitionBy(*key).orderBy("start", "kind", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans(docs).withColumn("fresh", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("group", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(*key, "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    merged = merged.withColumn("from", F.coalesce(F.lag("end").over(Window.partitionBy(*key).orderBy("start")), F.lit(0)))
    cuts = merged.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "from", "end", "kind"))).alias("cuts"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    taken = {c: f"__{n}" for n, c in enumerate(docs.columns)}  # names that clash with none of the helpers
    renamed = docs.select(*(F.col(f"`{c}`").alias(new) for c, new in taken.items()))
    helpers = _keyed(renamed.withColumn("doc_id", F.col(taken["doc_id"])).withColumn("text", F.col(taken["text"])))
    pieces = F.transform(
        "cuts",
        lambda c: F.concat(F.substring(F.col("text"), c["from"].cast("int") + 1, (c["start"] - c["from"]).cast("int")), F.get(names, c["kind"])),
    )
    tail = F.substring(F.col("text"), F.element_at("cuts", -1)["end"].cast("int") + 1, F.lit((1 << 31) - 1))
    text = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), tail))
    # texts that hold no span stay where they are; only the others are shuffled to meet their cuts
    marked = F.coalesce(_marked("text"), F.lit(False))
    out = helpers.filter(marked).join(cuts, key, "left").withColumn(taken["text"], text)
    out = out.select(*renamed.columns).union(helpers.filter(~marked).select(*renamed.columns))
    return out.select(*(F.col(new).alias(c) for c, new in taken.items()))
