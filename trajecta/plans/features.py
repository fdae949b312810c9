"""Queries on words, sentences and labels of documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trajecta.functions import text as X
from trajecta.operators import aggregates as A
from trajecta.operators import relations as R
from trajecta.operators import windows as W
from trajecta.plans.catalog import query, table
from trajecta.plans.geometry import rounded


SPACE = r"[\x20\x09-\x0D]+"


def documents(spark, d: str):
    """doc_id, text: documents dealt by doc_id, so that windows and groups of their words need no exchange of words."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # a number, so that it stays as dealt


def words(docs, *rules: str):
    """doc_id, pos, word and a column for each cleaning rule: white-space tokens of documents."""
    each = docs.select("doc_id", F.posexplode(F.split("text", SPACE)).alias("i", "word")).where("word <> ''")
    return each.select("doc_id", F.col("i").cast("long").alias("pos"), "word", *[X.clean_word(F.col("word"), r).alias(r) for r in rules])


#: Tokens keep the number they have in the split text.
WORDS = r"""w AS (SELECT * FROM (SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS pos, unnest(p) AS word
FROM (SELECT doc_id, regexp_split_to_array(text, '[\x20\x09-\x0D]+') AS p FROM documents)) WHERE word <> '')"""


@query(rf"""WITH {WORDS} SELECT doc_id, pos, regexp_replace(word, '[^A-Za-z'']', '', 'g') AS letters, regexp_replace(lower(word), '[^A-Za-z0-9'']', '', 'g') AS alnum,
CAST(regexp_matches(word, '[^A-Za-z0-9]$') AS DOUBLE) AS punct, CAST(length(regexp_replace(word, '[^A-Za-z'']', '', 'g')) AS BIGINT) AS word_length  FROM w""")
def words_features(spark, d):
    """Cleaned forms, final punctuation and length of every word."""
    w = words(table(spark, d, "documents"), "letters", "alnum")
    return w.select("doc_id", "pos", "letters", "alnum", X.has_trailing_punct(F.col("word")).alias("punct"), F.length("letters").cast("long").alias("word_length"))


@query(rf"""WITH {WORDS}, c AS (SELECT regexp_replace(lower(word), '[^a-z]', '', 'g') AS word FROM w), t AS (SELECT count(*) AS total FROM c WHERE word <> '')
SELECT word, count(*) AS n, round(log10(count(*) / any_value(total) * 1e9), 6) + 0.0 AS zipf FROM c, t WHERE word <> '' GROUP BY word""")
def lex_freq(spark, d):
    cleaned = words(table(spark, d, "documents"), "lower").select(F.col("lower").alias("word")).where("word <> ''")
    return A.log_freq(cleaned, "word").select("word", "n", rounded("zipf").alias("zipf"))


@query(rf"""WITH {WORDS}, c AS (SELECT doc_id, regexp_replace(lower(word), '[^a-z]', '', 'g') AS word FROM w), t AS (SELECT count(*) AS total FROM c WHERE word <> ''), f AS (SELECT word, log10(count(*) / any_value(total) * 1e9) AS zipf FROM c, t WHERE word <> '' GROUP BY word),
j AS (SELECT doc_id, c.word, CASE WHEN c.word = '' THEN coalesce(f.zipf, 0.0) ELSE f.zipf END AS zipf FROM c LEFT JOIN f ON f.word = CASE WHEN c.word = '' THEN 'the' ELSE c.word END)
SELECT doc_id, count(*) AS n, count(zipf) AS known, CAST(sum(CASE WHEN word = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty_words, round(avg(zipf), 5) + 0.0 AS mean, round(min(zipf), 6) + 0.0 AS rarest FROM j GROUP BY doc_id""")
def word_frequency(spark, d):
    """Every word with its frequency in the corpus, empty ones as ``the``: means by document."""
    cleaned = words(table(spark, d, "documents"), "lower").select("doc_id", F.col("lower").alias("word"))
    rows = A.with_log_freq(cleaned, "word")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("zipf").alias("known"), F.sum((F.col("word") == "").cast("long")).alias("empty_words"), rounded(F.avg("zipf"), 5).alias("mean"), rounded(F.min("zipf")).alias("rarest"))


IN_SET = ", ".join(f"'{w}'" for w in X.CONNECTIVES)


@query(rf"""WITH {WORDS} SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN regexp_replace(lower(word), '[^a-z]', '', 'g') IN ({IN_SET}) THEN 1 ELSE 0 END) AS BIGINT) AS connectives,
CAST(sum(CASE WHEN word = '-' THEN 1 ELSE 0 END) AS BIGINT) AS dashes FROM w GROUP BY doc_id""")
def marker_flags(spark, d):
    marked = words(documents(spark, d), "lower").select("doc_id", X.in_set(F.col("lower"), X.CONNECTIVES).alias("m"), (X.map_tokens(F.col("word")) == "-").alias("dash"))
    return marked.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("m").cast("long").alias("connectives"), F.sum(F.col("dash").cast("long")).alias("dashes"))


SENTENCES = rf"""{WORDS}, q AS (SELECT *, lag(CAST(regexp_matches(word, '[.!?]$') AS INT), 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS cut FROM w),
s AS (SELECT doc_id, pos, word, sum(cut) OVER (PARTITION BY doc_id ORDER BY pos) AS sent FROM q)"""


def sentences(docs):
    """doc_id, sent, body: a sentence ends at a word with final ``.!?``; its words are joined by single spaces."""
    line = F.trim(F.regexp_replace("text", SPACE, " "))
    each = docs.where("text is not null").select("doc_id", F.posexplode(F.split(line, "(?<=[.!?]) ")).alias("sent", "body"))
    return each.where("body <> ''").select("doc_id", F.col("sent").cast("long").alias("sent"), "body")


@query(rf"""WITH {SENTENCES}, g AS (SELECT doc_id, CAST(sent AS BIGINT) AS sent, count(*) AS n, max(CASE WHEN regexp_replace(lower(word), '[^a-z]', '', 'g') IN ({IN_SET}) THEN 1 ELSE 0 END) AS marker, max(length(word)) AS longest FROM s GROUP BY ALL),
m AS (SELECT quantile_cont(n, 0.5) AS med FROM g) SELECT doc_id, sent, n, CAST(marker AS BIGINT) AS marker, CAST(longest AS BIGINT) AS longest, n > med AS hard FROM g, m""")
def sentence_difficulty(spark, d):
    own, clean = F.split("body", " "), F.split(X.clean_words(F.col("body"), "lower"), " ")
    mark = F.arrays_overlap(clean, F.array(*[F.lit(w) for w in X.CONNECTIVES]))
    longest = F.array_max(F.transform(own, F.length))
    g = sentences(table(spark, d, "documents")).select("doc_id", "sent", F.size(own).cast("long").alias("n"), mark.cast("long").alias("marker"), longest.cast("long").alias("longest"))
    return A.median_split(g, "n", "hard")


@query("SELECT conv_id, string_agg(role || ': ' || text, ' | ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def text_reassembly(spark, d):
    c = table(spark, d, "conversations").withColumn("line", F.concat(F.col("role"), F.lit(": "), F.col("text")))
    return A.reassemble(c, ["conv_id"], "turn", "line", " | ")


@query("""SELECT conv_id, arg_min(role, turn) AS role_first, arg_max(role, turn) AS role_last, CAST(arg_min(length(text), turn) AS BIGINT) AS size_first, CAST(arg_max(length(text), turn) AS BIGINT) AS size_last
FROM conversations GROUP BY conv_id""")
def first_last_attr(spark, d):
    c = table(spark, d, "conversations").withColumn("size", F.length("text").cast("long"))
    return A.first_last(c, ["conv_id"], "turn", ["role", "size"])


@query(rf"""WITH {SENTENCES}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent ORDER BY pos) AS r FROM s)
SELECT doc_id, CAST(sent AS BIGINT) AS sent, CAST(max(CASE WHEN r = 1 THEN length(word) END) AS BIGINT) AS first_length, round(avg(length(word)), 6) + 0.0 AS mean_length, count(*) AS n FROM p GROUP BY ALL""")
def sentence_summary(spark, d):
    """The first word's value, the mean and the size of each sentence."""
    size = F.transform(F.split("body", " "), F.length)
    g = sentences(table(spark, d, "documents")).select("doc_id", "sent", size.alias("l"))
    mean = F.aggregate("l", F.lit(0), lambda a, x: a + x) / F.size("l")
    return g.select("doc_id", "sent", F.col("l")[0].cast("long").alias("first_length"), rounded(mean).alias("mean_length"), F.size("l").cast("long").alias("n"))


OFFSETS = f"""{WORDS}, o AS (SELECT doc_id, pos, word, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS w_start FROM w)"""


def word_offsets(spark, d: str):
    w = words(documents(spark, d)).select("doc_id", "pos", F.length("word").alias("_l"))
    return w.withColumn("w_start", W.offsets(F.col("_l"), ["doc_id"], ["pos"])).withColumn("w_end", F.col("w_start") + F.col("_l")).drop("_l")


@query(f"WITH {OFFSETS} SELECT doc_id, pos, w_start AS start FROM o")
def cumulative_offsets(spark, d):
    return word_offsets(spark, d).select("doc_id", "pos", F.col("w_start").alias("start"))


@query(f"""WITH {OFFSETS}, t AS (SELECT doc_id, w_start + 3 * k AS t_start, least(w_start + 3 * k + 3, w_start + length(word)) AS t_end FROM (SELECT *, unnest(generate_series(0, (length(word) - 1) // 3)) AS k FROM o))
SELECT o.doc_id, o.pos, count(*) AS parts, CAST(max(t_start - w_start) AS BIGINT) AS last_part FROM t JOIN o ON t.doc_id = o.doc_id AND o.w_start <= t.t_start AND t.t_end <= o.w_start + length(o.word) GROUP BY o.doc_id, o.pos""")
def token_word_spans(spark, d):
    """Sub-tokens of three characters mapped back to the words that contain them."""
    w = word_offsets(spark, d)
    size = F.col("w_end") - F.col("w_start")
    part = lambda k: F.struct((F.col("w_start") + 3 * k).alias("start"), F.least(F.col("w_start") + 3 * k + 3, "w_end").alias("end"), F.lit(None).cast("long").alias("pos"))
    word = F.struct(F.col("w_start").alias("start"), F.col("w_end").alias("end"), F.col("pos").alias("pos"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / 3)), part)
    spans = w.select("doc_id", F.explode(F.concat(F.array(word), parts)).alias("s")).select("doc_id", "s.*")
    found = R.place_spans(spans, ["doc_id"], F.col("pos").isNotNull(), "start", "end", ["pos"])
    return found.groupBy("doc_id", "word_pos").agg(F.count("*").alias("parts"), F.max(F.col("start") - F.col("word_start")).alias("last_part")).withColumnRenamed("word_pos", "pos")


@query(rf"""WITH {WORDS}, n AS (SELECT doc_id, max(pos) + 1 AS n FROM w GROUP BY doc_id),
c AS (SELECT doc_id, unnest(generate_series(0, greatest(0, CAST(ceil((n - 128) / 64.0) AS BIGINT) * 64), 64)) AS chunk_start FROM n),
v AS (SELECT w.doc_id, w.pos, c.chunk_start, w.pos - c.chunk_start AS inner_pos FROM w JOIN c ON w.doc_id = c.doc_id AND w.pos >= c.chunk_start AND w.pos < c.chunk_start + 128)
SELECT doc_id, pos, arg_min(inner_pos, chunk_start) AS inner_pos, min(chunk_start) AS chunk_start FROM v GROUP BY doc_id, pos""")
def chunk_first_write(spark, d):
    """Overlapping chunks of 128 words every 64; each word takes the value of its earliest chunk."""
    w = words(documents(spark, d)).select("doc_id", "pos", (F.max("pos").over(Window.partitionBy("doc_id")) + 1).alias("n"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - 128) / 64) * 64).cast("long")
    low, high = F.greatest(F.lit(0).cast("long"), F.floor(F.col("pos") / 64) * 64 - 64), F.least(F.floor(F.col("pos") / 64) * 64, last)
    v = w.select("doc_id", "pos", F.explode(F.sequence(low, high, F.lit(64).cast("long"))).alias("chunk_start")).withColumn("inner_pos", F.col("pos") - F.col("chunk_start"))
    out = v.withColumn("first", F.col("chunk_start"))
    return W.first_write_wins(out, ["doc_id", "pos"], "first").select("doc_id", "pos", "inner_pos", "chunk_start")


@query(rf"""WITH {WORDS}, t AS (SELECT doc_id, pos // 4 AS word_no, pos, CASE WHEN length(word) = 7 THEN NULL ELSE length(word) / 10.0 END AS s, CAST(length(word) AS DOUBLE) AS e FROM w)
SELECT doc_id, word_no, round(sum(s), 6) + 0.0 AS skipped, CASE WHEN count(s) = count(*) THEN round(sum(s), 6) + 0.0 END AS propagated, arg_max(e, pos) AS entropy_last, arg_min(e, pos) AS entropy_first FROM t GROUP BY ALL""")
def roll_up_info(spark, d):
    """Surprisal and entropy of parts rolled up to words (here four tokens), under both null policies."""
    n = F.length("word")
    t = words(documents(spark, d)).select("doc_id", F.floor(F.col("pos") / 4).alias("word_no"), "pos", F.when(n != 7, n / 10.0).alias("s"), n.cast("double").alias("e"))
    a = A.roll_up_info(t, ["doc_id", "word_no"], "pos", "s", "e", "last", "skip").withColumnsRenamed({"surprisal": "skipped", "entropy": "entropy_last"})
    b = A.roll_up_info(t, ["doc_id", "word_no"], "pos", "s", "e", "first", "propagate").withColumnsRenamed({"surprisal": "propagated", "entropy": "entropy_first"})
    return a.join(b.hint("merge"), ["doc_id", "word_no"]).select("doc_id", "word_no", rounded("skipped").alias("skipped"), rounded("propagated").alias("propagated"), "entropy_last", "entropy_first")


@query("""WITH p AS (SELECT l.doc_id, CAST(d.n_chars AS DOUBLE) AS score, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
q AS (SELECT quantile_cont(score, 0.1) AS lo, quantile_cont(score, 0.9) AS hi FROM p)
SELECT round(avg(CASE WHEN score <= lo THEN CAST(toxic AS DOUBLE) END), 6) + 0.0 AS bottom, round(avg(CASE WHEN score >= hi THEN CAST(toxic AS DOUBLE) END), 6) + 0.0 AS top FROM p, q""")
def decile_contrast(spark, d):
    out = A.decile_contrast(labelled(spark, d), "score", "toxic")
    return out.select(rounded("bottom").alias("bottom"), rounded("top").alias("top"))


def labelled(spark, d: str):
    """doc_id, score, toxic: labels with the length of their documents as a score."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"), "source")
    return table(spark, d, "labels").join(docs, "doc_id")


@query("SELECT doc_id, score, toxic FROM (SELECT l.doc_id, CAST(d.n_chars AS DOUBLE) AS score, CAST(l.toxic AS BIGINT) AS toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id) ORDER BY score DESC, doc_id LIMIT 15")
def top_bottom_n(spark, d):
    """The fifteen highest scores with their label: a top-n report."""
    return A.top_n(labelled(spark, d).select("doc_id", "score", F.col("toxic").cast("long").alias("toxic")), 15, "score", ["doc_id"])


@query("""WITH p AS (SELECT l.doc_id, CAST(d.n_chars AS DOUBLE) AS score, CAST(l.toxic AS BIGINT) AS toxic, d.text FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
e AS (SELECT *, 'top' AS side FROM (SELECT * FROM p ORDER BY score DESC, doc_id LIMIT 10) UNION ALL SELECT *, 'bottom' FROM (SELECT * FROM p ORDER BY score, doc_id LIMIT 10))
SELECT side, doc_id, score, toxic, substr(text, 1, 80) AS opening, round(avg(toxic) OVER (PARTITION BY side), 6) + 0.0 AS rate FROM e""")
def extremes_with_text(spark, d):
    """The ten highest and the ten lowest scores with the opening of their text, and the share of flagged ones on each side."""
    p = labelled(spark, d).select("doc_id", "score", F.col("toxic").cast("long").alias("toxic"))
    sides = [A.top_n(p, 10, "score", ["doc_id"], largest).withColumn("side", F.lit(name)) for name, largest in (("top", True), ("bottom", False))]
    ends = sides[0].unionByName(sides[1])
    texts = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 80).alias("opening"))
    rows = texts.join(F.broadcast(ends), "doc_id")  # twenty rows
    rate = F.avg("toxic").over(Window.partitionBy("side"))
    return rows.select("side", "doc_id", "score", "toxic", "opening", rounded(rate).alias("rate"))


@query("""WITH p AS (SELECT source, 1 - avg(CAST(d.doc_id IN (SELECT doc_id FROM labels) AS INT)) AS missing, count(*) AS n FROM documents d GROUP BY source)
SELECT source, n, round(missing, 6) + 0.0 AS missing FROM p""")
def label_membership(spark, d):
    """Labels joined as membership flags; absent is 0."""
    flagged = R.flag_join(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"], "has")
    return flagged.groupBy("source").agg(F.count("*").alias("n"), rounded(1 - F.avg("has")).alias("missing"))


@query("""WITH g AS (SELECT d.source, count(*) AS n, count(DISTINCT lang) AS langs, avg(CAST(coalesce(l.toxic, 0) AS DOUBLE)) AS rate FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source)
SELECT count(*) AS groups, min(n) AS least, round(quantile_cont(n, 0.5), 6) AS median, max(n) AS most, max(langs) AS langs, round(avg(rate), 6) + 0.0 AS rate FROM g""")
def group_counts(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    g = docs.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.avg(F.coalesce("toxic", F.lit(0)).cast("double")).alias("rate"))
    return g.agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.round(F.percentile("n", 0.5), 6).alias("median"), F.max("n").alias("most"), F.max("langs").alias("langs"), rounded(F.avg("rate")).alias("rate"))


@query("""SELECT item_id, CAST(length(text) AS BIGINT) AS n, regexp_replace(trim(text), '\\s+', '', 'g') AS squashed,
least(1.0, greatest(0.0, coalesce(try_cast(CAST(item_id / 10.0 AS VARCHAR) AS DOUBLE), 0.0))) AS clipped, round(-log2(greatest(item_id / 50.0, 1e-12)), 6) + 0.0 AS bits FROM benchmark WHERE text IS NOT NULL AND length(trim(text)) > 0""".replace("\\\\", "\\"))
def scalar_rules(spark, d):
    """Null and blank checks, white space, numbers from text and information units."""
    b = table(spark, d, "benchmark").na.drop(subset=["text"]).where(F.length(F.trim("text")) > 0)
    return b.select(
        "item_id", F.length("text").cast("long").alias("n"), X.squash_ws(F.trim("text")).alias("squashed"),
        X.coerce01((F.col("item_id") / 10.0).cast("string")).alias("clipped"), rounded(X.neg_log_prob(F.col("item_id") / 50.0)).alias("bits"),
    )


@query("SELECT source, min(doc_id) AS first FROM documents GROUP BY source")
def first_appearance(spark, d):
    return A.first_appearance(table(spark, d, "documents"), "source", "doc_id")
