"""Search over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from minutespark.operators import fulltext, search, trigrams
from minutespark.operators import relational as rel
from minutespark.plans.registry import Tables, query
from minutespark.plans.stem_sql import stems
from minutespark.streaming.streams import work_folder

Q = search.parse_query('"of the" with -here +that and')
EXACT = "contains(lower(text), 'of the') AND contains(lower(text), 'with') AND contains(lower(text), 'that') AND NOT contains(lower(text), 'here')"


@query(f"""
SELECT d.doc_id, d.source AS platform, d.lang, coalesce(l.quality, -1) AS quality, count(*) OVER () AS total
FROM documents d LEFT JOIN (SELECT * FROM labels WHERE toxic = 0) l USING (doc_id)
WHERE lang = 'en' AND {EXACT} ORDER BY n_chars DESC, doc_id DESC LIMIT 20 OFFSET 20""")
def flt1_list_pages(t: Tables):
    """Faceted listing with keyword search, default-version join, total and page 2 of 20 rows."""
    defaults = t.labels.where("toxic = 0").select("doc_id", "quality")
    rows = t.documents.where((F.col("lang") == "en") & search.matches_exactly(F.lower("text"), Q)).join(defaults, "doc_id", "left")
    found = rows.select("doc_id", "source", "lang", "quality", "n_chars")
    page = rel.page_with_total(found, [F.desc("n_chars"), F.desc("doc_id")], 20, 20)
    return page.select("doc_id", F.col("source").alias("platform"), "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), "total")


@query(f"SELECT doc_id FROM documents WHERE {EXACT}")
def txt4_exact_search(t: Tables):
    return t.documents.where(search.matches_exactly(F.lower("text"), Q)).select("doc_id")


FUZZY = search.parse_query("thatt withh -trash")


@query("""
SELECT doc_id FROM documents WHERE
  len(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda t: abs(length(t) - 5) <= 1 AND levenshtein(t, 'thatt') <= 1)) > 0
  AND len(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda t: abs(length(t) - 5) <= 1 AND levenshtein(t, 'withh') <= 1)) > 0
  AND NOT contains(lower(text), 'trash')""")
def txt5_fuzzy_search(t: Tables):
    return t.documents.where(search.matches_fuzzily(F.lower("text"), FUZZY)).select("doc_id")


@query("""
WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM documents),
n AS (SELECT word FROM v WHERE levenshtein(word, 'thatt') <= 1 AND length(word) <= 255)
SELECT DISTINCT d.doc_id FROM documents d JOIN n ON contains(lower(d.text), n.word)""")
def txt8_vocabulary_fuzzy(t: Tables):
    q = search.parse_query("thatt")
    return search.fuzzy_by_vocabulary(t.documents, "doc_id", "text", q, search.vocabulary(t.documents, "text")).withColumnRenamed("id", "doc_id")


@query("""
SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM documents) WHERE length(word) <= 255""")
def txt16_vocabulary(t: Tables):
    return search.vocabulary(t.documents, "text")


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS n_tokens FROM documents")
def txt3_tokens(t: Tables):
    return t.documents.select("doc_id", F.size(search.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("""
SELECT doc_id, md5(lower(concat_ws(' ', nullif(source, ''), nullif(lang, ''), nullif(text, '')))) AS corpus_md5 FROM documents""")
def txt2_corpus(t: Tables):
    return t.documents.select("doc_id", F.md5(search.corpus(F.col("source"), F.col("lang"), F.col("text")).cast("binary")).alias("corpus_md5"))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""
WITH h AS (SELECT doc_id, text, CASE WHEN instr(lower(text), 'of the') > 0 THEN instr(lower(text), 'of the') WHEN instr(lower(text), 'under') > 0 THEN instr(lower(text), 'under') END AS pos,
  CASE WHEN instr(lower(text), 'of the') > 0 THEN 6 ELSE 5 END AS n FROM documents)
SELECT doc_id, CASE WHEN pos - 50 > 1 THEN '…' ELSE '' END || {_ESC.format("substring(text, greatest(pos - 50, 1), pos - greatest(pos - 50, 1))")} || '<mark>' ||
  {_ESC.format("substring(text, pos, n)")} || '</mark>' || {_ESC.format("substring(text, pos + n, 50)")} || CASE WHEN pos + n + 50 <= length(text) THEN '…' ELSE '' END AS snippet
FROM h WHERE pos IS NOT NULL""")
def txt12_snippet(t: Tables):
    q = search.parse_query('"of the" under')
    return t.documents.select("doc_id", search.snippet(F.col("text"), q).alias("snippet")).where("snippet is not null")


@query("""
SELECT conv_id, turn, role, instr(lower(text), 'that') - 1 AS at FROM conversations WHERE contains(lower(text), 'that')
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
def txt13_first_segment(t: Tables):
    """The first segment of each transcript that holds the term."""
    hits = t.conversations.where(F.contains(F.lower("text"), F.lit("that")))
    first = hits.groupBy("conv_id").agg(F.min(F.struct("turn", "role", (F.instr(F.lower("text"), F.lit("that")) - 1).cast("long").alias("at"))).alias("m"))
    return first.select("conv_id", "m.*")


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN instr(lower(d.text), 'with') END AS shown_at
FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id) WHERE contains(lower(d.text), 'with')""")
def txt14_snippet_source(t: Tables):
    """Any version matches, only the default one gives an excerpt."""
    defaults = t.labels.where("quality = 1").select("doc_id", F.lit(True).alias("default"))
    hits = t.documents.where(F.contains(F.lower("text"), F.lit("with"))).join(defaults, "doc_id", "left")
    return hits.select("doc_id", F.when(F.col("default"), F.instr(F.lower("text"), F.lit("with")).cast("long")).alias("shown_at"))


@query("SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS n FROM documents")
def txt15_count_in_text(t: Tables):
    return t.documents.select("doc_id", search.count_occurrences(F.col("text"), "the").alias("n"))


@query("""
SELECT doc_id, round(((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 + (length(lower(text)) - length(replace(lower(text), 'with', ''))) / 4) * 1000.0 / greatest(length(text), 1), 4) AS score
FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'with') ORDER BY score DESC, doc_id DESC LIMIT 50""")
def top4_relevance(t: Tables):
    """The 50 most relevant hits."""
    q = search.parse_query("the with")
    low = F.lower("text")
    rows = t.documents.where(search.matches_exactly(low, q)).select("doc_id", search.relevance(low, q).alias("score"))
    return rows.orderBy(F.desc("score"), F.desc("doc_id")).limit(50)


_WORDS = (
    r"""
WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents)),"""
    + stems("w", "w")
    + """,
s AS (SELECT doc_id, i, stem AS s FROM w JOIN stemmed ON word = w)"""
)


def _index(t: Tables):
    return fulltext.write_index(t.documents, "doc_id", "text", work_folder(t.spark, "index"))


@query(_WORDS + """,
h AS (SELECT doc_id, bool_or(s = 'wh') AS wh, bool_or(s = 'thing') AS thing, bool_or(s = 'nt') AS nt, bool_or(s = 'th' AND follows = 'nd') AS phrase
  FROM (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS follows FROM s) GROUP BY 1)
SELECT doc_id FROM h WHERE (wh AND thing) OR (phrase AND NOT nt)""")
def txt9_stemmed_search(t: Tables):
    """Stems, a phrase of stems, OR and an exclusion over the positional index."""
    return fulltext.search(_index(t), 'wh and the things or "th nd" -nt').select(F.col("id").alias("doc_id"))


@query(_WORDS + """,
k AS (SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS at FROM s WHERE s IN ('th', 'thing', 'wh')),
e AS (SELECT *, greatest(min(CASE WHEN s = 'th' THEN i END) OVER r, min(CASE WHEN s = 'thing' THEN i END) OVER r) AS q1, min(CASE WHEN s = 'wh' THEN i END) OVER r AS q2,
  min(CASE WHEN s = 'th' THEN i END) OVER r AS th, min(CASE WHEN s = 'thing' THEN i END) OVER r AS thing FROM k WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, least(CASE WHEN th IS NOT NULL AND thing IS NOT NULL THEN q1 END, q2) AS q FROM e),
g AS (SELECT *, lead(q) OVER (PARTITION BY doc_id ORDER BY i) AS q_next FROM f),
c AS (SELECT g.doc_id, g.i AS p, g.q, z.at - g.at + 1 AS own FROM g JOIN k z ON z.doc_id = g.doc_id AND z.i = g.q WHERE g.q IS NOT NULL AND (g.q_next IS NULL OR g.q_next > g.q))
SELECT doc_id, round(sum(0.1::DOUBLE / (1 + (q - p) - (own - 1))), 6) AS rank FROM c GROUP BY 1""")
def txt10_cover_rank(t: Tables):
    """Cover density of all texts that match."""
    found = fulltext.ranked(_index(t), "th things or wh")
    return found.select(F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


_TRIGRAMS = """
WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM documents),
t AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z0-9]+')) AS term FROM benchmark WHERE regexp_matches(text, '[A-Za-z0-9]')),
x AS (SELECT word, word AS name FROM v WHERE length(word) <= 255 UNION ALL SELECT NULL, term FROM t),
p AS (SELECT word, name, '  ' || unnest(regexp_split_to_array(name, '[^a-z0-9]+')) || ' ' AS part FROM x),
g AS (SELECT DISTINCT word IS NULL AS asked, name, unnest(list_transform(generate_series(1, length(part) - 2), lambda i: part[i:i + 2])) AS g FROM p WHERE length(part) > 3),
n AS (SELECT asked, name, count(*) AS n FROM g GROUP BY 1, 2),
c AS (SELECT a.name AS term, b.name AS word, count(*) AS common FROM g a JOIN g b ON a.asked AND NOT b.asked AND a.g = b.g GROUP BY 1, 2),
s AS (SELECT term, word, common / (a.n + b.n - common) AS similarity FROM c JOIN n a ON a.asked AND a.name = term JOIN n b ON NOT b.asked AND b.name = word),
r AS (SELECT *, levenshtein(word, term) AS distance FROM s WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY term ORDER BY similarity DESC, word) <= 50),
k AS (SELECT * FROM r WHERE distance <= CASE WHEN length(term) <= 4 THEN 0 WHEN length(term) <= 7 THEN 1 ELSE 2 END)"""


def _first_words(t: Tables):
    """The first word of each benchmark item, as a table of search terms."""
    return t.benchmark.select(F.lower(F.regexp_extract("text", "[A-Za-z0-9]+", 0)).alias("term")).where("term <> ''").distinct()


@query(_TRIGRAMS + " SELECT term, word, round(similarity, 6) AS similarity, distance FROM k")
def txt8_trigram_candidates(t: Tables):
    """The vocabulary words that stand for each term of a table: the 50 most similar by trigrams, within the tolerated edits."""
    found = trigrams.near_terms(search.vocabulary(t.documents, "text"), _first_words(t))
    return found.select("term", "word", F.round("similarity", 6).alias("similarity"), F.col("distance").cast("long").alias("distance"))


@query(_TRIGRAMS + """
SELECT term, count(DISTINCT doc_id) AS n, min(doc_id) AS first FROM (
  SELECT term, doc_id FROM k JOIN documents ON length(term) > 4 AND contains(lower(text), word) UNION ALL SELECT term, doc_id FROM t JOIN documents ON length(term) <= 4 AND contains(lower(text), term)) GROUP BY 1""")
def txt8_term_table(t: Tables):
    """How many texts each term finds, itself or by its near words."""
    found = trigrams.texts_near(t.documents, "doc_id", "text", _first_words(t), search.vocabulary(t.documents, "text"))
    return found.groupBy("term").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("""
SELECT d.doc_id, count(*) AS words_known FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS word FROM documents) d
JOIN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM benchmark) b USING (word) GROUP BY 1""")
def txt17_probe_vocabulary(t: Tables):
    """Documents against the vocabulary of saved probes."""
    words = search.vocabulary(t.benchmark, "text")
    held = t.documents.select("doc_id", F.explode(search.tokens(F.col("text"))).alias("word"))
    return held.join(words, "word").groupBy("doc_id").agg(F.count("*").alias("words_known"))


@query("""
WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM documents),
p AS (SELECT DISTINCT unnest(regexp_extract_all(lower(name), '[a-z0-9'']+')) AS probe FROM (SELECT p_name AS name FROM part))
SELECT probe, word, levenshtein(word, probe) AS distance FROM p JOIN v ON length(word) BETWEEN length(probe) - 1 AND length(probe) + 1 AND levenshtein(word, probe) <= 1""")
def jn15_vocabulary_similarity(t: Tables):
    """Words within one edit of a probe: one-deletion neighbourhoods make it an equi-join."""
    probes = search.vocabulary(t.part.select("p_name"), "p_name").toDF("probe")

    def neighbours(c: str):
        cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.left(F.col(c), i - 1), F.substring(F.col(c), i + 1, F.length(c))))
        return F.explode(F.array_distinct(F.concat(F.array(F.col(c)), cut))).alias("key")

    left = probes.select("probe", neighbours("probe"))
    right = search.vocabulary(t.documents, "text").select("word", neighbours("word"))
    pairs = left.join(right, "key").select("probe", "word").distinct()
    near = pairs.withColumn("distance", F.levenshtein("word", "probe", 1)).where("distance >= 0")
    return near.select("probe", "word", F.col("distance").cast("long").alias("distance"))


@query("""
WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM documents),
n AS (SELECT word FROM v WHERE levenshtein(word, 'thatt') <= 1 AND length(word) <= 255)
SELECT 'scan' AS path, doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'with')
UNION ALL SELECT DISTINCT 'vocabulary', d.doc_id FROM documents d JOIN n ON contains(lower(d.text), n.word)
UNION ALL SELECT 'index', doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['th', 'nd'])
UNION ALL SELECT DISTINCT 'fuzzy_scan', doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM documents) JOIN n USING (word)""")
def txt11_path_selection(t: Tables):
    """Which path a search takes, by what is at hand and whether it is fuzzy, and what it finds."""
    plain, typo = search.parse_query("the with"), search.parse_query("thatt")
    words = search.vocabulary(t.documents, "text")
    taken = [search.find(t.documents, "doc_id", "text", search.parse_query("th nd"), index=_index(t)), search.find(t.documents, "doc_id", "text", plain), search.find(t.documents, "doc_id", "text", typo, fuzzy=True, words=words), search.find(t.documents, "doc_id", "text", typo, fuzzy=True)]
    out = None
    for path, ids in taken:
        rows = ids.select(F.lit(path).alias("path"), F.col("id").alias("doc_id"))
        out = rows if out is None else out.unionByName(rows)
    return out
