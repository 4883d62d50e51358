"""Segments: the turns of a conversation are the segments of a transcript; a turn starts at 10 * turn and lasts 8."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from minutespark.functions import times
from minutespark.operators import languages
from minutespark.operators import segments as seg
from minutespark.operators.folds import parts_for
from minutespark.plans.registry import Tables, query
from minutespark.sources import captions


def rows(t: Tables):
    start = F.col("turn") * 10.0
    return t.conversations.select("conv_id", "turn", "role", start.alias("start"), (start + 8.0).alias("end"), "text")


def transcripts(t: Tables):
    item = F.struct("turn", "start", "end", "text")
    out = rows(t).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return out.select("conv_id", F.transform("s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))).alias("segments"))


@query("SELECT conv_id, turn AS pos, turn * 10.0::DOUBLE + 5 AS start, turn * 10.0::DOUBLE + 13 AS finish FROM conversations")
def seg1_shift(t: Tables):
    shifted = transcripts(t).select("conv_id", F.posexplode(seg.shift(F.col("segments"), 5.0)).alias("pos", "s"))
    return shifted.select("conv_id", F.col("pos").cast("long").alias("pos"), "s.start", F.col("s.end").alias("finish"))


@query("SELECT doc_id, greatest(1, ceil(floor(n_chars) / 900))::BIGINT AS chunks, greatest(0, least(900, n_chars - 2 * 900))::DOUBLE AS third FROM documents")
def seg2_chunk_math(t: Tables):
    d = F.col("n_chars").cast("double")
    return t.documents.select("doc_id", seg.chunk_count(d, 900).alias("chunks"), seg.chunk_length(d, F.lit(2), 900).alias("third"))


@query()
def seg4_merge_chunks(t: Tables):
    """Chunks of four turns, each beginning with the last turn of the one before; the seams (seg3, win15)
    are found by their words and merged."""
    base = rows(t).withColumn("chunk", F.floor(F.col("turn") / 4))
    again = base.where("turn % 4 = 3").withColumn("chunk", F.col("chunk") + 1)
    return seg.merge_chunks(base.unionByName(again), "conv_id", "chunk", "turn")


@query()
def seg5_hallucination(t: Tables):
    """All rules for invented text (seg5a, seg5b, seg6, seg7, win9, win10)."""
    return seg.hallucination_flags(rows(t), "conv_id", "turn")


@query()
def seg8_audit(t: Tables):
    """Conversations with a label count as transcribed; the second page of twenty unflagged ones, and all flagged ones."""
    jobs = t.labels.select(F.col("doc_id").alias("job")).distinct()
    versions = t.conversations.select("conv_id").distinct().join(jobs, F.col("conv_id") == F.col("job"), "left")
    return seg.audit(rows(t), "conv_id", "turn", versions, 1, 20)


@query()
def win9_repetition_runs(t: Tables):
    return seg.repetition_runs(rows(t), "conv_id", "turn")


@query()
def seg9_rollup_dedupe(t: Tables):
    """Rolling captions made from the texts' words, twelve at a time with six repeated, and back."""
    words = F.array(F.split(F.regexp_replace("text", r"\s+", " "), " "))
    # Bound by the outer lambda, a text's words are split once and not for every cue.
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / 6).cast("int")), lambda i: F.array_join(F.slice(w, i * 6 + 1, 12), " ")))
    # Texts are dealt out by track before they become cues, which are twice as large, to more tasks the more there is of them.
    n = parts_for(t.documents, "text")
    parts = t.documents.select("doc_id", "text").repartition(n, "doc_id").select("doc_id", F.posexplode(F.get(each, F.lit(0))).alias("pos", "text"))
    cues = parts.select("doc_id", "pos", F.col("pos").cast("double").alias("start"), (F.col("pos") + 1).cast("double").alias("end"), "text")
    return seg.dedupe_rollup_tracks(cues, "doc_id", "pos", n)


@query()
def win8_rollup_ratio(t: Tables):
    return seg.rollup_ratio(rows(t), "conv_id", "turn")


@query("""
SELECT doc_id, CASE WHEN n_chars < 100 THEN 'too_short' WHEN lang <> 'en' THEN 'language' WHEN quality IS NULL THEN 'unrated' WHEN toxic = 1 THEN 'flagged' ELSE 'rewrite' END AS verdict,
 CASE WHEN n_chars / 1000.0 >= 0.40 THEN 'matched' ELSE 'weak' END AS band FROM documents LEFT JOIN labels USING (doc_id)""")
def seg10_rewrite_gate(t: Tables):
    """Ordered reasons and confidence band (seg11)."""
    verdict = F.when(F.col("n_chars") < 100, "too_short").when(F.col("lang") != "en", "language").when(F.col("quality").isNull(), "unrated").when(F.col("toxic") == 1, "flagged").otherwise("rewrite")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", verdict.alias("verdict"), F.when(F.col("n_chars") / 1000 >= 0.40, "matched").otherwise("weak").alias("band"))


@query()
def seg12_shouting(t: Tables):
    loud = rows(t).withColumn("text", F.when(F.col("conv_id") % 2 == 0, F.upper("text")).otherwise(F.col("text")))
    return seg.shouting_fixed(loud, "conv_id").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def seg13_garbled(t: Tables):
    return t.documents.select("doc_id", seg.garbled(F.col("text")).alias("garbled"))


@query("SELECT doc_id, '» ' || 'a & b < ' || lang AS text FROM documents")
def seg14_speaker_marks(t: Tables):
    return t.documents.select("doc_id", seg.speaker_marks(F.concat(F.lit("&gt;&gt; a &amp; b &lt; "), F.col("lang"))).alias("text"))


@query("SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS content_hash FROM conversations GROUP BY 1")
def seg16_content_hash(t: Tables):
    return transcripts(t).select("conv_id", seg.content_hash(F.col("segments")).alias("content_hash"))


@query("SELECT conv_id, count(*) = 2 AND count(DISTINCT role) = 2 AS copied FROM conversations GROUP BY 1")
def seg17_copied_agenda(t: Tables):
    """Whether segments equal an agenda (here: the first user and assistant texts)."""
    agenda = rows(t).where("turn < 2").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("a"))
    both = transcripts(t).join(agenda, "conv_id", "left")
    same = F.transform("segments", lambda s: s["text"]) == F.transform("a", lambda s: s["text"])
    return both.select("conv_id", F.coalesce(same & (F.size("a") == 2), F.lit(False)).alias("copied"))


@query("SELECT conv_id, turn, turn = min(CASE WHEN role = 'assistant' THEN turn ELSE turn + 1000 END) OVER (PARTITION BY conv_id) AS is_default FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant')")
def seg18_promote_one_default(t: Tables):
    chosen = t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("target"))
    return t.conversations.join(chosen, "conv_id").select("conv_id", "turn", (F.col("turn") == F.col("target")).alias("is_default"))


@query("SELECT doc_id, (n_chars = 0 OR (lang = 'en' AND quality IS NULL)) AS improves FROM documents LEFT JOIN labels USING (doc_id)")
def seg19_improvement(t: Tables):
    rows_ = t.documents.join(t.labels, "doc_id", "left")
    return rows_.select("doc_id", ((F.col("n_chars") == 0) | ((F.col("lang") == "en") & F.col("quality").isNull())).alias("improves"))


@query("SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY -turn) AS turns FROM conversations GROUP BY 1")
def seg20_sort_by_start(t: Tables):
    back = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (-F.col("turn")).cast("double").alias("start"), (-F.col("turn")).cast("double").alias("end"), F.col("turn").cast("string").alias("text")))).alias("s"))
    return back.select("conv_id", F.array_join(F.transform(seg.sort_by_start(F.col("s")), lambda s: s["text"]), ",").alias("turns"))


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY 1")
def seg21_flatten(t: Tables):
    nested = t.conversations.groupBy("conv_id", "role").agg(F.collect_list("turn").alias("inner"))
    flat = nested.where("role <> 'system'").groupBy("conv_id").agg(F.flatten(F.collect_list("inner")).alias("all"))
    return flat.select("conv_id", F.size("all").cast("long").alias("n"))


@query("""
SELECT source, doc_id AS chosen, count(*) OVER (PARTITION BY source) - 1 AS alternates FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY lang <> 'de', doc_id) = 1""")
def seg24_track_selection(t: Tables):
    best = t.documents.groupBy("source").agg(F.min_by("doc_id", F.struct(F.col("lang") != "de", "doc_id")).alias("chosen"), (F.count("*") - 1).alias("alternates"))
    return best


@query("SELECT doc_id, concat_ws(',', CASE WHEN n_chars = 3000 THEN 'cut' END, CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN n_chars > 20000 THEN 'long' END) AS warnings FROM documents")
def seg25_warning_ladder(t: Tables):
    w = F.array_compact(F.array(F.when(F.col("n_chars") == 3000, "cut"), F.when(F.col("lang") != "en", "language"), F.when(F.col("n_chars") > 20000, "long")))
    return t.documents.select("doc_id", F.array_join(w, ",").alias("warnings"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) AS n FROM documents")
def seg26_untimed_lines(t: Tables):
    return captions.untimed(t.documents.select("doc_id", "text"), "text").groupBy("doc_id").agg(F.count("*").alias("n")).join(t.documents.select("doc_id"), "doc_id", "right").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT doc_id, CASE WHEN regexp_matches(source, '1$') THEN source || ' ' || lang ELSE coalesce(nullif(source, ''), lang) END AS title FROM documents")
def seg27_metadata_ladder(t: Tables):
    return t.documents.select("doc_id", F.when(F.col("source").rlike("1$"), F.concat_ws(" ", "source", "lang")).otherwise(F.coalesce(F.nullif("source", F.lit("")), "lang")).alias("title"))


@query("SELECT conv_id, count(*) AS n, max(turn * 10.0 + 8)::DOUBLE AS finish FROM conversations GROUP BY 1")
def seg23_snippets(t: Tables):
    """Caption snippets of start and duration as segments."""
    snippets = rows(t).select("conv_id", "start", (F.col("end") - F.col("start")).alias("duration"), "text")
    made = snippets.select("conv_id", "start", (F.col("start") + F.col("duration")).alias("end"), seg.speaker_marks(F.col("text")).alias("text"))
    return made.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("end").alias("finish"))


@query("SELECT event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS finish FROM events")
def win7_end_from_next(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.lead("ts").over(w).alias("finish"))


@query("""
WITH c AS (SELECT conv_id, turn, (turn * 7 % 5) * 10.0::DOUBLE AS start FROM conversations)
SELECT a.conv_id, a.turn, a.start, (SELECT min_by(b.start, b.turn) FROM c b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.start > a.start) AS finish FROM c a""")
def win6_clip_ends(t: Tables):
    """The end of a clip is the first later start that is larger."""
    c = t.conversations.select("conv_id", "turn", ((F.col("turn") * 7 % 5) * 10.0).cast("double").alias("start"))
    return c.join(seg.next_larger_start(c, "conv_id", "turn", "start", "finish"), ["conv_id", "turn"])


@query()
def win11_word_groups(t: Tables):
    """Errors of a user grouped while within a day of the group's first."""
    words = t.events.where("event_type = 'error'").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), F.col("event_id").cast("string").alias("w"))
    return seg.group_by_elapsed(words, "user_id", "event_id", "s", "w", 86_400.0)


@query("""
SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events)) GROUP BY 1, 2""")
def win12_gap_sessions(t: Tables):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return seg.split_on_gap(t.events, "user_id", ["ts", "event_id"], us, us, 6 * 3600 * 1e6).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("SELECT conv_id, CASE WHEN max(turn) >= 2 THEN 2 ELSE max(turn) END AS at FROM conversations GROUP BY 1")
def jn10_active_segment(t: Tables):
    """The segment that plays at 25 seconds."""
    return transcripts(t).select("conv_id", seg.active_segment(F.col("segments"), F.lit(25.0)).cast("long").alias("at"))


def held_out():
    """Texts by which the detector is judged, and which it is not trained on."""
    return F.endswith(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("0"))


def language_model(t: Tables):
    return languages.train(t.documents.where(~held_out()), "text", "lang")


@query("""
WITH words AS (SELECT doc_id, lang, ends_with(md5(doc_id::VARCHAR), '0') AS held_out, ' ' || unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) || ' ' AS w FROM documents),
grams AS (SELECT doc_id, lang, held_out, substr(w, unnest(range(1, length(w) - 1)), 3) AS gram FROM words WHERE length(w) BETWEEN 3 AND 42),
kept AS (SELECT gram FROM grams WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, gram LIMIT 50000),
cells AS (SELECT k.gram, l.lang, count(g.gram) AS c FROM kept k CROSS JOIN (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL AND NOT ends_with(md5(doc_id::VARCHAR), '0')) l
 LEFT JOIN (SELECT * FROM grams WHERE NOT held_out) g ON g.gram = k.gram AND g.lang = l.lang GROUP BY 1, 2),
model AS (SELECT gram, lang, round(ln((c + 0.5) / (sum(c) OVER (PARTITION BY lang) + 0.5 * count(*) OVER (PARTITION BY lang))) * 10000)::BIGINT AS s FROM cells),
sums AS (SELECT doc_id, m.lang, sum(s) AS s FROM grams JOIN model m USING (gram) GROUP BY 1, 2),
best AS (SELECT doc_id, lang AS detected FROM sums QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1)
SELECT lang, detected, ends_with(md5(doc_id::VARCHAR), '0') AS held_out, count(*) AS n FROM documents LEFT JOIN best USING (doc_id) GROUP BY 1, 2, 3""")
def agg27_detected_language(t: Tables):
    """Detected against given language, of texts trained on and of others: the confusion table."""
    named = languages.detect(t.documents, ["doc_id", "lang"], "text", language_model(t))
    return named.groupBy("lang", "detected", held_out().alias("held_out")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn AS pos, turn * 10.0::DOUBLE AS start, turn * 10.0::DOUBLE + 8 AS finish, md5(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS text_md5 FROM conversations")
def src6_vtt(t: Tables):
    """WebVTT written from the transcripts and parsed again."""
    line = F.transform("segments", lambda s: F.concat(F.replace(times.srt_time(s["start"]), F.lit(","), F.lit(".")), F.lit(" --> "), F.replace(times.srt_time(s["end"]), F.lit(","), F.lit(".")), F.lit("\n"), F.trim(F.regexp_replace(s["text"], r"\s+", " "))))
    files = transcripts(t).select("conv_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(line, "\n\n")).alias("body"))
    return captions.parse_vtt(files, "body").select("conv_id", "pos", "start", F.col("end").alias("finish"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT conv_id, turn AS pos, turn * 10.0::DOUBLE AS start, turn * 10.0::DOUBLE + 8 AS finish, md5(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS text_md5 FROM conversations")
def src7_srt(t: Tables):
    """SRT written from the transcripts (snk10) and parsed again."""
    files = captions.to_srt(transcripts(t).select("conv_id", F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.trim(F.regexp_replace(s["text"], r"\s+", " ")).alias("text"))).alias("segments")), "segments", "body")
    return captions.parse_srt(files.select("conv_id", "body"), "body").select("conv_id", "pos", "start", F.col("end").alias("finish"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT conv_id, turn AS pos, turn * 10.0::DOUBLE AS start, turn * 10.0::DOUBLE + 8 AS finish, md5(regexp_replace(trim(text), '\\s+', ' ', 'g') || ' & more') AS text_md5 FROM conversations")
def src8_ttml(t: Tables):
    """Timed text with prefixes, nested elements and entities, written from the transcripts and parsed again."""
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.transform("segments", lambda s: F.concat(F.lit('<tt:p begin="'), s["start"].cast("string"), F.lit('s" end="'), s["end"].cast("string"), F.lit('s"><tt:span>'), escaped(s["text"]), F.lit("</tt:span><tt:br/>&amp; more</tt:p>")))
    files = transcripts(t).select("conv_id", F.concat(F.lit('<tt:tt xmlns:tt="http://www.w3.org/ns/ttml"><tt:body>'), F.array_join(line, ""), F.lit("</tt:body></tt:tt>")).alias("body"))
    return captions.parse_ttml(files, "body").select("conv_id", "pos", "start", F.col("end").alias("finish"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT page_id, len(list_filter(string_split(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), chr(10)), lambda s: trim(s) <> '')) AS lines FROM pages")
def src9_unknown_captions(t: Tables):
    return t.pages.select("page_id", F.size(captions.plain_lines(F.col("html"))).cast("long").alias("lines"))


@query("SELECT page_id, CASE WHEN contains(url, '.html') THEN 'unknown' ELSE 'vtt' END AS format FROM pages")
def src10_dispatch(t: Tables):
    named = F.when(F.contains("url", F.lit(".html")), F.col("url")).otherwise(F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit(".VTT?x=1")))
    return t.pages.select("page_id", captions.format_of(named).alias("format"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def src11_decode(t: Tables):
    return t.documents.select("doc_id", F.md5(captions.decode_bytes(F.col("text").cast("binary")).cast("binary")).alias("text_md5"))


@query("SELECT conv_id, md5(string_agg('[' || (turn * 10 // 60) || ':' || lpad((turn * 10 % 60)::VARCHAR, 2, '0') || '] ' || text, chr(10) ORDER BY turn)) AS body_md5 FROM conversations GROUP BY 1")
def snk11_text_export(t: Tables):
    return captions.to_txt(transcripts(t), "segments", "body").select("conv_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("SELECT conv_id, turn AS pos, turn * 10.0::DOUBLE AS start, coalesce(lead(turn * 10.0::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn), turn * 10.0::DOUBLE) AS finish FROM conversations")
def win16_line_transcript(t: Tables):
    """One line per cue, '[m:ss] text'; the end comes from the next."""
    files = captions.to_txt(transcripts(t).select("conv_id", F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("x").alias("text"))).alias("segments")), "segments", "body")
    return captions.parse_lines(files.select("conv_id", "body"), "conv_id", "body").select("conv_id", "pos", "start", F.col("end").alias("finish"))


@query()
def seg15_language_samples(t: Tables):
    """The detected language of evenly spaced samples, weighted by characters (agg27)."""
    chunks = t.documents.select("doc_id", F.posexplode(seg.sample_chunks(F.col("text"))).alias("at", "chunk"))
    weighted = chunks.withColumn("w", F.length("chunk").cast("long"))
    votes = languages.detect(weighted, ["doc_id", "at"], "chunk", language_model(t), total="w").where("detected is not null")
    by_language = votes.groupBy("doc_id", "detected").agg(F.sum("w").alias("w"))
    return by_language.groupBy("doc_id").agg(F.max_by("detected", F.struct("w", "detected")).alias("lang"))


@query("SELECT conv_id, count(*) + 1 AS blocks FROM conversations GROUP BY 1")
def seg22_transcript_blocks(t: Tables):
    """Texts with a disclaimer before each, parsed into blocks."""
    said = F.transform("segments", lambda s: F.concat(F.lit("DISCLAIMER: auto\n\n"), F.regexp_replace(s["text"], r"\s*\n\s*", " ")))
    files = transcripts(t).select("conv_id", F.array_join(said, "\n\n").alias("body"))
    return seg.transcript_blocks(files, "conv_id", "body", "^DISCLAIMER").groupBy("conv_id").agg(F.count("*").alias("blocks"))


@query("SELECT p_partkey, string_split(p_name, ' ') AS parts FROM part")
def str19_word_segmentation(t: Tables):
    """Part names without their space, taken apart by the words of part names."""
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    joined = t.part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("label"))
    return seg.segment_words(joined, words, "label", "w").select("p_partkey", "parts")
