"""Registered queries of the training-data operators and, where SQL can say them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm import (bpe, decontamination, exact_dedup, licenses, line_dedup, lm_scoring, packing, quality, ranked_search, runs,
                             secrets, sharding, simhash)
from ledgerscope.llm.common import table
from ledgerscope.llm.subwords import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def id_remainder(n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


OP1_SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS page, doc_id, text, coalesce(source, '') AS host,
                      string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT host, count(*) AS host_pages FROM pages GROUP BY host),
counts AS (SELECT host, line, count(*) AS n FROM
             (SELECT DISTINCT page, host, trim(u.l, ' ' || chr(9) || chr(13)) AS line FROM pages, unnest(lines) AS u(l))
           WHERE line <> '' GROUP BY host, line),
boiler AS (SELECT c.host, list(c.line) AS bad FROM counts c JOIN totals t USING (host)
           WHERE c.n >= {line_dedup.MIN_PAGES} AND c.n > {line_dedup.RATIO} * t.host_pages GROUP BY c.host),
cut AS (SELECT p.doc_id, p.text, p.lines, list_filter(p.lines, lambda x:
            NOT list_contains(coalesce(b.bad, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept
        FROM pages p LEFT JOIN boiler b USING (host))
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(kept) = len(lines) THEN text
                    ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
       coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped FROM cut
"""


@register("op1_line_dedup", OP1_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the lines taken out that are on more than one in twenty-five of their source's documents."""
    docs = table(spark, sf_dir, "documents")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


@register("op2_lm_scoring")
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learnt from ids whose remainder of 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_scoring.score_texts(docs, id_remainder(7) != 2, tokenizer_path())
    return scored.select("doc_id", (id_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
                         "attention_score")


OP3_SQL = """
WITH t AS (SELECT doc_id, encode(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM t
"""


@register("op3_exact_dedup", OP3_SQL)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the largest id among those of equal text (A-Z lower-cased)."""
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"), keep="largest")


@register("op4_benchmark_decontamination")
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) of which the document holds question and answer, with the best passage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.mark_leaks(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def _canonical_sql(text: str) -> str:
    out = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace({out}, '{licenses.COPYRIGHT_LINE}', chr(10), 'g')"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim(regexp_replace({out}, '{licenses._GAPS}', ' ', 'g'))"


_KNOWN = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in licenses.known_texts() + licenses.bare_names())
# Every line by itself; a run is a start and an end line whose distance in characters is the length of a known text.
OP5_SQL = f"""
WITH forms AS (SELECT license_id, {_canonical_sql("text")} AS form FROM (VALUES {_KNOWN}) AS k(license_id, text)),
known AS (SELECT sha256(form) AS digest, min(license_id) AS license_id FROM forms GROUP BY 1),
sizes AS (SELECT DISTINCT string_split(form, ' ')[1] AS head, length(form) AS size FROM forms),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_split_to_array(text, '\n[ \t\r]*\n') AS parts FROM documents WHERE text <> ''),
paragraphs AS (SELECT rid, doc_id, len(parts) AS ps, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS paragraph FROM docs),
cut AS (SELECT *, string_split(part, chr(10)) AS ls FROM paragraphs),
lines AS (SELECT rid, doc_id, ps, paragraph, len(ls) AS n, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS line FROM cut),
clean AS (SELECT *, {_canonical_sql("raw")} AS form FROM lines),
worded AS (SELECT *, row_number() OVER d AS seq, row_number() OVER p AS place, count(*) OVER (PARTITION BY rid, paragraph) AS of_lines,
             sum(length(form) + 1) OVER d AS until, sum(length(form) + 1) OVER (PARTITION BY rid) - 1 AS total
           FROM clean WHERE form <> '' WINDOW d AS (PARTITION BY rid ORDER BY paragraph, line), p AS (PARTITION BY rid, paragraph ORDER BY line)),
found AS (
  SELECT rid, doc_id, 'text' AS scope, 0 AS paragraph, 0 AS line, string_agg(form, ' ' ORDER BY paragraph, line) AS form FROM worded GROUP BY rid, doc_id
  UNION ALL SELECT rid, doc_id, 'paragraph', paragraph, 0, string_agg(form, ' ' ORDER BY line) FROM worded WHERE ps > 1 GROUP BY rid, doc_id, paragraph
  UNION ALL SELECT rid, doc_id, 'line', paragraph, line, form FROM worded WHERE n > 1),
spans AS (SELECT s.rid, s.doc_id, s.paragraph, s.line, s.seq AS a, e.seq AS b FROM worded s
          JOIN sizes k ON k.head = string_split(s.form, ' ')[1]
          JOIN worded e ON e.rid = s.rid AND e.seq > s.seq AND e.until - s.until + length(s.form) = k.size
          WHERE k.size < s.total AND NOT (s.place = 1 AND e.paragraph = s.paragraph AND e.place = e.of_lines)),
runs AS (SELECT s.rid, s.doc_id, 'run' AS scope, s.paragraph, s.line, string_agg(w.form, ' ' ORDER BY w.seq) AS form
         FROM spans s JOIN worded w ON w.rid = s.rid AND w.seq BETWEEN s.a AND s.b GROUP BY s.rid, s.doc_id, s.paragraph, s.line, s.a, s.b)
SELECT doc_id, scope, paragraph::INTEGER AS paragraph, line::INTEGER AS line, license_id, digest
FROM (SELECT *, sha256(form) AS digest FROM (SELECT * FROM found UNION ALL SELECT * FROM runs)) JOIN known USING (digest)
"""


@register("op5_license_scan", OP5_SQL)
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, paragraph, line and run of lines of the documents that is a known licence, notice or licence name."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@register("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the numbers of its fixed matches, their digest, and all spans."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", of_kind("assign"), of_kind("access"), of_kind("hex"),
                        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
                        of_kind("markov"))


@register("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest id of its component (at most 3 differing bits a link)."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@register("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document, each a sequence of its own without padding."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), max_length=2048, end_id=1, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


@register("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in one of 16 shards, whose row counts are at most one apart."""
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame, learn: Column | None = None) -> quality.QualityModel:
    """Model learnt from ``docs``; ``learn``: which ids may be learnt from (all unless given)."""
    labels = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    if learn is not None:
        labels, docs = labels.where(learn), docs.where(learn)
    return quality.fit_quality(docs, labels)


@register("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from ids whose remainder of 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(spark, sf_dir, docs, id_remainder(5) != 0)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "score", "predicted")


_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS_SQL} AS terms FROM documents),
totals AS (SELECT count(*) AS nn, sum(len(terms))::BIGINT AS ll FROM docs WHERE len(terms) > 0),
postings AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term, nn),
items AS (SELECT row_number() OVER () AS qid, item_id, {_TERMS_SQL} AS terms FROM benchmark),
asked AS (SELECT qid, item_id, term, count(*) AS q FROM (SELECT qid, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
scores AS (SELECT qid, item_id, rid, doc_id,
             sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))))::BIGINT AS score
           FROM asked JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY qid, item_id, rid, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@register("op11_ranked_search", OP11_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of the highest score for every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where a tenth of the ids' checksums fall, the words from a place on repeat with a period (a fixed rule of the query)."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")).otherwise("")

    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "[ \\x09-\\x0D]+"), lambda w: w != "")
    bound = F.transform(F.array(words), planted)[0]  # a lambda's variable: the words are split once
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, bound).otherwise(F.col("text")).alias("text"))


OP12_SQL = r"""
WITH bits AS (SELECT list(list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
              FROM range(256) AS r(b)),
hashed AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
             xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                 lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM documents, bits),
placed AS (SELECT *, len(words) AS n, h // 10 AS g, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM hashed),
docs AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i >= a
             THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE words END AS words FROM placed),
tokens AS (SELECT rid, n, unnest(words) AS w, unnest(range(n)) AS i FROM docs),
matches AS (SELECT x.rid, x.i, x.i - y.i AS d FROM tokens x JOIN tokens y ON x.rid = y.rid AND x.w = y.w AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
islands AS (SELECT rid, d, i, i - row_number() OVER (PARTITION BY rid, d ORDER BY i) AS island FROM matches),
stretches AS (SELECT rid, d, min(i) - d AS start, count(*) + d AS length FROM islands GROUP BY rid, d, island HAVING count(*) + d >= greatest(6, 4 * d)),
runs AS (SELECT rid, start, length, min(d) AS period FROM stretches GROUP BY rid, start, length),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY (length // period) DESC, ((length % period)::DOUBLE / period) DESC, start, period) AS r
         FROM runs) WHERE r = 1),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS txt FROM runs GROUP BY rid),
dropped AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS txt FROM tokens ANTI JOIN dropped USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(l.txt, '')) AS runs_sha256, sha256(coalesce(k.txt, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed l USING (rid) LEFT JOIN best b USING (rid) LEFT JOIN kept k USING (rid)
"""


@register("op12_periodic_runs", OP12_SQL)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of runs, its run of the greatest exponent, and digests of all runs and of the text without repeats."""
    found = runs.find_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
                    F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


@register("op13_bpe")
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's byte-level BPE ids (number and digest) and the digest of the text decoded from them."""
    path = tokenizer_path("byte_bpe_50k.json")
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "n_tokens", "ids")
    decoded = bpe.decode_ids(encoded, path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
