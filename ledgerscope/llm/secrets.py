"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Fixed kinds (assign, access, hex) are found by regular expressions. Each of the two first-order Markov models is the mean
of two: random strings are learnt from the fixed matches of the corpus and from ``RANDOM_SAMPLE``, ordinary ones from the
whole runs of key characters of all documents that are too short to be judged (a longer one may be a key itself) and from
``ordinary_sample``, identifiers in the usual styles. So neither a corpus without identifiers nor one without secrets,
nor a very large one, takes the other half's place. Every other token long enough to be a key is scored by the
log-likelihood ratio of the two, and becomes a span of kind ``markov`` above the threshold, which is set on held-out
strings (tests).

DataFrame functions only. A text is cut at its matches once a pattern: the pieces between them give the places.
Spans become rows early (one row a match), so neither many matches in one text nor many texts gather anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.bounded import attach_global
from ledgerscope.llm.common import materialise, row_key, text_or_empty

#: Patterns of the fixed kinds, in the order in which kinds are listed at one start (fixed values).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN_MIN = 6
#: A candidate: a whole run of 16 key characters or more; the ratio alone decides.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: An ordinary sample: a whole run that is no candidate.
SHORT = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{2,15}(?![A-Za-z0-9+/_=-])"
#: Labelled random strings, the same for every corpus, from SHA-256 digests of 0, 1, ..., 255: base64, every other without its signs,
#: and, of 0 to 95, as many small letters, and the hexadecimal digits of half of each.
RANDOM_SAMPLE = [re.sub("[+/=]" if i % 2 else "=", "", base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode()) for i in range(256)]
RANDOM_SAMPLE += ["".join(chr(97 + b % 26) for b in hashlib.sha256(str(i).encode()).digest()) for i in range(96)]
RANDOM_SAMPLE += [hashlib.sha256(str(i).encode()).hexdigest()[:32] for i in range(96)]
#: Words of which ordinary identifiers are made.
WORDS = ("account action address admin align amount append apply array asset average back base batch begin block border bottom bucket "
         "buffer button byte call cancel case chain channel check class clean close cloud code color command commit config connect "
         "control copy create current data date delete depth device direct document domain driver edit email enable entry error example "
         "export feature field filter final folder format function gateway group handler height history import index insert instance "
         "invoice item key label large last level library line list local lock main manager master maximum message method model module "
         "name network object offset output owner page parent path payment phone plugin position price product profile property query "
         "range record release remote request response sample search section secure sender sequence service session shared short simple "
         "single small source special stack start state status storage string style submit success support switch system table task "
         "template theme thread time title topic total transfer tree type unique update upload value vector version video visible "
         "volume warning weight width window workflow workspace zone").split()
#: Styles of ordinary identifiers that ``ordinary_sample`` makes, in turn.
STYLES = ["snake", "camel", "pascal", "kebab", "constant", "path", "run", "date", "number"]
#: Natural-log likelihood ratio that a token needs, in all and per character pair.
MIN_TOTAL, MIN_MEAN = 5.5, 0.2
_WIDTH = 128
#: Key characters: the models' alphabet, for smoothing.
_ALPHABET = 26 + 26 + 10 + 5
#: Weight of the single-character frequencies, in pairs.
_BACK_OFF = 40


def identifier(style: str, words: list[str], seed: int) -> str:
    """An ordinary identifier of words drawn by the digest of the seed."""
    draw = iter(hashlib.sha256(f"{style} {seed}".encode()).digest())
    some = [words[(next(draw) * 256 + next(draw)) % len(words)] for _ in range(2 + next(draw) % 4)]
    digits = "".join(str(next(draw) % 10) for _ in range(1 + next(draw) % 3)) if next(draw) % 4 == 0 else ""
    title = [w.capitalize() for w in some]
    if style == "date":
        day = f"20{next(draw) % 40:02d}-{1 + next(draw) % 12:02d}-{1 + next(draw) % 28:02d}"
        return day + "-" + "".join(f"{next(draw) % 60:02d}" for _ in range(3)) if seed % 2 else day.replace("-", "") + f"T{next(draw) % 24:02d}{next(draw) % 60:02d}Z"
    if style == "number":
        return str(int(hashlib.sha256(str(seed).encode()).hexdigest(), 16))[:12 + next(draw) % 12]
    return {"snake": "_".join(some) + ("_" + digits if digits else ""), "camel": some[0] + "".join(title[1:]) + digits, "pascal": "".join(title) + digits,
            "kebab": "-".join(some) + ("-" + digits if digits else ""), "constant": "_".join(some).upper() + ("_" + digits if digits else ""),
            "path": "/" * (next(draw) % 2) + "/".join(some), "run": "".join(some)}[style]


def ordinary_sample(per_style: int = 400) -> list[str]:
    """Labelled ordinary identifiers, the same for every corpus."""
    return [identifier(style, WORDS, i) for i in range(per_style) for style in STYLES]


def _matches(docs: DataFrame, kind: str, pattern: str, column: str = "text") -> DataFrame:
    """(key, kind, start, end, match) of all leftmost non-overlapping matches; ``docs`` has one row a key.

    Texts are cut at the matches: a match starts after all pieces and matches before it.
    """
    hit = docs.where(F.col(column).rlike(pattern))
    parts = hit.select("key", F.split(column, pattern, -1).alias("pieces"), F.regexp_extract_all(column, F.lit(pattern), F.lit(0)).alias("found"))
    rows = parts.select("key", F.posexplode(F.arrays_zip("pieces", "found")).alias("i", "part"))
    upto = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("part.pieces") + F.coalesce(F.length("part.found"), F.lit(0))).over(upto)
    return (rows.select("key", end.alias("end"), F.col("part.found").alias("match")).where("match is not null")
            .select("key", F.lit(kind).alias("kind"), (F.col("end") - F.length("match")).alias("start"), "end", "match"))


def _value(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def _blanked(column: Column, pattern: str, passes) -> Column:
    """The text with the passing matches of a pattern replaced by as many blanks."""
    parts = F.arrays_zip(F.split(column, pattern, -1).alias("piece"), F.regexp_extract_all(column, F.lit(pattern), F.lit(0)).alias("found"))
    cut = F.array_join(F.transform(parts, lambda p: F.concat(p["piece"], F.coalesce(
        F.when(passes(p["found"]), F.repeat(F.lit(" "), F.length(p["found"]))).otherwise(p["found"]), F.lit("")))), "")
    return F.when(column.rlike(pattern), cut).otherwise(column)


def markov_table(samples: DataFrame) -> DataFrame:
    """One row: ``ratios``, the log-likelihood ratio of each character pair (code of the first * 128 + second).

    ``samples``: (random boolean, shipped boolean, sample string, n: how often). Counts cover all samples; in each of the four
    groups a pair backs off to the frequency of its second character, and the model of a kind is the mean of its
    groups that have samples. The table is a global aggregate of 128 * 128 numbers at most, whatever the samples.
    Without samples of either kind every ratio is zero.
    """
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("sample") - 1),
                                 lambda i: (F.ascii(F.substring("sample", i, 1)) * _WIDTH + F.ascii(F.substring("sample", i + 1, 1))).cast("int")))
    groups = {"r0": (True, False), "r1": (True, True), "o0": (False, False), "o1": (False, True)}
    counts = (samples.where(F.length("sample") > 1).select("random", "shipped", "n", pair.alias("pair")).groupBy("pair").agg(*[
        F.sum(F.when((F.col("random") == r) & (F.col("shipped") == s), F.col("n")).otherwise(0)).alias(g) for g, (r, s) in groups.items()]))
    spark = samples.sparkSession
    grid = (spark.range(_WIDTH * _WIDTH).select(F.col("id").cast("int").alias("pair")).join(counts, "pair", "left").fillna(0, list(groups))
            .withColumn("first", F.floor(F.col("pair") / _WIDTH)).withColumn("second", F.col("pair") % _WIDTH))
    by_first, by_second, everywhere = Window.partitionBy("first"), Window.partitionBy("second"), Window.partitionBy(F.lit(0))
    total = {g: F.sum(g).over(everywhere) for g in groups}

    def likelihood(g: str) -> Column:
        single = (F.sum(g).over(by_second) + 0.5) / (total[g] + 0.5 * _ALPHABET)
        return (F.col(g) + _BACK_OFF * single) / (F.sum(g).over(by_first) + _BACK_OFF)

    def log_mean(a: str, b: str) -> Column:
        part = lambda g: F.when(total[g] > 0, likelihood(g)).otherwise(0.0)
        held = F.when(total[a] > 0, 1).otherwise(0) + F.when(total[b] > 0, 1).otherwise(0)
        return F.log((part(a) + part(b)) / F.nullif(held, F.lit(0)))

    ratios = grid.select("pair", F.coalesce(log_mean("r0", "r1") - log_mean("o0", "o1"), F.lit(0.0)).alias("ratio"))
    return ratios.agg(F.transform(F.array_sort(F.collect_list(F.struct("pair", "ratio"))), lambda x: x["ratio"]).alias("ratios"))


def log_ratio(token: Column, ratios: Column) -> Column:
    """Sum over the character pairs of a token (an ASCII string of two or more characters)."""
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda a, i: a + F.element_at(
        ratios, (F.ascii(F.substring(token, i, F.lit(1))) * _WIDTH + F.ascii(F.substring(token, i + 1, F.lit(1))) + 1).cast("int")))


def secret_spans(docs: DataFrame, corpus: DataFrame) -> DataFrame:
    """(key, kind, start, end, match) of all spans of ``docs`` (key, text; one row a key, text not null).

    ``corpus`` (text, not null): all texts, for the ordinary samples. Equal runs are counted first (a partial aggregate).
    """
    any_fixed = F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}")
    fixed_docs = docs.where(any_fixed)
    assign = _matches(fixed_docs, "assign", ASSIGN).where(F.length(_value(F.col("match"))) >= ASSIGN_MIN)
    base = materialise(assign.union(_matches(fixed_docs, "access", ACCESS)).union(_matches(fixed_docs, "hex", HEX)))
    random = base.select(F.lit(True).alias("random"), F.when(F.col("kind") == "assign", _value(F.col("match"))).otherwise(F.col("match")).alias("sample"))
    yes = lambda m: m.isNotNull()
    rest = F.col("text")
    for pattern, passes in ((ASSIGN, lambda m: F.length(_value(m)) >= ASSIGN_MIN), (ACCESS, yes), (HEX, yes)):
        rest = _blanked(rest, pattern, passes)
    unmatched = F.when(any_fixed, rest).otherwise(F.col("text"))
    words = (corpus.select(F.explode(F.regexp_extract_all(unmatched, F.lit(SHORT), F.lit(0))).alias("sample"))
             .groupBy("sample").agg(F.count(F.lit(1)).alias("n")))
    labelled = [(True, True, x, 1) for x in RANDOM_SAMPLE] + [(False, True, x, 1) for x in ordinary_sample()]
    shipped = docs.sparkSession.createDataFrame(labelled, "random boolean, shipped boolean, sample string, n long")
    table = markov_table(shipped.union(random.select("random", F.lit(False), "sample", F.lit(1).cast("long"))).union(words.select(F.lit(False), F.lit(False), "sample", "n")))
    candidates = docs.where(F.col("text").rlike(TOKEN)).select("key", unmatched.alias("text"))
    scored = attach_global(_matches(candidates, "markov", TOKEN), table).withColumn("score", log_ratio(F.col("match"), F.col("ratios")))
    found = scored.where((F.col("score") >= MIN_TOTAL) & (F.col("score") >= MIN_MEAN * (F.length("match") - 1)))
    return base.union(found.select("key", "kind", "start", "end", "match"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans.

    ``spans`` is an array of (start, rank, kind, match, end) by start, then kind as listed in ``KINDS``; places are
    code points, ends exclusive; it is empty for texts without secrets, null or empty texts. Null ids stay null;
    repeated rows are scanned once and each get the spans; other columns are not read. A corpus without
    any run of 2 to 15 key characters, or without fixed matches, has the shipped samples alone.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(f"`{id_col}`", f"`{text_col}`").alias("key"), text_or_empty(f"`{text_col}`").alias("text"))
    suspects = rows.where(F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}|{TOKEN}")).select("key", "text").dropDuplicates(["key"])
    spans = secret_spans(materialise(suspects), rows.select("text"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    of_key = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end", "match"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,match:string>>")
    return rows.select("doc_id", "key").join(of_key, "key", "left").select("doc_id", F.coalesce(F.col("spans").cast(
        "array<struct<start:bigint,rank:int,kind:string,end:bigint,match:string>>"), none).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
