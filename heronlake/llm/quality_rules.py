"""Line-first quality rules, in DataFrame functions only.

Words are runs of characters other than the six ASCII spaces. Each line is held against rules in turn:

* symbols: over a tenth of the characters of its words are among `#*$%&|<>`;
* shouting: it has a run of exclamation marks after every third word at least, or capitals but no small
  letter (in lines of 5 words or more);
* navigation: two separators or more (`|`, `»`, `›`, `•`, `·`) among its words, or a line without any end of sentence
  (one of ENDS) in which no word but the first starts with a small letter; lines with letters of a script without case are not
  judged by this second test;
* boilerplate: it holds one of PHRASES, and at most PHRASE_WORDS words (longer lines are prose that may say such a thing).

Letters are Unicode's: capital (Lu), small (Ll), without case (Lo).

Failing lines are removed. A document is rejected if the base rules fail it, if the lines left hold less than
KEPT_SHARE of its word characters, or fewer than MIN_WORDS words.

The base rules and counts: n_words, word_chars, n_symbols, n_dup_lines (lines with a word that equal an earlier line),
n_repeat_words (words that lie in a window of WINDOW words found twice or more), base_failed.

Repeated windows stay within the row: hashes of all windows are compared as a set first, and only texts with a repeat
sort (hash, place) pairs, so a text of n words costs n log n.

Cases: null text has no words and no lines, and fails; empty lines are kept but weigh nothing; repeated rows give
repeated results; an empty table gives an empty result; columns of the input with the names of results are left
out. One row's memory follows its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import SPACES, table

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
KEPT_SHARE = 0.7
SYMBOLS = "#*$%&|<>"
SPLIT = r"[\x20\x09-\x0D]+"
BARS = "|»›•·"
#: Words of a line that a phrase of boilerplate removes, at most.
PHRASE_WORDS = 30
#: Last characters of a closed line.
ENDS = ".!?:;…\"')]”’»。！？：；」』）》】।؟"
#: Lower-case phrases of boilerplate lines.
PHRASES = [
    "all rights reserved", "licensed under", "is licensed", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookies", "enable javascript", "copyright ©", "copyright (c)",
    "click here", "sign up", "log in", "subscribe to", "share this", "read more",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "jetzt anmelden", "weiterlesen", "tous droits réservés", "conditions générales", "politique de confidentialité",
    "mentions légales", "cliquez ici", "lire la suite", "todos los derechos reservados", "términos de uso", "política de privacidad", "aviso legal", "haga clic", "leer más",
    "版权所有", "隐私政策", "все права защищены",
]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(hashes: Column) -> Column:
    """Words under windows whose hash occurs twice or more."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = _let(
        pairs,
        lambda ps: F.filter(F.transform(ps, lambda p, k: F.when((F.get(ps, k - 1)["h"] == p["h"]) | (F.get(ps, k + 1)["h"] == p["h"]), p["i"])), lambda i: i.isNotNull()),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(F.sort_array(twice), start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)


def _chars(text: Column, but: str = "") -> Column:
    """Characters of a text without spaces and those of `but`."""
    return F.length(F.translate(text, SPACES + but, ""))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


WORD = r"[^\x20\x09-\x0D]+"


def line_fails(line: Column, symbols: Column, shouts: Column, bars: Column, phrases: Column) -> Column:
    """True for a line that one of the rules removes; lines without a word pass.

    The last four say whether the whole text has a symbol, a run of exclamation marks, a separator or a phrase
    at all, so that most lines need only the cheap tests, which come first.
    """
    end = F.substring(F.rtrim(line, F.lit(SPACES)), -1, 1)
    unclosed = (end != "") & (F.instr(F.lit(ENDS), end) == 0)
    titled = ~line.rlike(r"[\x20\x09-\x0D]\p{Ll}|\p{Lo}")
    capitals = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & (_count(line, WORD) >= 5)
    marked = (_chars(line) - _chars(line, SYMBOLS)) * 10 > _chars(line)
    shouted = line.contains("!!") & (_count(line, "!{2,}") * 3 >= _count(line, WORD))
    barred = F.length(line) - F.length(F.translate(line, BARS, "")) >= 2
    phrased = F.exists(F.array(*map(F.lit, PHRASES)), lambda p: F.contains(F.lower(line), p)) & (_count(line, WORD) <= PHRASE_WORDS)
    return unclosed & titled | capitals | symbols & marked | shouts & shouted | bars & barred | phrases & phrased


def judged(docs: DataFrame) -> DataFrame:
    """The input's columns (but those named like results), and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, clean_text (the text without its failing lines)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    inner = ["_text", "_hash1", "_hash2", "_hash4", "_hash8", "_lines", "_left", "_has"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names and c not in inner]
    df = docs.select(*kept, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    df = df.withColumn("_hash1", F.transform(words_of(F.col("_text")), lambda w: F.xxhash64(w)))
    for k in (1, 2, 4):  # hashes of 2, 4 and 8 words from those of half as many
        after = F.slice(f"_hash{k}", F.lit(1 + k), F.greatest(F.size(f"_hash{k}"), F.lit(1)))
        df = df.withColumn(f"_hash{2 * k}", F.zip_with(f"_hash{k}", after, lambda x, y: F.xxhash64(x, y)))
    df = df.withColumn("n_words", F.size("_hash1").cast("long")).withColumn("_hash8", F.slice("_hash8", F.lit(1), F.greatest(F.size("_hash8") - (WINDOW - 1), F.lit(0))))
    df = df.withColumn("n_repeat_words", _repeat_words(F.col("_hash8")).cast("long"))
    df = df.withColumn("_lines", F.split("_text", "\n"))
    text = F.col("_text")
    spoken = F.filter("_lines", lambda x: _chars(x) > 0)
    df = df.select(
        *kept, "_text", "n_words", "n_repeat_words", "_lines",
        _chars(text).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.size("_lines") == F.size(F.array_distinct("_lines")), 0).otherwise(F.size(spoken) - F.size(F.array_distinct(spoken))).cast("long").alias("n_dup_lines"),
        _any(text, list(BARS)).alias("_bars"), _any(F.lower(text), PHRASES).alias("_phrases"),
    )
    tests = F.col("n_symbols") > 0, text.contains("!!"), F.col("_bars"), F.col("_phrases")
    df = df.withColumn("_left", F.filter("_lines", lambda x: ~line_fails(x, *tests)))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    whole = F.size("_left") == F.size("_lines")
    df = df.withColumn("clean_text", F.when(whole, text).otherwise(F.array_join("_left", "\n")))
    enough = (_chars(F.col("clean_text")) >= KEPT_SHARE * F.col("word_chars")) & (_count(F.col("clean_text"), WORD) >= MIN_WORDS)
    verdict = ~F.col("base_failed") & (whole | enough)
    # inlined as one struct: a filter on the verdict then stays above, instead of repeating all of the rules below
    return df.select(*kept, F.inline(F.array(F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), "clean_text"))))


def _any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*cols)


#: The same in DuckDB.
OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT doc_id, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM win),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, generate_series(0, {WINDOW - 1}) AS g(j) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS line FROM w),
m AS (SELECT doc_id, line, regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g') AS bare, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS nw FROM l),
f AS (SELECT *, len(bare) > 0 AND (
    len(regexp_extract_all(bare, '[#*$%&|<>]')) * 10 > len(bare)
    OR (len(regexp_extract_all(line, '!{{2,}}')) * 3 >= nw AND len(regexp_extract_all(line, '!{{2,}}')) > 0)
    OR (nw >= 5 AND regexp_matches(line, '\\p{{Lu}}') AND NOT regexp_matches(line, '\\p{{Ll}}'))
    OR len(regexp_extract_all(line, '[|»›•·]')) >= 2
    OR (NOT regexp_matches(line, '[.!?:;…\\x22\\x27)\\]”’»。！？：；」』）》】।؟][\\x20\\x09-\\x0D]*$') AND NOT regexp_matches(line, '[\\x20\\x09-\\x0D]\\p{{Ll}}|\\p{{Lo}}'))
    OR nw <= {PHRASE_WORDS} AND regexp_matches(lower(line), '{"|".join(p.replace("(", chr(92) + "(").replace(")", chr(92) + ")") for p in PHRASES)}')) AS fails FROM m),
s AS (SELECT doc_id, sum(len(bare)) AS word_chars, sum(nw)::BIGINT AS n_words, coalesce(sum(len(bare)) FILTER (NOT fails), 0) AS left_chars, coalesce(sum(nw) FILTER (NOT fails), 0) AS left_words,
    count(*) FILTER (len(bare) > 0) - count(DISTINCT line) FILTER (len(bare) > 0) AS n_dup_lines FROM f GROUP BY doc_id),
a AS (SELECT s.doc_id, n_words, word_chars::BIGINT AS word_chars, len(regexp_extract_all(d.t, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    left_chars, left_words FROM s JOIN d USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND left_chars >= {KEPT_SHARE} * word_chars AND left_words >= {MIN_WORDS} AS kept
FROM a
"""
