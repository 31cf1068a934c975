"""Line-first quality rules, as expressions within a row.

Every line that has a word is judged by three rules. It fails

* *punctuation* if it neither ends in terminal punctuation nor, being eight words or longer, has any inside, or if
  over a tenth of its visible characters are of ``#*$%&|<>``;
* *navigation* if it is a menu: three or more separators with at most four words to each, or nothing but a
  link label such as "next page";
* *boilerplate* if it is short and names a notice that sites repeat (cookies, rights, terms, scripts), or is code or filler.

Lines that fail are removed. A document is rejected if fewer than half of its words are left, or if it fails
the base limits. Nothing is shuffled, no Python runs, and the size of a group of copies does not matter. Repeated
three-word windows are found by sorting the windows' 64-bit hashes inside the row, O(n log n) in its words.

Defined results: a null or blank text has no words, fails the base limits and is rejected. Repeated rows each get
their row. Texts of any length are judged whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import SPACE, WORD, let, table

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MIN_KEPT_PERCENT = 50
LONG_LINE = 8
SYMBOL = r"[#*$%&|<>]"

#: Also those of Devanagari, Arabic, Urdu, Armenian, Ethiopic and half-width Japanese.
TERMINALS = (".", "!", "?", "…", "。", "！", "？", ":", ";", "।", "॥", "؟", "۔", "։", "።", "｡")
#: May follow a terminal.
CLOSERS = "\"'”’»)] \t\x0b\x0c\r"
HAS_SENTENCE = r"[.!?…。！？।॥؟۔։።｡]"
SEPARATORS = ("|", "»", "›", "·", "•", "→")
#: In English, German, French and Spanish, in any case.
LINK_LABEL = (
    r"(?i)^[^a-z0-9]*(home|menu|next( page)?|previous( page)?|back to top|skip to (main )?content|read more|click here|"
    r"log ?in|sign ?(in|up)|share( this)?|search|contact( us)?|about( us)?|site ?map|subscribe|print|comments?|"
    r"startseite|weiter(lesen)?|zur[üÜ]ck|nach oben|anmelden|suche|kontakt|impressum|drucken|kommentare?|"
    r"accueil|suivant|pr[éÉ]c[éÉ]dent|lire la suite|connexion|rechercher?|partager|imprimer|commentaires?|haut de page|"
    r"inicio|siguiente|anterior|leer m[áÁ]s|iniciar sesi[óÓ]n|buscar|compartir|comentarios?|volver arriba)[^a-z0-9]*$"
)
#: Words of a line that can be a link label.
LABEL_WORDS = 5
#: Notices, found in any case in lines of at most ``NOTICE_WORDS`` words; a longer line that names one is prose.
NOTICES = (
    "all rights reserved", "cookie policy", "cookie settings", "cookie notice", "uses cookies", "accept cookies", "accept all cookies",
    "privacy policy", "terms of use", "terms of service", "terms and conditions", "copyright ©", "enable javascript", "javascript is required",
    "javascript is disabled", "subscribe to our newsletter", "follow us on", "powered by wordpress",
    "alle rechte vorbehalten", "datenschutzerklärung", "verwendet cookies", "tous droits réservés", "politique de confidentialité",
    "utilise des cookies", "todos los derechos reservados", "política de privacidad", "utiliza cookies",
)
NOTICE_WORDS = 40
#: Code and filler, in lines of any length.
FILLER = ("lorem ipsum", "{", "}", "</", "function(")
BOILERPLATE = NOTICES + FILLER
#: Every one of ``BOILERPLATE`` has one of these; a text without them is not searched for the others.
STEMS = (
    "cookie", "reserv", "réserv", "priva", "confidentialit", "terms ", "copyright ©", "javascript", "newsletter", "follow us on", "wordpress",
    "vorbehalten", "datenschutz", *FILLER,
)


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def n_words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def line_fails(line: Column, symbols: Column, separators: Column, boilerplate: Column) -> Column:
    """Whether a line that has a word fails a rule.

    The three flags say whether the whole text has any symbol, separator or boilerplate; where it has none, its lines
    are not searched.
    """
    bare = F.rtrim(line, F.lit(CLOSERS))
    ends = F.substring(bare, -1, 1).isin(*TERMINALS)
    open_end = ~ends & ((n_words_in(line) < LONG_LINE) | ~line.rlike(HAS_SENTENCE))
    littered = symbols & line.rlike(SYMBOL) & (10 * F.regexp_count(line, F.lit(SYMBOL)) > F.length(F.regexp_replace(line, SPACE, "")))
    n_separators = F.regexp_count(line, F.lit("[" + "".join(SEPARATORS) + "]"))
    menu = separators & (n_separators >= 3) & (n_words_in(line) - n_separators <= 4 * (n_separators + 1))
    label = (F.length(line) <= 40) & (n_words_in(line) <= LABEL_WORDS) & line.rlike(LINK_LABEL)
    repeated = boilerplate & let(F.lower(line), lambda low: _any(low, FILLER) | (_any(low, NOTICES) & (n_words_in(line) <= NOTICE_WORDS)))
    return open_end | littered | menu | label | repeated


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more among ``words``."""

    def windows(w: Column) -> Column:
        at = lambda i, k: F.get(w, i + k)
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)))

    def covered(hashes: Column) -> Column:
        numbered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, j, k: F.coalesce(F.get(s, j + k).getField("h") == x.getField("h"), F.lit(False))
            found = F.filter(s, lambda x, j: same(x, j, -1) | same(x, j, 1))
            return F.sort_array(F.transform(found, lambda x: x.getField("i")))

        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a.getField("n") + F.least(F.lit(3), p - a.getField("last"))).alias("n"), p.alias("last"))
        return F.aggregate(let(numbered, places), start, step, lambda a: a.getField("n"))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), count)))


def _flags(text: Column) -> tuple[Column, Column, Column]:
    return text.rlike(SYMBOL), _any(text, SEPARATORS), let(F.lower(text), lambda low: _any(low, STEMS) & _any(low, BOILERPLATE))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base measures, base_failed, n_lines, n_failed_lines, n_kept_words and kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    long = lambda c: c.cast("long")

    def by_lines(found: Column, flags: Column) -> Column:
        fails = F.filter(found, lambda x: line_fails(x, *(flags.getField(k) for k in ("symbols", "separators", "boilerplate"))))
        return let(fails, lambda bad: F.struct(long(F.size(found)).alias("n_lines"), long(F.size(bad)).alias("n_failed_lines"), long(n_words_in(F.array_join(bad, "\n"))).alias("n_lost_words"), long(F.size(found) - F.size(F.array_distinct(found))).alias("n_dup_lines")))

    def by_words(w: Column) -> Column:
        return F.struct(long(F.size(w)).alias("n_words"), long(F.length(F.array_join(w, ""))).alias("word_chars"), long(repeated_words(w)).alias("n_repeat_words"))

    symbols, separators, boilerplate = _flags(text)
    flags = F.struct(symbols.alias("symbols"), separators.alias("separators"), boilerplate.alias("boilerplate"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    found = {"__w": let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), by_words), "__l": let(lines, lambda x: let(flags, lambda f: by_lines(x, f)))}
    out = docs.withColumns(found).withColumns(
        {
            "n_words": F.col("__w.n_words"),
            "word_chars": F.col("__w.word_chars"),
            "n_symbols": long(F.regexp_count(text, F.lit(SYMBOL))),
            "n_dup_lines": F.col("__l.n_dup_lines"),
            "n_repeat_words": F.col("__w.n_repeat_words"),
            "n_lines": F.col("__l.n_lines"),
            "n_failed_lines": F.col("__l.n_failed_lines"),
            "n_kept_words": F.col("__w.n_words") - F.col("__l.n_lost_words"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    lost = 100 * F.col("n_kept_words") < MIN_KEPT_PERCENT * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost).drop("__w", "__l")


def clean_text(text: Column) -> Column:
    """The text without the lines that fail a rule; lines without words stay. Null stays null."""
    good = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(WORD) | ~line_fails(x, *[F.lit(True)] * 3))
    return F.array_join(good, "\n")


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their texts cleaned; columns as they were."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    kept = measure(held).where("kept").select("row.*", F.struct(clean_text(F.col("text")).alias("text")).alias("__clean"))
    return kept.withColumn(text_col, F.col("__clean.text")).drop("__clean")


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "n_kept_words")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


def _sql() -> str:
    word, q = r"[^\x20\x09-\x0D]+", lambda s: s.replace("'", "''")
    terminals = ", ".join(f"'{t}'" for t in TERMINALS)
    named = lambda parts: "(" + " OR ".join(f"contains(lower(x), '{b}')" for b in parts) + ")"
    boilerplate = f"({named(FILLER)} OR {named(NOTICES)} AND n <= {NOTICE_WORDS})"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
b AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '{word}') AS w,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols
  FROM d
), l AS (
  SELECT r, x, len(regexp_extract_all(x, '{word}')) AS n, len(regexp_extract_all(x, '[{''.join(SEPARATORS)}]')) AS seps,
         row_number() OVER (PARTITION BY r, x) AS copy
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{word}')
), j AS (
  SELECT *, (NOT right(rtrim(x, '{q(CLOSERS)}'), 1) IN ({terminals}) AND (n < {LONG_LINE} OR NOT regexp_matches(x, '{q(HAS_SENTENCE)}')))
            OR 10 * len(regexp_extract_all(x, '{SYMBOL}')) > length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))
            OR (seps >= 3 AND n - seps <= 4 * (seps + 1)) OR (length(x) <= 40 AND n <= {LABEL_WORDS} AND regexp_matches(x, '{q(LINK_LABEL)}')) OR {boilerplate} AS bad
  FROM l
), ls AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (bad) AS n_failed_lines, count(*) FILTER (copy > 1) AS n_dup_lines,
         coalesce(sum(n) FILTER (NOT bad), 0) AS n_kept_words
  FROM j GROUP BY r
), t AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times
  FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM b))
), c AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM t, (VALUES (0), (1), (2)) AS o(k) WHERE times > 1 GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines,
         CAST(coalesce(n_kept_words, 0) AS BIGINT) AS n_kept_words
  FROM b LEFT JOIN ls USING (r) LEFT JOIN c USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AND NOT 100 * n_kept_words < {MIN_KEPT_PERCENT} * n_words AS kept,
       n_lines, n_failed_lines, n_kept_words
FROM m
"""


SQL = _sql()
