"""Quality rules, line first: clean the lines, then reject documents that lose too much.

Every rule is a built-in expression over the array of a text's lines, so
cleaning needs no shuffle, no Python and no more than a row in memory.

A line fails by the first of these that holds:

* boilerplate: it has one of the listed licence, consent or platform phrases
  (English, German, French, Spanish) and sixty words at most, so that a mention
  in a long line doesn't remove the line;
* punctuation: symbols are over a tenth of it, it has three or more bursts of
  exclamation or question marks and one in ten words at least, or it is a
  fragment of under eight words that no sentence punctuation ends;
* navigation: separators make up much of it, or it is a short unpunctuated
  line with one of the listed navigation phrases.

Blank lines pass.  Failing lines are removed; a document whose remaining lines
hold less than half of its non-blank characters is rejected, as is one that
fails the base rules (under ten words, or over a fifth of its words inside
repeated five-word windows).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import BLANKS, WORD, dealt, words

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Of 100 non-blank characters, so many must remain.
LEAST_KEPT = 50
FRAGMENT_WORDS, SHORT_WORDS, BOILERPLATE_WORDS, SEPARATORS, BURSTS, BURST_WORDS = 8, 12, 60, 3, 3, 10
SYMBOLS = "#*$%&|<>"
LINE_SYMBOLS = r"[#*$%&<>{}\\^~=_]"
BURST = r"[!?]{2,}"
SEPARATOR = "[|»›•·]"
#: A line without any of these passes the rules on signs.
ODD = rf"[{LINE_SYMBOLS[1:-1]}{SEPARATOR[1:-1]}]|[!?][!?]"
#: Sentence punctuation ends a line, if only these come after it.
ENDERS, CLOSERS = ".!?…。！？:;", "\"'»”’)]"
ENDED = rf"[{ENDERS}][{CLOSERS[:-1]}\]]*$"
BLANK = r"[\x20\x09-\x0D]"
#: Phrases in lower case.
BOILERPLATE = (
    "all rights reserved", "copyright (c)", "copyright ©", "licensed under", "released under the", "general public license", "terms of service", "terms of use", "privacy policy", "cookie policy", "uses cookies", "accept cookies", "enable javascript", "subscribe to our newsletter", "powered by",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "utiliza cookies",
)
#: Each of these phrases holds one of these, so that a text without any has none.
ANCHORS = (
    "rights reserved", "copyright ", "licens", "released under the", "terms of ", "privacy policy", "cookie", "enable javascript", "our newsletter", "powered by", "alle rechte vorbehalten", "datenschutzerkl", "nutzungsbedingungen",
    "droits réservés", "politique de conf", "conditions d'utilisation", "derechos reservados", "política de privacidad", "términos de uso",
)
NAVIGATION = (
    "skip to content", "main menu", "sign in", "log in", "home page", "next page", "previous page", "read more", "click here", "back to top", "site map", "search this site", "share this",
    "zum inhalt springen", "weiterlesen", "nach oben", "aller au contenu", "lire la suite", "haut de page", "ir al contenido", "leer más", "volver arriba",
)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value made once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _has_any(col: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | col.contains(p)
    return found


def _any_of(phrases: tuple[str, ...]) -> str:
    """The phrases as one pattern, for the few lines that get so far."""
    return "|".join(re.sub(r"([.()])", r"\\\1", p) for p in phrases)


def line_rule(line: Column, odd: Column | None = None, phrase: Column | None = None) -> Column:
    """0: the line passes; 1 punctuation, 2 navigation, 3 boilerplate.

    ``odd`` and ``phrase`` may say for the whole text that it has none of the
    signs or boilerplate phrases: most lines then need a look at their end only.
    """
    odd = line.rlike(ODD) if odd is None else odd & line.rlike(ODD)
    phrase = F.lit(True) if phrase is None else phrase
    low = F.lower(line)
    bare = F.rtrim(line, F.lit(BLANKS))
    ended = F.right(F.rtrim(bare, F.lit(CLOSERS)), F.lit(1)).isin(*ENDERS)
    n_words, bars = F.regexp_count(line, F.lit(WORD)), F.regexp_count(line, F.lit(SEPARATOR))
    navigation = (odd & (bars >= SEPARATORS) & (bars * 4 >= n_words)) | (~ended & (n_words <= SHORT_WORDS) & low.rlike(_any_of(NAVIGATION)))
    stripped = F.btrim(line, F.lit(BLANKS))
    symbols = F.regexp_count(line, F.lit(LINE_SYMBOLS)) * 10 > F.length(F.replace(F.replace(stripped, F.lit(" ")), F.lit("\t")))
    bursts = F.regexp_count(line, F.lit(BURST))
    punctuation = (odd & (symbols | ((bursts >= BURSTS) & (bursts * BURST_WORDS >= n_words)))) | (~ended & (n_words < FRAGMENT_WORDS))
    return F.when(bare == "", 0).when(phrase & low.rlike(_any_of(BOILERPLATE)) & (n_words <= BOILERPLATE_WORDS), 3).when(punctuation, 1).when(navigation, 2).otherwise(0)


def _rolled(a: Column, b: Column, gap: int) -> Column:
    """Each hash of ``a`` combined with that of ``b`` so many places on."""
    m = F.greatest(F.size(b) - gap, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), m), F.slice(b, F.lit(gap + 1), m), lambda x, y: F.xxhash64(x, y))


def _repeats(hashes: Column) -> Column:
    return F.size(F.array_distinct(hashes)) < F.size(hashes)


def repeated_words(five: Column) -> Column:
    """Words that lie in a five-word window found twice or more, by the windows' 64-bit hashes.

    Most texts repeat none, which a hash set shows; only the others are sorted
    by hash and place.  A null list stands for one without repeats.
    """

    def covered(d: Column) -> Column:
        nxt = F.concat(F.slice(d, 2, F.greatest(F.size(d) - 1, F.lit(0))), F.array(F.element_at(d, -1) + WINDOW))
        return F.aggregate(F.zip_with(d, nxt, lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0), lambda s, x: s + x)

    def places(p: Column) -> Column:
        m = F.size(p) - 1
        twice = F.zip_with(F.slice(p, F.lit(1), m), F.slice(p, F.lit(2), m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        return F.sort_array(F.array_distinct(F.flatten(twice)))

    by_hash = F.sort_array(F.transform(five, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(_repeats(five), bind(bind(by_hash, places), covered)).otherwise(0)


def quality_columns(text: Column) -> dict[str, Column]:
    """The measures and verdict of a text, in the order in which they can be added to a frame."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.split(whole, "\n")
    with_word = F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    rule = lambda x: line_rule(x, F.col("__odd"), F.col("__phrase"))
    return {
        "__odd": whole.rlike(ODD),
        "__phrase": _has_any(F.lower(whole), ANCHORS),
        # A column each, used more than once by the next, so that none is folded into a lambda: array functions outside of one are compiled.
        "__w": words(whole),
        "__one": F.transform("__w", lambda x: F.xxhash64(x)),
        "__two": _rolled(F.col("__one"), F.col("__one"), 1),
        "__four": _rolled(F.col("__two"), F.col("__two"), 2),
        # Where no four words are repeated no five are.
        "__five": F.when(_repeats(F.col("__four")), _rolled(F.col("__four"), F.col("__one"), WINDOW - 1)),
        "__c": bind(with_word, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "__l": bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.filter(x, lambda y: rule(y) == 0).alias("kept"))),
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": F.col("__c"),
        "n_repeat_words": repeated_words(F.col("__five")).cast("long"),
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        "n_lines_removed": F.col("__l.n") - F.size("__l.kept"),
        "cleaned": F.when(F.col("n_lines_removed") == 0, whole).otherwise(F.array_join("__l.kept", "\n")),
        "chars_left": F.when(F.col("n_lines_removed") == 0, F.col("word_chars")).otherwise((F.length("cleaned") - F.regexp_count("cleaned", F.lit(BLANK))).cast("long")),
        "kept": ~F.col("base_failed") & (100 * F.col("chars_left") >= LEAST_KEPT * F.col("word_chars")),
    }


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, the measures, the verdict and ``n_lines_removed, chars_left``.

    Null and empty texts have no words: base_failed.  Null ids, ties and
    repeated rows give a row each; an empty table an empty result; other
    columns are not read, so their names can't clash.
    """
    out = dealt(df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")))
    for name, col in quality_columns(F.col("__text")).items():
        out = out.withColumn(name, col)
    return out.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "chars_left")


def clean_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept documents with the columns of ``df``, their failing lines removed."""
    names = df.columns
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    for name, col in quality_columns(F.col(f"__row.`{text_col}`")).items():
        out = out.withColumn(name, col)
    # A filter on "kept" would be pushed below and judge each text twice; one on a generated column stays where it is.
    out = out.select("__row", F.explode_outer(F.array(F.when(F.col("kept"), F.col("cleaned")))).alias("cleaned")).filter(F.col("cleaned").isNotNull())
    new = {text_col: F.col("cleaned")} | ({"n_chars": F.length("cleaned").cast(df.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return out.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in names])


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_sql(col: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({col}, {_quoted(p)})" for p in phrases) + ")"


_BLANK_SQL = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
#: The documents that quality_rules measures and judges, with doc_id, in DuckDB SQL; ``cleaned`` is the text left.
JUDGED_SQL = f"""
  d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
  w AS (SELECT rn, regexp_extract_all(t, {_quoted(WORD)}) AS w FROM d),
  g AS (SELECT rn, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
  v AS (SELECT rn, i, lead(x, {WINDOW - 1}) OVER o AS e, concat_ws(' ', x, {', '.join(f'lead(x, {k}) OVER o' for k in range(1, WINDOW))}) AS win FROM g WINDOW o AS (PARTITION BY rn ORDER BY i)),
  s AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, win) AS c FROM v WHERE e IS NOT NULL),
  r AS (SELECT rn, sum(least({WINDOW}, coalesce(nxt, i + {WINDOW}) - i)) AS n_repeat FROM (SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM s WHERE c > 1) GROUP BY rn),
  x AS (SELECT rn, string_split(t, chr(10)) AS ls FROM d),
  l AS (SELECT rn, unnest(range(1, len(ls) + 1)) AS nr, unnest(ls) AS line FROM x),
  m AS (SELECT rn, nr, line, trim(line, {_BLANK_SQL}) AS s FROM l),
  n AS (SELECT *, lower(s) AS low, len(regexp_extract_all(s, {_quoted(WORD)})) AS n_words, regexp_matches(s, {_quoted(ENDED)}) AS ended, len(regexp_extract_all(s, {_quoted(SEPARATOR)})) AS bars, len(regexp_extract_all(s, {_quoted(BURST)})) AS bursts,
          row_number() OVER (PARTITION BY rn, line ORDER BY nr) > 1 AND s <> '' AS dup FROM m),
  o AS (SELECT *, CASE WHEN s = '' THEN 0 WHEN {_any_sql("low", BOILERPLATE)} AND n_words <= {BOILERPLATE_WORDS} THEN 3
          WHEN len(regexp_extract_all(s, {_quoted(LINE_SYMBOLS)})) * 10 > length(replace(replace(s, ' ', ''), chr(9), '')) OR (bursts >= {BURSTS} AND bursts * {BURST_WORDS} >= n_words) OR (NOT ended AND n_words < {FRAGMENT_WORDS}) THEN 1
          WHEN (bars >= {SEPARATORS} AND bars * 4 >= n_words) OR ({_any_sql("low", NAVIGATION)} AND NOT ended AND n_words <= {SHORT_WORDS}) THEN 2
          ELSE 0 END AS rule FROM n),
  q AS (SELECT rn, count(*) FILTER (WHERE dup) AS n_dup_lines, count(*) FILTER (WHERE rule > 0) AS n_lines_removed, coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE rule = 0), '') AS cleaned FROM o GROUP BY rn),
  k AS (SELECT d.rn, d.doc_id, cleaned, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars, length(d.t) - length(translate(d.t, '{SYMBOLS}', '')) AS n_symbols,
          n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, n_lines_removed, length(translate(cleaned, {_BLANK_SQL}, '')) AS chars_left
        FROM d JOIN w ON d.rn = w.rn JOIN q ON d.rn = q.rn LEFT JOIN r ON d.rn = r.rn),
  judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
          NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * chars_left >= {LEAST_KEPT} * word_chars AS kept FROM k)
"""
ORACLE = f"""
WITH {JUDGED_SQL}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept, CAST(n_lines_removed AS BIGINT) AS n_lines_removed, CAST(chars_left AS BIGINT) AS chars_left
FROM judged
"""
