"""Quality rules with distribution divergence, in DataFrame operations only.

Base rules count words, symbols, repeated lines and repeated three-word windows. The verdict on what
passes them: the Jensen-Shannon distance (base 2) of a text's character-class histogram, and of its
histogram of common words, from those of one language: that whose words it fits best, or where it is too
short for that, whose characters. Both need a minimum length, and the second allows more to short texts,
whose histograms are noisy. A text whose language is told and has no reference gets no verdict from them;
one that isn't told has none of the common words and is rejected like word salad.

Every rule looks at one row alone, so the operator never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.native import let, total, upto

# References: shares of character classes in running text (lower, upper, digits, white space, stops, others) and
# of common words among all words. Those of characters are means over the documents of quality with even ids.
CHARACTERS = {
    "en": (0.7939, 0.0145, 0.0008, 0.1664, 0.0244, 0.0),
    "de": (0.8092, 0.0132, 0.0005, 0.1549, 0.0222, 0.0),
    "fr": (0.7925, 0.0147, 0.0019, 0.166, 0.0248, 0.0001),
    "es": (0.7992, 0.0144, 0.001, 0.1614, 0.024, 0.0),
}
COMMON = {
    "en": {"the": 0.0503, "of": 0.0262, "and": 0.0212, "to": 0.0155, "a": 0.0127, "in": 0.0108, "is": 0.0096, "that": 0.0085, "it": 0.0072, "for": 0.0071, "was": 0.0062, "on": 0.006, "with": 0.0054, "The": 0.0049, "as": 0.0048, "be": 0.0045},
    "de": {"der": 0.05, "die": 0.0261, "und": 0.0211, "in": 0.0154, "den": 0.0134, "von": 0.0106, "zu": 0.0091, "das": 0.0088, "mit": 0.0074, "sich": 0.007, "des": 0.0059, "auf": 0.0059, "für": 0.0055, "ist": 0.0047, "Der": 0.0047, "im": 0.0045},
    "fr": {"de": 0.0508, "la": 0.0273, "le": 0.02, "et": 0.0155, "les": 0.0129, "des": 0.0111, "en": 0.0098, "un": 0.0088, "du": 0.0071, "une": 0.0066, "que": 0.006, "pour": 0.0059, "est": 0.0058, "dans": 0.0047, "qui": 0.0046, "De": 0.0043},
    "es": {"de": 0.0508, "la": 0.0264, "que": 0.0202, "el": 0.0151, "en": 0.0132, "y": 0.0105, "los": 0.0098, "se": 0.0084, "las": 0.0073, "del": 0.007, "por": 0.0063, "un": 0.0062, "con": 0.0052, "no": 0.0051, "una": 0.0046, "para": 0.0044},
}
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; per cent of words in repeated windows
#: Guards and limits of the verdict, chosen on labelled documents with even ids (README has the figures of odd ones).
LEAST_CHARS, MOST_CHARACTER_DISTANCE = 200, 0.25
LEAST_HISTOGRAM_WORDS, WORD_DISTANCE, WORD_DISTANCE_SLACK = 60, 0.19, 0.9  # limit: 0.19 + 0.9 / sqrt(words)


def distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance of two histograms (p an array column) that sum to one."""

    def term(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0) + F.when(b > 0, b * F.log2(b / m)).otherwise(0.0)

    return F.sqrt(F.greatest(total(F.zip_with(p, F.lit(q), term), "double") / 2, F.lit(0.0)))


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice.

    Windows are compared by 64-bit hash; only texts where two are equal are sorted.
    """
    hashes = F.transform(upto(F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = let(ordered, lambda s: F.transform(F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))), lambda e: e["p"]))
        return let(F.sort_array(twice), lambda p: total(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def judge(docs: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, character_distance, word_distance, kept.

    Words are runs of anything but ASCII white space; null text has none, and fails like empty text.
    The distances are null below their minimum lengths (no verdict from them), and where the column
    ``lang`` names a language without a reference; a distance equal to its limit is kept. Of languages that
    fit equally well the first counts. Other names of ``lang``, null and empty ones tell nothing, as
    texts are judged by what they hold. Of equal lines all but the first count. Repeated rows are judged alike and all stay,
    null ids too; texts are read whole. Columns of these names are replaced, others pass through. An
    empty table stays empty.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "character_distance", "word_distance", "kept")
    passed = [c for c in docs.columns if c not in new]
    vocabulary = sorted({w for shares in COMMON.values() for w in shares})

    def counts(body: Column, words: Column) -> Column:
        count = lambda pattern: F.regexp_count(body, F.lit(pattern))
        lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(body).alias("n"),
            count(SYMBOLS).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
            count(r"\p{Lu}").alias("upper"), count(r"\p{L}").alias("letter"), count("[0-9]").alias("digit"), count(r"[\x20\x09-\x0D]").alias("white"), count(r"[.,;:!?'\"()\-]").alias("stop"),
            F.filter(words, lambda w: w.isin(vocabulary)).alias("common"),
        )

    def verdict(c: Column) -> Column:
        n, words = F.greatest(c["n"], F.lit(1)).cast("double"), F.greatest(c["n_words"], F.lit(1)).cast("double")
        rest = c["n"] - c["letter"] - c["digit"] - c["white"] - c["stop"]
        characters = F.array(*(x / n for x in (c["letter"] - c["upper"], c["upper"], c["digit"], c["white"], c["stop"], rest)))
        # one histogram for all languages
        shares_of = F.transform(F.lit(vocabulary), lambda v: F.size(F.filter(c["common"], lambda w: w == v)) / words)

        def fit(h: Column, shares: dict[str, float]) -> Column:
            own = F.array(*(F.get(h, F.lit(vocabulary.index(v))) for v in shares))
            return let(own, lambda o: distance(F.concat(o, F.array(F.greatest(F.lit(1.0) - total(o, "double"), F.lit(0.0)))), [*shares.values(), 1 - sum(shares.values())]))

        failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
        by_characters = F.when(c["n"] >= LEAST_CHARS, let(characters, lambda h: F.array(*(distance(h, list(CHARACTERS[x])) for x in COMMON))))
        by_words = F.when(c["n_words"] >= LEAST_HISTOGRAM_WORDS, let(shares_of, lambda h: F.array(*(fit(h, x) for x in COMMON.values()))))

        def chosen(d: Column) -> Column:
            by = F.coalesce(d["b"], d["a"])
            best = F.array_position(by, F.array_min(by)).cast("int") - 1
            return F.struct(F.get(d["a"], best).alias("a"), F.get(d["b"], best).alias("b"))

        def decided(d: Column) -> Column:
            fine = F.coalesce(d["a"] <= MOST_CHARACTER_DISTANCE, F.lit(True)) & F.coalesce(d["b"] <= WORD_DISTANCE + WORD_DISTANCE_SLACK / F.sqrt(words), F.lit(True))
            kept = c["n_words"].alias("n_words"), (c["n"] - c["white"]).cast("long").alias("word_chars"), *(c[x].alias(x) for x in ("n_symbols", "n_dup_lines", "n_repeat_words"))
            return F.struct(*kept, failed.alias("base_failed"), d["a"].alias("character_distance"), d["b"].alias("word_distance"), (~failed & fine).alias("kept"))

        verdicts = F.lit(True) if lang is None else F.coalesce(F.lower(F.substring(F.col(lang), 1, 2)).isin(*COMMON) | (F.col(lang) == ""), F.lit(True))
        return let(F.struct(F.when(verdicts, by_characters).alias("a"), F.when(verdicts, by_words).alias("b")), lambda d: let(chosen(d), decided))

    # one expression: a filter on a verdict moves below the projection, and would copy columns' expressions into lambdas
    judged = let(F.coalesce(F.col(text), F.lit("")), lambda body: let(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), lambda words: let(counts(body, words), verdict)))
    return docs.select(*passed, judged.alias("__judged")).select(*passed, *(F.col("__judged")[c].alias(c) for c in new))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_distance(p: list[str], q: list[float]) -> str:
    terms = []
    for a, b in zip(p, q, strict=True):
        m = f"(({a} + {b!r}) / 2)"
        terms.append(f"CASE WHEN {a} > 0 THEN {a} * log2({a} / {m}) ELSE 0 END")
        if b > 0:
            terms.append(f"{b!r} * log2({b!r} / {m})")
    return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0))"


def judged_sql(source: str = "documents") -> str:
    """DuckDB SQL of ``judge`` over a table: doc_id, the counts, base_failed and kept."""
    vocabulary = sorted({w for words in COMMON.values() for w in words})
    shares = ", ".join(f"count(*) FILTER (WHERE w = '{v}') / greatest(count(*), 1)::DOUBLE AS c{i}" for i, v in enumerate(vocabulary))
    fits, chars = [], []
    for name, words in COMMON.items():
        own = [f"c{vocabulary.index(w)}" for w in words]
        fits.append(_sql_distance([*own, f"greatest(1.0 - ({' + '.join(own)}), 0.0)"], [*words.values(), 1 - sum(words.values())]))
        classes = [f"(p_{c} / greatest(x.n, 1))" for c in ("lower", "upper", "digit", "white", "stop", "other")]
        chars.append(_sql_distance(classes, list(CHARACTERS[name])))
    count = lambda pattern: f"len(regexp_extract_all(body, '{pattern}'))::DOUBLE"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM {source}),
l AS (SELECT doc_id, body, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM l),
h AS (SELECT doc_id, {shares} FROM u GROUP BY doc_id),
t AS (SELECT doc_id, pos, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT doc_id, pos, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS twice FROM t),
r AS (SELECT doc_id, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS hit FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
rep AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n FROM r GROUP BY doc_id),
li AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM li WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, len(ws) AS n_words, length(body)::DOUBLE AS n, {count('\\p{Lu}')} AS p_upper, {count('\\p{L}')} AS letter, {count('[0-9]')} AS p_digit,
  {count('[\\x20\\x09-\\x0D]')} AS p_white, {count('[.,;:!?\'\'"()\\-]')} AS p_stop, {count('[#*$%&|<>]')} AS symbols FROM l),
x AS (SELECT *, letter - p_upper AS p_lower, n - letter - p_digit - p_white - p_stop AS p_other FROM c),
j AS (SELECT x.doc_id, n_words, x.n - p_white AS word_chars, symbols, coalesce(dup.n, 0) AS n_dup, coalesce(rep.n, 0) AS n_rep, x.n AS chars,
  [{', '.join(chars)}] AS cds, [{', '.join(fits)}] AS wds
  FROM x LEFT JOIN h ON h.doc_id = x.doc_id LEFT JOIN dup ON dup.doc_id = x.doc_id LEFT JOIN rep ON rep.doc_id = x.doc_id),
o AS (SELECT *, CASE WHEN n_words < {LEAST_HISTOGRAM_WORDS} THEN list_position(cds, list_min(cds)) ELSE list_position(wds, list_min(wds)) END AS best FROM j),
f AS (SELECT *, cds[best] AS cd, wds[best] AS wd, n_words < {LEAST_WORDS} OR 100 * n_rep > {MOST_REPEATED} * n_words AS base_failed FROM o)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(n_dup AS BIGINT) AS n_dup_lines,
  CAST(n_rep AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND (chars < {LEAST_CHARS} OR cd <= {MOST_CHARACTER_DISTANCE}) AND (n_words < {LEAST_HISTOGRAM_WORDS} OR wd <= {WORD_DISTANCE} + {WORD_DISTANCE_SLACK} / sqrt(greatest(n_words, 1))) AS kept
FROM f
"""


ORACLE_SQL = judged_sql()
