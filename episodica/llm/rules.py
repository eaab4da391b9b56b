"""Quality rules: base counts, then the distance of a text's histograms from those of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import let
from .util import WORD, shared_table

# Frequent function words of some languages; every other language uses the last list.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "are", "this"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "sur"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
ANY = ["the", "of", "and", "to", "in", "de", "la", "le", "et", "les", "der", "die", "und", "den", "von", "que", "el", "en", "y", "los"]
#: Character classes as sets; what is in none of them counts as other.
CLASSES = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[!-/:-@\[-`{-~]"]
#: Texts with fewer characters or words are too short for a verdict on that histogram.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: Largest Jensen-Shannon distances (0 to 1) of a text that is kept.
MOST_CHARS, MOST_WORDS = 0.25, 0.3


def _repeated(words: Column, k: int) -> Column:
    """Words in k-word windows that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        def starts(s: Column) -> Column:
            n = F.size(s)
            same = lambda j, x: F.get(s, j)["h"] == x["h"]
            return F.filter(s, lambda x, j: F.coalesce((j > 0) & same(j - 1, x), F.lit(False)) | F.coalesce((j + 1 < n) & same(j + 1, x), F.lit(False)))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = F.sort_array(F.transform(let(pairs, starts), lambda x: x["i"]))
        return F.aggregate(
            at, F.struct(F.lit(-k).alias("last"), F.lit(0).alias("sum")),
            lambda s, i: F.struct(i.alias("last"), (s["sum"] + F.least(F.lit(k), i - s["last"])).alias("sum")), lambda s: s["sum"],
        )

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(k))))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) > k, some).otherwise(0).cast("long")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts of each text, row by row: the base of the verdict and both histograms."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    every = sorted({w for ws in COMMON.values() for w in ws} | set(ANY))
    own = F.lit(None)
    for lang, ws in COMMON.items():
        own = F.when(F.col("lang") == lang, F.array(*map(F.lit, ws))).otherwise(own) if lang != "en" else F.when(F.col("lang") == lang, F.array(*map(F.lit, ws))).otherwise(F.array(*map(F.lit, ANY)))
    return d.withColumn("common", F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(*every))).select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words"), 8).alias("n_repeat_words"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.array(*(F.regexp_count("text", F.lit(c)).cast("long") for c in CLASSES)).alias("classes"),
        let(F.col("common"), lambda c: F.transform(own, lambda w: F.size(F.filter(c, lambda x: x == w)).cast("long"))).alias("common"),
    )


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms: the root of the divergence in bits; 0 if either is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    bits = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    term = lambda a, b: 0.5 * (bits(a, (a + b) / 2) + bits(b, (a + b) / 2))
    return let(F.struct(total(p).alias("p"), total(q).alias("q")), lambda t: F.when((t["p"] > 0) & (t["q"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(p, q, lambda a, b: term(a / t["p"], b / t["q"])))))).otherwise(0.0))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each input row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, js_chars,
    js_words, base_failed, kept.

    A language's reference is the sum of its own texts' histograms, over all rows; a null language counts as one more. A
    text is kept unless the base failed or, where it is long enough, a distance is too large. A null or empty text has no
    words and fails the base. Null ids and repeated rows pass through, an empty table gives an empty result, long texts
    are read whole, other columns are ignored. Only counts are shuffled, and of those a row for each language and task.
    """
    counts = shared_table(base_counts(docs, id_col, text_col, lang_col), "rule-counts")
    other = lambda n, x: F.concat(x, F.array(n - F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)))
    counts = counts.withColumn("classes", other(F.col("n_chars"), F.col("classes"))).withColumn("common", other(F.col("n_words"), F.col("common")))
    width = {"classes": len(CLASSES) + 1, "common": len(ANY) + 1}
    sums = [F.array(*(F.sum(F.col(c)[i]) for i in range(n))).alias(c) for c, n in width.items()]
    refs = shared_table(counts.groupBy("lang").agg(*sums), "rule-references").alias("r")
    real = lambda c: F.transform(F.col(c), lambda x: x.cast("double"))
    judged = (
        counts.alias("c").join(refs, F.col("c.lang").eqNullSafe(F.col("r.lang")))
        .withColumn("js_chars", F.round(_distance(real("c.classes"), real("r.classes")), 6)).withColumn("js_words", F.round(_distance(real("c.common"), real("r.common")), 6))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )
    odd = ((F.col("n_chars") >= LEAST_CHARS) & (F.col("js_chars") > MOST_CHARS)) | ((F.col("n_words") >= LEAST_WORDS) & (F.col("js_words") > MOST_WORDS))
    return judged.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "js_chars", "js_words", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"))


def oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda ws: "[" + ", ".join(map(q, ws)) + "]"
    own = "CASE lang " + " ".join(f"WHEN {q(k)} THEN {listed(ws)}" for k, ws in COMMON.items()) + f" ELSE {listed(ANY)} END"
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])::BIGINT" for i in range(n)) + f"] AS {c}"
    js = lambda c: (
        f"round(sqrt(greatest(0.0, list_sum(list_transform(range(1, len(c.{c}) + 1), lambda i: 0.5 * (CASE WHEN c.{c}[i] > 0 THEN c.{c}[i] / list_sum(c.{c}) * log2((c.{c}[i] / list_sum(c.{c})) / ((c.{c}[i] / list_sum(c.{c}) + r.{c}[i] / list_sum(r.{c})) / 2)) ELSE 0 END"
        f" + CASE WHEN r.{c}[i] > 0 THEN r.{c}[i] / list_sum(r.{c}) * log2((r.{c}[i] / list_sum(r.{c})) / ((c.{c}[i] / list_sum(c.{c}) + r.{c}[i] / list_sum(r.{c})) / 2)) ELSE 0 END))))), 6)"
    )
    classes = ", ".join(f"len(regexp_extract_all(t, {q(c)}))::BIGINT" for c in CLASSES)
    return f"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {q(WORD)}) AS words FROM documents),
    e AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {q(WORD)})) AS lines,
      list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' ')) AS w8 FROM d),
    n AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + o AS at FROM
        (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS k FROM (SELECT doc_id, unnest(w8) AS w, generate_subscripts(w8, 1) AS i FROM e)),
        (SELECT unnest(range(8)) AS o) WHERE k > 1) GROUP BY doc_id),
    c AS (SELECT e.doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(t) AS n_chars, [{classes}] AS k,
      list_transform({own}, lambda w: len(list_filter(words, lambda x: lower(x) = w))::BIGINT) AS m FROM e LEFT JOIN n USING (doc_id)),
    h AS (SELECT *, list_append(k, n_chars - list_sum(k)::BIGINT) AS classes, list_append(m, n_words - list_sum(m)::BIGINT) AS common FROM c),
    r AS (SELECT lang, {sums("classes", len(CLASSES) + 1)}, {sums("common", len(ANY) + 1)} FROM h GROUP BY lang),
    j AS (SELECT c.*, CASE WHEN list_sum(c.classes) > 0 AND list_sum(r.classes) > 0 THEN {js("classes")} ELSE 0 END AS js_chars,
      CASE WHEN list_sum(c.common) > 0 AND list_sum(r.common) > 0 THEN {js("common")} ELSE 0 END AS js_words,
      (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed
      FROM h c JOIN r ON c.lang IS NOT DISTINCT FROM r.lang)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, js_chars::DOUBLE AS js_chars, js_words::DOUBLE AS js_words, base_failed,
      NOT base_failed AND NOT ((n_chars >= {LEAST_CHARS} AND js_chars > {MOST_CHARS}) OR (n_words >= {LEAST_WORDS} AND js_words > {MOST_WORDS})) AS kept
    FROM j"""
