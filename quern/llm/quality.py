"""Quality rules on Spark SQL functions alone.

Base rules count words, symbols, repeated lines and repeated three-word windows
of the whole text.  The verdict compares the text's histograms of character
classes and of common words to those of the languages, by Jensen-Shannon
distance, where the text is long enough for its histogram to mean something.

Each text is one row throughout: no words are exploded or shuffled.  Arrays are
bound to names by a transform over a one-element array, so that they are
computed once.  Windows that occur twice are found by sorting: a long holds the
upper bits of the window's hash and its position, so equal windows are
neighbours after one sort of longs; the few that are neighbours are then sorted
by their words themselves, which makes the count exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE, load, materialise

#: Common words of the languages that have references.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "ein", "eine"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "por", "con"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "pour", "dans"],
}
BINS = sorted({w for ws in COMMON.values() for w in ws})
#: One letter for each bin, and for each of them its word.
CODES = "".join(chr(0x4E00 + i) for i in range(len(BINS)))
CLASSES = ["lower", "upper", "digit", "stop", "symbol", "other_ascii", "beyond_ascii"]
#: Positions take the lower bits of a window's sort key; longer texts sort by words at once.
PLACE_BITS = 24
MIN_CHARS, MIN_WORDS = 300, 60
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.34, 0.36
#: The word threshold as a share of the distance that a text without any common word has to the nearest reference; MAX_WORD_DISTANCE at most.
WORD_SHARE = 0.96


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _blank(text: str) -> str:
    return f"btrim({text}, '{SPACE.encode('unicode_escape').decode().replace(chr(92) + 'x', chr(92) + 'u00')}')"


def _repeats() -> str:
    """Words in windows that occur twice or more, from the words w."""
    n = "(size(w) - 2)"
    mask = (1 << PLACE_BITS) - 1
    keys = f"sort_array(transform(sequence(0, {n} - 1), i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & {~mask}L) | cast(i as bigint)))"
    same = f"(k[j] & {~mask}L) = (x & {~mask}L)"
    beside = lambda eq_prev, eq_next, size: f"((j > 0 AND {eq_prev}) OR (j < {size} - 1 AND {eq_next}))"
    near = beside(same.replace("k[j]", "k[j - 1]"), same.replace("k[j]", "k[j + 1]"), "size(k)")
    candidates = f"IF({n} > {mask}, sequence(0, {n} - 1), {_let(keys, 'k', f'transform(filter(k, (x, j) -> {near}), x -> cast(x & {mask}L as int))')})"
    by_words = "sort_array(transform(c, i -> named_struct('a', w[i], 'b', w[i + 1], 'c', w[i + 2], 'at', i)))"
    equal = lambda o: f"(x.a = s[{o}].a AND x.b = s[{o}].b AND x.c = s[{o}].c)"
    twice = f"sort_array(transform(filter(s, (x, j) -> {beside(equal('j - 1'), equal('j + 1'), 'size(s)')}), x -> x.at))"
    covered = "aggregate(transform(p, (x, j) -> IF(j = 0, 3, least(3, x - p[j - 1]))), 0L, (t, x) -> t + x)"
    return f"IF({n} < 2, 0L, {_let(candidates, 'c', f'IF(size(c) = 0, 0L, {_let(by_words, chr(115), _let(twice, chr(112), covered))})')})"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", whole: bool = False) -> DataFrame:
    """(id, lang, n_chars, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common) per row.

    classes counts characters by CLASSES, common counts words by BINS, with all
    other words last.  With whole, the row itself is added, as a struct.
    """
    extra = ["row"] if whole else []
    t = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(c) for c in extra],
    )
    words = f"IF({_blank('text')} = '', cast(array() as array<string>), split({_blank('text')}, '[\\\\x20\\\\x09-\\\\x0D]+'))"
    lines = "filter(split(text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    bins = ", ".join(f"'{b}'" for b in BINS)
    codes = f"array_join(transform(filter(w, x -> lower(x) IN ({bins})), x -> substr('{CODES}', find_in_set(lower(x), '{','.join(BINS)}'), 1)), '')"
    counts = ", ".join(f"cast(length(h) - length(replace(h, '{c}', '')) as bigint)" for c in CODES)
    common = _let(codes, "h", f"array({counts}, cast(size(w) - length(h) as bigint))")
    of_words = f"named_struct('n_words', cast(size(w) as bigint), 'n_repeat_words', {_repeats()}, 'common', {common})"
    rest = "regexp_replace(r, '[\\\\x20\\\\x09-\\\\x0D]+', '')"
    cut = lambda src, cls: f"cast(length({src}) - length(regexp_replace({src}, '{cls}+', '')) as bigint)"
    classes = f"""array(cast(length(text) - length(r) as bigint), {cut('q', '[A-Z]')}, {cut('q', '[0-9]')}, {cut('q', '[.,;:!?]')},
        {cut('q', '[#*$%&|<>]')}, {cut('q', '[\\\\x00-\\\\x1F\\\\x22\\\\x27-\\\\x29+\\\\x2D/=@\\\\x5B-\\\\x60{}~\\\\x7F]')}, {cut('q', '[^\\\\x00-\\\\x7F]')})"""
    of_chars = f"named_struct('word_chars', cast(length(text) - length(r) + length(q) as bigint), 'classes', {classes})"
    return t.select(
        "id", "lang", F.length("text").cast("long").alias("n_chars"),
        F.expr(_let(words, "w", of_words)).alias("a"),
        F.expr(_let("regexp_replace(text, '[a-z]+', '')", "r", _let(rest, "q", of_chars))).alias("b"),
        F.expr(_let(lines, "l", "cast(size(l) - size(array_distinct(l)) as bigint)")).alias("n_dup_lines"),
        *extra,
    ).select(
        "id", "lang", "n_chars", "a.n_words", "b.word_chars", F.element_at("b.classes", 5).alias("n_symbols"), "n_dup_lines", "a.n_repeat_words", "b.classes", "a.common", *extra
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(feats: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """The summed histograms of the languages that have word lists, over all rows that pass the base rules."""
    sums = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    found = feats.where(F.col("lang").isin(*COMMON) & ~base_failed()).groupBy("lang").agg(sums("classes", len(CLASSES)).alias("classes"), sums("common", len(BINS) + 1).alias("common"))
    return {r.lang: (list(r.classes), list(r.common)) for r in found.collect()}


def _distance(own: str, reference: list[int]) -> Column:
    """Jensen-Shannon distance, base 2, of an array of counts and a reference's; 0 where either is empty."""
    total = sum(reference)
    if not total:
        return F.lit(0.0)
    q = ", ".join(f"{x / total!r}D" for x in reference)
    part = lambda p, m: f"IF({p} > 0, {p} * log2({p} / {m}), 0D)"
    both = f"aggregate(zip_with(transform({own}, x -> x / n), array({q}), (p, q) -> {part('p', '((p + q) / 2)')} + {part('q', '((p + q) / 2)')}), 0D, (a, x) -> a + x)"
    return F.expr(_let(f"cast(aggregate({own}, 0L, (a, x) -> a + x) as double)", "n", f"IF(n = 0, 0D, sqrt(greatest(0D, {both} / 2)))"))


def word_limit(refs: dict[str, tuple[list[int], list[int]]]) -> float:
    """WORD_SHARE of the word distance of a text without common words, MAX_WORD_DISTANCE at most and where a reference has no common words itself."""
    found = []
    for _, words in refs.values():
        if total := sum(words):
            q = np.array(words) / total
            p = np.eye(len(q))[-1]
            part = lambda x, m=(p + q) / 2: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
            found.append(float(np.sqrt(max(0.0, (part(p) + part(q)) / 2))))
    return min(MAX_WORD_DISTANCE, WORD_SHARE * min(found)) if found and min(found) > 1e-9 else MAX_WORD_DISTANCE


def judged(feats: DataFrame, refs: dict[str, tuple[list[int], list[int]]]) -> DataFrame:
    """feats with class_distance and word_distance to the nearest reference, base_failed and kept.

    A text is far if its classes are further than MAX_CLASS_DISTANCE or its
    words are about as far as those of a text without any common word.  A text
    of a language without reference, or any text if there is no reference, is
    kept if it passes the base rules.
    """
    max_word_distance = word_limit(refs)
    nearest = lambda c, i: F.least(*ds) if len(ds := [_distance(c, r[i]) for _, r in sorted(refs.items())]) > 1 else ds[0] if ds else F.lit(0.0)
    far = (F.col("n_chars") >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE) | (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > max_word_distance)
    known = F.col("lang").isNull() | F.col("lang").isin(*refs) if refs else F.lit(False)
    return (
        feats.withColumn("class_distance", nearest("classes", 0)).withColumn("word_distance", nearest("common", 1))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~(known & far))
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The features and verdict of every row.

    Null and empty texts have no words and fail; rows that repeat each have
    their row; null ids and languages are allowed; an empty table gives no
    rows; other columns are ignored.
    """
    feats = materialise(features(docs, id_col, text_col, lang_col), "features")
    return judged(feats, references(feats))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(load(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def filtered(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs, all columns, of the rows that are kept: each row by its own text and language, whatever other rows share its id.

    Nothing is shuffled or stored: the features are made once for the references
    and again beside the rows, which costs time instead of a copy of the texts.
    """

    def once(feats: DataFrame) -> DataFrame:
        return feats.select(F.explode(F.array(F.struct(*feats.columns))).alias("x")).select("x.*")  # else each use makes a feature anew

    return judged(once(features(docs, id_col, whole=True)), references(once(features(docs, id_col)))).where("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _oracle() -> str:
    spaces, chars = r"[^\x20\x09-\x0D]+", ["[a-z]", "[A-Z]", "[0-9]", "[.,;:!?]", "[#*$%&|<>]", r"[\x00-\x08\x0E-\x1F\x22\x27-\x29+\x2D/=@\x5B-\x60{}~\x7F]", r"[^\x00-\x7F]"]
    bins = ", ".join(f"len(list_filter(lw, lambda x: x = '{b}'))" for b in BINS)
    listed = ", ".join(f"'{b}'" for b in BINS)
    langs = ", ".join(f"'{x}'" for x in COMMON)
    classes = ", ".join(f"len(regexp_extract_all(text, '{c}'))" for c in chars)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{spaces}') AS w FROM documents),
f AS (SELECT doc_id, lang, length(text) AS n_chars, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{spaces}'))) AS n_lines,
        len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{spaces}')))) AS n_different,
        [{classes}] AS classes, [{bins}, len(list_filter(lw, lambda x: x NOT IN ({listed})))] AS common
      FROM (SELECT *, list_transform(w, lambda x: lower(x)) AS lw FROM d)),
g AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
r AS (SELECT doc_id, count(DISTINCT p + o) AS n_repeat_words
      FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g), (VALUES (0), (1), (2)) v(o) WHERE n > 1 GROUP BY doc_id),
u AS (SELECT doc_id, lang, 0 AS kind, i, classes[i] AS c FROM (SELECT *, unnest(range(1, 8)) AS i FROM f)
      UNION ALL SELECT doc_id, lang, 1, i, common[i] FROM (SELECT *, unnest(range(1, {len(BINS) + 2})) AS i FROM f)),
good AS (SELECT doc_id FROM f LEFT JOIN r USING (doc_id) WHERE n_words >= 50 AND 100 * coalesce(n_repeat_words, 0) <= 50 * n_words),
q AS (SELECT lang, kind, i, c / sum(c) OVER (PARTITION BY lang, kind) AS q FROM (SELECT lang, kind, i, sum(c) AS c FROM u WHERE lang IN ({langs}) AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL)),
bare AS (SELECT sqrt(greatest(0, sum(CASE WHEN i = {len(BINS) + 1} THEN log2(2 / (1 + q)) + q * log2(2 * q / (1 + q)) WHEN q > 0 THEN q ELSE 0 END) / 2)) AS dist FROM q WHERE kind = 1 GROUP BY lang),
p AS (SELECT doc_id, kind, i, c / nullif(sum(c) OVER (PARTITION BY doc_id, kind), 0) AS p FROM u),
j AS (SELECT doc_id, kind, q.lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS dist
      FROM p JOIN q USING (kind, i) GROUP BY ALL),
m AS (SELECT doc_id, coalesce(min(dist) FILTER (WHERE kind = 0), 0) AS class_distance, coalesce(min(dist) FILTER (WHERE kind = 1), 0) AS word_distance FROM j GROUP BY doc_id),
v AS (SELECT f.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
        (f.lang IS NULL OR f.lang IN (SELECT lang FROM q)) AND (n_chars >= {MIN_CHARS} AND class_distance > {MAX_CLASS_DISTANCE} OR n_words >= {MIN_WORDS} AND word_distance > (SELECT CASE WHEN min(dist) > 1e-9 THEN least({MAX_WORD_DISTANCE}, {WORD_SHARE} * min(dist)) ELSE {MAX_WORD_DISTANCE} END FROM bare)) AS far
      FROM f LEFT JOIN r USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (n_lines - n_different)::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM v
"""


ORACLE = _oracle()
