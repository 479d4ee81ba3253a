"""Mapping hand-entered values to the entries of a reference list by a prefix-filtered set-similarity join."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import is_missing
from ..operators.skew import hot_slots, lookup, salted
from ..session import settled, small, width

# Letters of other scripts that look like a Latin letter, and Latin letters without a decomposition.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "s", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "p", "ı": "i", "ŋ": "n",
}


def _accented() -> dict[str, str]:
    """Lower-case Latin letters with marks and their base letter, from the Unicode decompositions."""
    out = {}
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(cp).lower()
        base = unicodedata.normalize("NFD", c)[0]
        if len(c) == 1 and c != base and base.isascii():
            out[c] = base
    return out


_FOLD = {**_accented(), **LOOKALIKES}


def plain(entry: Column, field: str | Column | None = None) -> Column:
    """The words of an entry: case, accents, look-alike letters and punctuation folded, a leading ``field=`` or ``field:``
    and any remark in round brackets after the value taken off, invisible characters dropped. Null stays null."""
    c = F.regexp_replace(F.lower(entry), r"[\p{Cf}\p{Mn}]+", "")
    c = F.translate(c, "".join(_FOLD), "".join(_FOLD.values()))
    c = F.regexp_replace(c, r"(?<=[\p{L}\p{N}]\s{0,3})\([^()]*\)\s*$", " ")
    if field is not None:
        named = r"(?s)^[^\p{L}\p{N}]*([^=:]*?)\s*[=:](.*)$"
        field = F.lower(F.lit(field) if isinstance(field, str) else field)
        c = F.when(F.regexp_extract(c, named, 1) == field, F.regexp_extract(c, named, 2)).otherwise(c)
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def grams(words: Column) -> Column:
    """Distinct tokens of an entry: letter pairs within each word with its ends marked, each word on its own, so word
    order does not matter; of words of up to four letters also their sorted letters, as a swap leaves few of their pairs."""
    each = F.split(words, " ")
    marked = F.transform(each, lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    pairs = F.flatten(F.transform(marked, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    letters = F.transform(F.filter(each, lambda w: F.length(w).between(2, 4)), lambda w: F.concat(F.lit("~"), F.array_join(F.array_sort(F.split(w, "")), "")))
    return F.when(F.length(words) > 0, F.array_distinct(F.concat(pairs, letters))).otherwise(F.array().cast("array<string>"))


#: Rows of one token that one task joins before the token is split.
ROWS_PER_TOKEN = 50_000
_JOIN = "\u0001"


def similarity_join(left: DataFrame, right: DataFrame, threshold: float, *, common: int | None = None) -> DataFrame:
    """Pairs ``(part, left_id, right_id, jaccard)`` of two token-set tables ``(part, id, tokens)`` in the same ``part`` with a
    Jaccard similarity of at least ``threshold``; no pair is lost.

    Tokens are ordered by their frequency over both tables, rarest first. Two sets of that similarity share at least
    ``ceil(t * n)`` tokens of either, so they share one among the first ``n - ceil(t * n) + 1`` of each, and two, if they must
    share as many, among one more. Only these prefixes are joined: by single tokens (``common`` 1) or by pairs of them (2),
    which are far rarer; by default by whichever the tokens' counts promise fewer rows for. Candidates whose sizes or whose
    positions of the shared token already rule the similarity out are dropped, and each is verified exactly, at its first
    shared tokens only. Frequent tokens are split over tasks. Empty token sets match nothing.
    """
    t = float(threshold)
    if not 0 < t <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    count = lambda df, n: df.select("part", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("part", "token").agg(F.count(F.lit(1)).alias(n))
    rarity = settled(count(left, "nl").join(count(right, "nr"), ["part", "token"], "full").na.fill(0).withColumn("n", F.col("nl") + F.col("nr")))

    def ordered(df: DataFrame, tag: str) -> DataFrame:
        """Each set once, its tokens in order, spread over all tasks."""
        long = df.select("part", "id", F.explode("tokens").alias("token")).join(rarity.select("part", "token", "n"), ["part", "token"])
        sets = long.groupBy("part", "id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
        tasks = max(width(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)
        return settled(sets.select("part", F.col("id").alias(f"{tag}_id"), F.transform("tokens", lambda s: s["token"]).alias(f"{tag}t"), F.size("tokens").alias(f"{tag}s")).repartition(tasks, f"{tag}_id"))

    a, b = ordered(left, "left").withColumnsRenamed({"leftt": "lt", "lefts": "ls"}), ordered(right, "right").withColumnsRenamed({"rightt": "rt", "rights": "rs"})
    must = lambda n: F.ceil(F.lit(t) * F.col(n) - 1e-9)
    if common is None:
        meet = rarity.agg(F.sum(F.col("nl") * F.col("nr")).alias("m")).first().m or 0
        pairs = sum(df.agg(F.sum(F.col(n) * (F.col(n) - 1) / 2).alias("m")).first().m or 0 for df, n in ((a, "ls"), (b, "rs")))
        common = 1 if meet <= pairs else 2
    need = t / (1 + t) * (F.col("ls") + F.col("rs"))  # tokens that must be shared
    size_ok = F.least("ls", "rs") >= t * F.greatest("ls", "rs") - 1e-9

    def joined(x: DataFrame, y: DataFrame, k: int) -> DataFrame:
        """Pairs that share at least ``k`` tokens, found at their first ``k`` shared ones."""
        def keyed(df: DataFrame, tokens: str, n: str, at: str) -> DataFrame:
            prefix = F.slice(tokens, F.lit(1), (F.col(n) - must(n) + k).cast("int"))
            if k == 1:
                return df.select("*", F.posexplode(prefix).alias(at, "token"))
            after = lambda i: F.slice(tokens, i + 2, F.greatest(F.size(prefix) - i - 1, F.lit(0)))
            two = F.flatten(F.transform(prefix, lambda p, i: F.transform(after(i), lambda q: F.struct(i.alias("at"), F.concat(p, F.lit(_JOIN), q).alias("token")))))
            return df.select("*", F.inline(two).alias(at, "token"))

        p, q = keyed(x, "lt", "ls", "lp"), keyed(y, "rt", "rs", "rp")
        if k == 1:
            hot = hot_slots(rarity.select("part", "token", F.col("nl").alias("n")), ["part", "token"], "n", ROWS_PER_TOKEN)
            p, q = salted(p, q, ["part", "token"], ["left_id"], hot, "salt")
        met = p.join(q, ["part", "token", *(["salt"] if k == 1 else [])])
        # besides these tokens no more than the shorter tail can follow; before them nothing is shared
        room = 1 + F.least(F.col("ls") - F.col("lp") - 1, F.col("rs") - F.col("rp") - 1)
        met = met.filter(size_ok & (room >= need - 1e-9)).withColumn("both", F.array_intersect("lt", "rt"))
        first = F.array_join(F.slice("both", 1, k), _JOIN) == F.col("token")
        shared = F.size("both")
        return met.filter(first).withColumn("shared", shared).withColumn("jaccard", shared / (F.col("ls") + F.col("rs") - shared)).filter(F.col("jaccard") >= t - 1e-9).select("part", "left_id", "right_id", "jaccard", "shared")

    if common == 1:
        return joined(a, b, 1).drop("shared")
    # a pair that shares a single token has a short set on both sides
    few = lambda n: must(n) < 2
    return joined(a, b, 2).unionByName(joined(a.filter(few("ls")), b.filter(few("rs")), 1).filter("shared = 1")).drop("shared")


def _edit_ratio(a: Column, b: Column) -> Column:
    """Edits by length; names under four letters count as four, so that one edit is allowed in any name. Between
    anagrams one edit less is counted: letters in the wrong order are one slip, but two edits."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    n = F.levenshtein(a, b)
    slip = F.when(n >= 2, (letters(a) == letters(b)).cast("int")).otherwise(0)
    return (n - slip) / F.greatest(F.length(a), F.length(b), F.lit(4))


def _sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), "")


def _start_ratio(entry: Column, name: Column) -> Column:
    """Edits of the entry against the start of the name of its length: for abbreviated entries of at least four letters
    that cover a third of the name; two for all others."""
    e, n = F.replace(entry, F.lit(" "), F.lit("")), F.replace(name, F.lit(" "), F.lit(""))
    start = F.substring(n, F.lit(1), F.length(e))
    usable = (F.length(e) >= 4) & (F.length(e) < F.length(n)) & (F.length(e) * 3 >= F.length(n))
    return F.when(usable, F.levenshtein(e, start) / F.length(e) + 0.02).otherwise(2.0)


def canonicalize(values: DataFrame, reference: DataFrame, *, threshold: float = 0.2, edits: float = 0.3) -> DataFrame:
    """``(field, entry, canonical, score)`` for each distinct ``(field, entry)`` of ``values``, canonical '' if unmatched.

    ``reference`` has ``tag_key`` (the field), ``tag_value`` and ``label``; an entry may mean either name of a value.
    Entries and names are folded (``plain``), reduced to distinct folded forms, cut into letter pairs and joined by
    ``similarity_join`` at ``threshold``. Each candidate is then checked exactly: the edit distance to the name, as
    written, without blanks, with words sorted, or against the start of the name for abbreviations, must be at most
    ``edits`` of the length. The best by edits, then Jaccard, then value wins, so equal candidates always resolve alike.
    An entry that folds to nothing, or a null one, is unmatched.
    """
    entries = values.select("field", "entry").distinct()
    names = reference.select(F.col("tag_key").alias("field"), F.explode(F.array(F.col("tag_value"), F.col("label"))).alias("name"), "tag_value").filter(F.col("name").isNotNull())
    names = names.withColumn("words", plain(F.col("name"))).filter(F.length("words") > 0).select("field", "words", "tag_value").distinct()
    entries = settled(entries.withColumn("words", plain(F.col("entry"), F.col("field"))))
    squash = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    # an entry so long that the allowed edits cannot shorten it to any name is unmatched without being cut into pairs
    longest = names.agg(F.coalesce(F.max(F.length("words")), F.lit(0)).alias("longest"))
    forms = entries.select("field", "words").filter(F.length("words") > 0).distinct().crossJoin(F.broadcast(longest))  # one row
    forms = forms.filter(F.length(squash(F.col("words"))) * (1 - edits) <= F.col("longest")).drop("longest")
    token_sets = lambda df: df.select(F.col("field").alias("part"), F.col("words").alias("id"), grams(F.col("words")).alias("tokens")).distinct()
    met = similarity_join(token_sets(forms), token_sets(names), threshold)
    met = met.join(small(settled(names)).withColumnsRenamed({"field": "part", "words": "right_id"}), ["part", "right_id"])
    a, b = F.col("left_id"), F.col("right_id")
    ratio = F.least(_edit_ratio(a, b), _edit_ratio(squash(a), squash(b)), _edit_ratio(_sorted_words(a), _sorted_words(b)), _start_ratio(a, b))
    good = met.withColumn("ratio", ratio).filter(F.col("ratio") <= edits)
    best = good.groupBy("part", "left_id").agg(F.min(F.struct(F.round("ratio", 9).alias("r"), (-F.col("jaccard")).alias("j"), "tag_value")).alias("best"))
    best = best.select(F.col("part").alias("field"), F.col("left_id").alias("words"), F.col("best.tag_value").alias("canonical"), (1 - F.col("best.r")).alias("score"))
    return entries.join(best, ["field", "words"], "left").select("field", "entry", F.coalesce("canonical", F.lit("")).alias("canonical"), "score")


def unlisted(df: DataFrame, tbl: str, key: str, field: str, reference: DataFrame) -> DataFrame:
    """``(tbl, field, rec_key, entry)`` of the rows whose ``field`` is neither missing nor exactly a listed value."""
    exact = reference.filter(F.col("tag_key") == field).select(F.col("tag_value").alias("entry")).distinct()
    rows = df.filter(F.col(key).isNotNull() & ~is_missing(field)).select(F.lit(tbl).alias("tbl"), F.lit(field).alias("field"), F.col(key).alias("rec_key"), F.col(field).alias("entry"))
    return rows.join(small(settled(exact)), "entry", "left_anti").distinct()


def map_entries(rows: DataFrame, reference: DataFrame, **options: float) -> DataFrame:
    """``unlisted`` rows with their ``canonical`` and ``score``. An entry repeated by a third of all rows is mapped once
    and its rows are joined to the mapping with that entry split over tasks."""
    rows = settled(rows)
    mapping = canonicalize(rows, reference, **options)
    return lookup(rows, mapping, ["field", "entry"], ["rec_key"], how="inner")
