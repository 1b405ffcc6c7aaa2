"""Removing repeated lines by a deletion-neighbourhood join (operator 2). Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, load, packed, stored, unpacked

LEAST_WORDS = 8  # of a line compared within one edit
SHORTEST = 1  # words of a line compared at all
BROADCAST_ROWS = 250_000  # of some hundred bytes: a broadcast of 25 MB at most
HOT_SHARE = 1000  # lines that make up more than 1 / HOT_SHARE of all are looked up by broadcast


def _split() -> Column:
    return F.split(F.lower("text"), "\n", -1)


def _words(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(WORD), F.lit(0))


def _reach(n: Column) -> Column:
    """The largest power of two of which a line of n words holds two and one word more."""
    return F.pow(F.lit(2), F.floor(F.log2((n - 1) / 2))).cast("int")


def _anchors(words: Column, n: Column) -> Column:
    """Hashes of a line's first and last words; lines one edit apart share one of them.

    The edit is not in the first h words or not in the last h, for 2h + 1 words
    or more. h depends on the length, so the lengths next to it count as well.
    """
    reaches = F.array_distinct(F.array(_reach(n - 1), _reach(n), _reach(n + 1)))
    reaches = F.filter(reaches, lambda h: (h > 0) & (2 * h + 1 <= n + 1) & (h < n))
    ends = lambda h: F.array(
        F.xxhash64(F.lit(1), h, F.slice(words, F.lit(1), h)), F.xxhash64(F.lit(2), h, F.slice(words, n - h + 1, h))
    )
    return F.flatten(F.transform(reaches, ends))


def _lines(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, doc, line_no, words, n, key) of every line with enough words; ``doc`` tells texts of one id apart.

    Lines without words are left out before the array is taken apart: a filter on the
    rows would move below it and look for the words a second time.
    """
    lines = F.transform(_split(), lambda line, i: F.struct(i.alias("line_no"), _words(line).alias("words")))
    lines = F.filter(lines, lambda x: F.size(x["words"]) >= shortest)
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("doc"), "text")
    return texts.select("doc_id", "doc", F.inline(lines)).withColumn("n", F.size("words")).withColumn("key", F.xxhash64("words"))


def _texts(docs: DataFrame, candidates: DataFrame, broadcast_rows: int) -> DataFrame:
    """(key, first, words, n) of the lines (key, first): they are looked up text by text, so only theirs are cut into words."""
    wanted = candidates.select("key", "first.*").groupBy("doc_id", "doc").agg(F.collect_list(F.struct("line_no", "key")).alias("mine"))
    wanted = F.broadcast(wanted) if candidates.count() <= broadcast_rows else wanted
    split = docs.select("doc_id", F.xxhash64("text").alias("doc"), "text").join(wanted, ["doc_id", "doc"])
    split = split.select("doc_id", "doc", "mine", _split().alias("parts"))
    rows = F.transform(
        "mine",
        lambda m: F.struct(
            m["key"].alias("key"),
            F.struct("doc_id", "doc", m["line_no"].alias("line_no")).alias("first"),
            _words(F.get("parts", m["line_no"])).alias("words"),
        ),
    )
    return split.select(F.inline(rows)).withColumn("n", F.size("words")).dropDuplicates(["key"])


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word lists are equal or one word inserted, deleted or replaced apart."""
    n, m = F.size(a), F.size(b)
    same = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int") - 1
    rest = lambda words, start: F.slice(words, start + 1, F.greatest(F.size(words) - start, F.lit(0)))
    return (
        (same < 0)
        | ((n == m) & (rest(a, same + 1) == rest(b, same + 1)))
        | ((n == m + 1) & (rest(a, same + 1) == rest(b, same)))
        | ((m == n + 1) & (rest(a, same) == rest(b, same + 1)))
    )


def repeated_lines(docs: DataFrame, least: int = LEAST_WORDS, shortest: int = SHORTEST, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, doc, removed): the line numbers of each text that repeat an earlier line, whole texts over.

    A line repeats another when their words, lower-cased, are equal or one word
    inserted, deleted or replaced apart; earlier is by doc_id, then text hash,
    then line number. A line is removed when any earlier line of the corpus
    repeats it, so the earliest always stays. Lines of fewer than ``least``
    words repeat only equal ones; those of fewer than ``shortest`` none.

    Edits are counted in words: a line of n words has n + 1 variants. Lines
    that share neither their first nor their last words with a different line
    have no neighbour and emit none (exact, see ``_anchors``). Groups of equal
    variants are never expanded into pairs: one minimum per group is the
    earliest, and each member is verified against it.

    All but the last step works on different lines, each once. There, lines that
    repeat very often (at most HOT_SHARE of them) are joined by broadcast, so
    none gathers its occurrences in one task.
    """
    place = F.struct("doc_id", "doc", "line_no")
    anchors = F.when(F.col("n") >= least, _anchors(F.col("words"), F.col("n")))
    every = stored(_lines(docs, max(shortest, 1)).select("doc_id", "doc", "line_no", "key", anchors.alias("anchors")), "lines")
    first = every.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("places"), F.any_value("anchors").alias("anchors"))
    first = stored(first, "first")

    ends = first.select("key", F.explode("anchors").alias("anchor"))
    met = ends.groupBy("anchor").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").select("anchor")
    candidates = stored(ends.join(met, "anchor").select("key").distinct().join(first.select("key", "first"), "key"), "candidates")
    texts = stored(_texts(docs, candidates, broadcast_rows), "texts")

    # Words as numbers, and one row per variant before it is hashed: both keep the work in compiled code.
    codes = F.transform("words", lambda w: F.xxhash64(w)).alias("codes")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = texts.select("key", F.struct("first", "key").alias("me"), "n", codes).repartition(tasks, "key")
    cut = coded.select("key", "me", "n", "codes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at")).select(
        "key", "me", "at", F.xxhash64(F.concat(F.slice("codes", F.lit(1), F.col("at")), F.slice("codes", F.col("at") + 2, F.col("n")))).alias("variant")
    )
    whole = coded.select("key", "me", F.lit(-1).alias("at"), F.xxhash64("codes").alias("variant"))
    variants = stored(cut.unionByName(whole), "all-variants")
    shared = variants.groupBy("variant").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").select("variant")
    variants = stored(variants.join(shared, "variant"), "variants")
    by_place = variants.groupBy("variant", "at").agg(F.min("me").alias("earliest"))
    # A word replaced: equal rest, same place. A word more: the variant of one is the whole other.
    crossed = by_place.groupBy("variant").agg(
        F.min(F.when(F.col("at") < 0, F.col("earliest"))).alias("whole"), F.min(F.when(F.col("at") >= 0, F.col("earliest"))).alias("cut")
    )
    beside = F.least(F.col("earliest"), F.when(F.col("at") < 0, F.col("cut")).otherwise(F.col("whole")))
    met = variants.join(by_place, ["variant", "at"]).join(crossed, "variant").select("key", "me", beside.alias("other"))
    nearest = met.filter(F.col("other") < F.col("me")).select("key", F.col("other.key").alias("other")).distinct()
    pairs = nearest.join(texts.select("key", F.col("words").alias("a")), "key").join(
        texts.select(F.col("key").alias("other"), F.col("words").alias("b")), "other"
    )
    near = pairs.filter(_within_one_edit(F.col("a"), F.col("b"))).select("key", F.lit(True).alias("near")).distinct()

    repeated = first.join(near, "key", "left").filter((F.col("places") > 1) | F.col("near")).select("key", "first", "near", "places")
    repeated = stored(repeated, "repeated")
    hot = F.broadcast(repeated.filter(F.col("places") * HOT_SHARE > every.count()))
    places = every.select("doc_id", "doc", "line_no", "key")
    others = places.join(hot.select("key"), "key", "left_anti").join(repeated, "key")
    judged = places.join(hot, "key").unionByName(others)
    gone = judged.filter(F.coalesce("near", F.lit(False)) | (place != F.col("first")))
    return gone.groupBy("doc_id", "doc").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame, **settings) -> DataFrame:
    """All columns of ``docs``, the text without lines that repeat an earlier one, ``n_lines`` and ``removed``.

    Null and empty texts, lines without words and rows without doc_id stay as
    they are; a null text has no lines. Repeated rows (same id
    and text) are one document and get the same answer. A text all of whose
    lines go becomes empty. Columns ``n_lines`` and ``removed`` of the input are
    replaced; others may have any names.
    """
    gone = repeated_lines(docs, **settings)
    columns = [c for c in docs.columns if c not in ("n_lines", "removed")]
    total = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    whole = packed(docs, "text", doc_id=F.col("doc_id"), doc=F.xxhash64("text"), text=F.col("text")).join(gone, ["doc_id", "doc"], "left")
    # A column of its own, or every kept line would split the text again.
    whole = whole.withColumn("parts", F.when(F.col("removed").isNotNull(), F.split("text", "\n", -1)))
    keep = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("removed"))
    rest = F.array_join(F.transform(keep, lambda i: F.get("parts", i)), "\n")
    return whole.select(
        *unpacked(columns, text=F.when(F.col("removed").isNotNull(), rest).otherwise(F.col("text"))),
        F.coalesce(total, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
        "text",
    )


def oracle() -> str:
    """The same from texts instead of hashes, every line emitting its variants."""
    return rf"""
    WITH split AS (
        SELECT doc_id, string_split(text, chr(10)) AS all_lines FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
    ), l AS (
        SELECT doc_id, i - 1 AS line_no, regexp_extract_all(lower(all_lines[i]), '[^\x20\x09-\x0D]+') AS words
        FROM (SELECT doc_id, all_lines, unnest(range(1, len(all_lines) + 1)) AS i FROM split)
    ), n AS (
        SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS place, len(words) >= {LEAST_WORDS} AS long FROM l WHERE len(words) >= {SHORTEST}
    ), v AS (
        SELECT place, long, -1 AS spot, array_to_string(words, ' ') AS variant FROM n
        UNION ALL
        SELECT place, long, i, array_to_string(list_concat(words[1:i], words[i + 2:]), ' ')
        FROM (SELECT place, long, words, unnest(range(0, len(words))) AS i FROM n WHERE long)
    ), m AS (
        SELECT place, min(place) OVER (PARTITION BY variant, spot) AS same,
               CASE WHEN spot < 0 AND long THEN min(CASE WHEN spot >= 0 THEN place END) OVER (PARTITION BY variant)
                    WHEN long THEN min(CASE WHEN spot < 0 AND long THEN place END) OVER (PARTITION BY variant) END AS crossed
        FROM v
    ), gone AS (
        SELECT doc_id, line_no FROM n WHERE place IN (SELECT place FROM m WHERE least(same, coalesce(crossed, same)) < place)
    ), g AS (
        SELECT doc_id, count(*) AS n_removed, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed, list(line_no) AS numbers
        FROM gone GROUP BY doc_id
    )
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
           coalesce(g.n_removed, 0) AS n_removed, coalesce(g.removed, '') AS removed,
           CASE WHEN g.doc_id IS NULL THEN d.text ELSE array_to_string(
               [x FOR x, i IN string_split(d.text, chr(10)) IF NOT list_contains(g.numbers, i - 1)], chr(10)) END AS text
    FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
    """
