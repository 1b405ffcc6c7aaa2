"""Secret scans with corpus-wide ownership frequency (operator 3). Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stored

# Fixed patterns and least lengths. Kinds in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
# A run that is long enough is found whole, so the least length can be part of these two.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# What the ownership count adds: longer tokens that mix cases and digits and that one owner alone has.
TOKEN = r"[A-Za-z0-9_-]{24,}"
KINDS = ("assign", "access", "hex", "owned")

EXAMPLE_OWNERS = 3


STEP = 256  # numbers whose running sum is built at once

SPANS = "array<struct<start:long,kind:int,end:long,value:string>>"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The leftmost non-overlapping matches: struct of ``steps`` (length of what lies before a match, and its own), ``sizes`` and ``values``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, m: (F.length(gap) + F.length(m)).cast("long"))
    sizes = F.transform(found, lambda m: F.length(m))
    return F.when(text.rlike(pattern), F.struct(steps.alias("steps"), sizes.alias("sizes"), values.alias("values")))


def _summed(values: Column, start: Column) -> Column:
    """Running sums of a few numbers; the start comes first."""
    return F.aggregate(values, F.array(start), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def _running(values: Column) -> Column:
    """The running sums of an array of longs: by stretches, so that no long array is copied number by number."""
    blocks = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int"))).otherwise(F.array().cast("array<int>"))
    stretch = lambda b: F.slice(values, b * STEP + 1, F.lit(STEP))
    zero = F.lit(0).cast("long")
    starts = _summed(F.transform(blocks, lambda b: F.aggregate(stretch(b), zero, lambda x, y: x + y)), zero)
    paired = F.arrays_zip(blocks.alias("b"), F.slice(starts, F.lit(1), F.size(blocks)).alias("s"))
    return F.flatten(F.transform(paired, lambda p: F.slice(_summed(stretch(p["b"]), p["s"]), F.lit(2), F.lit(STEP))))


def _spans(matches: str, ends: str, kind: int, least: int = 0) -> Column:
    """Spans (start, kind, end, value) in code points; those whose value is too short are left out."""
    zipped = F.arrays_zip(F.col(ends).alias("e"), F.col(f"{matches}.sizes").alias("l"), F.col(f"{matches}.values").alias("v"))
    spans = F.transform(
        zipped, lambda x: F.struct((x["e"] - x["l"]).alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"), x["v"].alias("value"))
    )
    if least:
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    return F.coalesce(spans.cast(SPANS), F.array().cast(SPANS))


def candidates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, owner, repository and ``spans`` (start, kind, end, hash of the value) of all kinds.

    Values never leave this step, only their hashes do. ``owner`` and
    ``repository`` default to the source and to source and language.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("owner"),
        F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("repository"),
        *[_matches(text, pattern, group).alias(f"m{kind}") for kind, (pattern, group) in enumerate(((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (TOKEN, 0)))],
    )
    # Lengths and sums are columns of their own: within a lambda they would be computed again for every stretch.
    found = found.withColumns({f"t{kind}": F.col(f"m{kind}.steps") for kind in range(4)})
    found = found.withColumns({f"e{kind}": _running(F.col(f"t{kind}")) for kind in range(4)})
    every = F.concat(
        _spans("m0", "e0", 0, ASSIGN_LEAST),
        _spans("m1", "e1", 1),
        _spans("m2", "e2", 2),
        F.filter(_spans("m3", "e3", 3), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")),
    )
    hashed = F.transform(
        F.array_sort(every),
        lambda s: F.struct(s["start"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("hash")),
    )
    return found.select("doc_id", "owner", "repository", hashed.alias("spans"))


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per value hash: in how many places, repositories and owners it occurs, and the verdict.

    Values that ``example_owners`` owners or more share are examples, those of
    one owner are live, others shared. Counted per owner and repository first,
    so a value in a third of all documents is a few rows by then.
    """
    pairs = found.select("owner", "repository", F.explode("spans.hash").alias("hash"))
    places = pairs.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = places.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(
        F.sum("n").alias("n_places"),
        F.sum("repositories").alias("n_repositories"),
        F.count("*").alias("n_owners"),
        F.when(F.count("*") >= example_owners, "example").when(F.count("*") == 1, "live").otherwise("shared").alias("verdict"),
    )


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per row of ``docs``: doc_id and ``found``, its spans with kind, place, hash, counts and verdict, by start, then kind.

    Base kinds are always kept. Tokens of kind ``owned`` are kept where they
    overlap no base span and one owner alone has the value. Null texts are
    empty and have no spans; repeated rows give equal rows; a null source is an
    owner of its own. Extra columns are ignored. Memory follows the longest text.
    """
    base = stored(candidates(docs), "spans")
    verdicts = ownership(base, example_owners)
    # Documents alike in their spans share a key, so repeated rows join once and get the same answer.
    keyed = base.withColumn("key", F.xxhash64("doc_id", "spans"))
    some = keyed.filter(F.size("spans") > 0).dropDuplicates(["key"]).select("key", F.explode("spans").alias("s"))
    rows = some.select("key", "s.*").join(verdicts, "hash")
    spans = rows.groupBy("key").agg(
        F.array_sort(
            F.collect_list(F.struct("start", "kind", "end", "hash", "n_places", "n_repositories", "n_owners", "verdict"))
        ).alias("found")
    )
    clear = F.filter(
        "found",
        lambda s: (s["kind"] < 3)
        | (
            (s["verdict"] == "live")
            & ~F.exists("found", lambda b: (b["kind"] < 3) & (b["start"] < s["end"]) & (s["start"] < b["end"]))
        ),
    )
    none = F.array().cast(spans.schema["found"].dataType)
    return keyed.select("doc_id", "key").join(spans, "key", "left").select("doc_id", F.coalesce(clear, none).alias("found"))


def _listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(load(spark, sf_dir, "documents"))
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    return found.select(
        "doc_id",
        count(lambda s: s["kind"] == 0).alias("n_assign"),
        count(lambda s: s["kind"] == 1).alias("n_access"),
        count(lambda s: s["kind"] == 2).alias("n_hex"),
        F.sha2(_listed(F.filter("found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        count(lambda s: s["verdict"] == "example").alias("n_example"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
    )
