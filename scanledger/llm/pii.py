"""Surrogates for personal data (operator 7). Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, packed, stored, unpacked

KEY = "surrogates-1"

# Fixed patterns, tried in this order at each place. A match never begins or ends inside a word or number.
_OPEN, _SHUT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_HEX = "[0-9A-Fa-f]{1,4}"
_TITLES = (
    "Mrs|Mr|Miss|Ms|Dra|Dr|Prof|Sir|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señora|Señor|Sra|Sr|Doña|Don|Г-жа|Г-н|MRS|MR|MISS|MS|DR|PROF|HERR|FRAU"
)
_TITLE = rf"(?:(?:{_TITLES})\.? ){{1,3}}"
# A given or family name: inner capitals, apostrophes and hyphens belong to it.
_PART = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "iban": _OPEN + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _SHUT,
    "ip": _OPEN
    + r"(?<!\.)(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}"
    + _SHUT
    + rf"|(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{{4}}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,4}})?)(?![\p{{L}}\p{{N}}:])",
    "ssn": _OPEN + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _SHUT,
    "card": _OPEN + r"(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5})" + _SHUT,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"
    + _SHUT
    + r"|(?<![\p{L}\p{N}])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}"
    + _SHUT
    + "|"
    + _OPEN
    + r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
    + _SHUT,
    "name": _OPEN + rf"{_TITLE}(?:\p{{Lu}}\. )?{_PART}(?: \p{{Lu}}\.)?(?: {_PART})?" + _SHUT,
}
TYPES = tuple(PATTERNS)
ENTITY = "|".join(f"(?:{pattern})" for pattern in PATTERNS.values())
# Texts without any of these hold no entity.
HINT = rf"[0-9@]|(?:{_TITLES})\.? \p{{Lu}}"

FEMALE = r"(?i)^(?:Mrs|Miss|Ms|Dra|Frau|Mme|Mlle|Madame|Señora|Sra|Doña|Г-жа)"
# Given names by script and gender, and the syllables that make family names.
GIVEN = {
    ("latin", "f"): "Alba Berta Clara Doris Edith Flora Greta Hilda Irene Julia Karla Lydia Marta Nadia Olga Paula".split(),
    ("latin", "m"): "Adam Bruno Carlo David Edgar Fabio Georg Hugo Igor Jakob Karl Leo Mario Nils Oskar Peter".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Раиса Софья Тамара Ульяна Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Марк Никита Олег Павел Роман Семён".split(),
}
SYLLABLES = {
    "latin": "ba do fe gi ka lo me ni pa ro se ti va wo ze lu".split(),
    "cyrillic": "ба до фе ги ка ло ме ни па ро се ти ва жо зе лу".split(),
}
# Letters are replaced by letters of the same script and case.
ALPHABETS = {
    "[0-9]": "0123456789",
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "[ß-öø-ÿ]": "áàâäçéèêëíìîïñóòôöúùûü",
    "[À-ÖØ-Þ]": "ÁÀÂÄÇÉÈÊËÍÌÎÏÑÓÒÔÖÚÙÛÜ",
    "[а-яё]": "абвгдежзиклмнопрстуфхцчшэюя",
    "[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    "[α-ω]": "αβγδεζηθικλμνξοπρστυφχψω",
    "[Α-Ω]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"\p{IsHan}": "一二三大小人山水火木金土日月天地上下左右",
    r"\p{N}": "0123456789",
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
}


def _pick(values: str | list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _byte(hashed: Column, place: Column) -> Column:
    """The byte of a hex hash for a place from 0 on; places beyond its length are mixed in."""
    raw = F.conv(F.substr(hashed, (place % 32 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    return raw + F.floor(place / 32).cast("int") * 7


def _letters(text: Column, hashed: Column) -> Column:
    """Every letter and digit replaced by one of its script and case; all else stays."""

    def swap(char: Column, place: Column) -> Column:
        out = char
        for kind, alphabet in reversed(ALPHABETS.items()):
            out = F.when(char.rlike(kind), _pick(list(alphabet), _byte(hashed, place))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), swap), "")


def entity_type(match: Column) -> Column:
    kind = F.lit("phone")
    for name in ("name", "card", "ssn", "ip", "iban", "email"):
        kind = F.when(match.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(kind)
    return kind


ENTITY_PART = "array<struct<type:string,norm:string>>"


def _title(match: Column) -> Column:
    return F.regexp_extract(match, f"^{_TITLE}", 0)


def normal(kind: Column, match: Column) -> Column:
    """What an entity is made of: (type, norm) of its parts, the same for entities that differ in format only.

    A name is a family name, the last word, and given names, so that it is the
    same person's with and without given names. Phone numbers are their digits
    behind the country code.
    """
    digits = F.regexp_replace(match, "[^0-9]", "")
    national = F.regexp_replace(F.regexp_replace(match, r"^\+[0-9]{1,3}?(?=[ .(-])", ""), "[^0-9]", "")
    abroad = match.startswith("+") & (F.length(digits) <= 13) & (F.length(national) == F.length(digits))
    phone = F.when(abroad, F.right(digits, F.lit(10))).otherwise(national)  # no mark between country and number
    norm = (
        F.when(kind == "email", F.lower(match))
        .when(kind == "phone", phone)
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(match, " ", ""))
        .when(kind == "ip", F.lower(match))
        .otherwise(match)
    )
    gender = F.when(match.rlike(FEMALE), "f|").otherwise("m|")
    words = F.split(F.substr(match, F.length(_title(match)) + 1), " ")
    name = F.transform(
        words,
        lambda word, i: F.when(i == F.size(words) - 1, F.struct(F.lit("family").alias("type"), F.lower(word).alias("norm"))).otherwise(
            F.struct(F.lit("given").alias("type"), F.concat(gender, F.lower(word)).alias("norm"))
        ),
    )
    return F.when(kind == "name", name.cast(ENTITY_PART)).otherwise(F.array(F.struct(kind.alias("type"), norm.alias("norm"))).cast(ENTITY_PART))


def _check_digit(body: Column) -> Column:
    """The last digit that makes a card number valid."""
    twice = lambda c: c * 2 - F.when(c > 4, 9).otherwise(0)
    digits = F.transform(F.split(F.reverse(body), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    weighed = F.transform(digits, lambda c, i: F.when(i % 2 == 0, twice(c)).otherwise(c))
    return ((10 - F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def _syllables(script: str, count: Column) -> Column:
    syllable = lambda i: _pick(SYLLABLES[script], _byte(F.col("_hash"), i))
    return F.array_join(F.transform(F.sequence(F.lit(1), count), syllable), "")


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """Add ``made`` to (type, norm, attempt): a keyed replacement of the same type and shape.

    Later attempts differ, and e-mail and personal names get longer, so that no type runs out of them.
    """
    columns = entities.columns
    kind, norm, attempt = F.col("type"), F.col("norm"), F.col("attempt")
    first = _byte(F.col("_hash"), F.lit(0))
    staged = (
        entities.withColumn("_hash", F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt), 256))
        .withColumn("_swapped", _letters(norm, F.col("_hash")))
        .withColumn("_tail", F.regexp_extract(norm, r"(\.[^.@]*)$", 1))
        # Cards of 15 digits are told by their first two.
        .withColumn("_head", F.when(F.length(norm) == 15, 2).otherwise(1))
        .withColumn("_body", F.concat(F.left(norm, F.col("_head")), F.substr("_swapped", F.col("_head") + 1, F.length(norm) - F.col("_head") - 1)))
        .withColumn("_script", F.when(norm.rlike("[А-Яа-яЁё]"), "cyrillic").otherwise("latin"))
    )
    given, family = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (script, gender), names in GIVEN.items():
        longer = F.when(attempt > 0, _syllables(script, attempt + 1)).otherwise("")
        given = F.when((F.col("_script") == script) & norm.startswith(f"{gender}|"), F.concat(_pick(names, first), longer)).otherwise(given)
    for script in SYLLABLES:
        family = F.when(F.col("_script") == script, F.initcap(_syllables(script, F.lit(4) + attempt))).otherwise(family)
    host = F.substring_index(F.expr("left(_swapped, length(_swapped) - length(_tail))"), "@", -1)
    more = F.when(attempt >= 3, attempt.cast("string")).otherwise("")
    octets = [first % 223 + 1, *[_byte(F.col("_hash"), F.lit(i)) for i in (1, 2, 3)]]
    hexed = F.array_join(
        F.transform(F.split(norm, ""), lambda c, i: F.when(c == ":", c).otherwise(_pick("0123456789abcdef", _byte(F.col("_hash"), i)))), ""
    )
    rest = lambda start: F.substr("_swapped", F.lit(start), F.length(norm))
    area = (_byte(F.col("_hash"), F.lit(31)) % 8 + 2).cast("string")
    made = (
        F.when(kind == "email", F.concat(F.substring_index("_swapped", "@", 1), more, F.lit("@"), host, F.col("_tail")))
        .when(kind == "card", F.concat("_body", _check_digit(F.col("_body"))))
        .when(kind == "ssn", F.concat(F.lit("9"), rest(2)))
        .when(kind == "iban", F.concat(F.left(norm, F.lit(2)), rest(3)))
        .when((kind == "ip") & (F.instr(norm, ":") > 0), hexed)
        .when(kind == "ip", F.concat_ws(".", *[octet.cast("string") for octet in octets]))
        .when(kind == "given", given)
        .when(kind == "family", family)
        .otherwise(F.concat(area, rest(2)))
    )
    return staged.select(*columns, made.alias("made"))


def _formatted(kind: Column, match: Column, parts: Column) -> Column:
    """The replacement in the match's own format: separators, country code, title and capitals stay."""
    made = F.get(parts, F.lit(0))

    def mark(char: Column, place: Column) -> Column:
        left = F.length(F.regexp_replace(F.substr(match, place + 1), "[^A-Z0-9]", ""))
        inside = char.rlike("[A-Z0-9]") & (left <= F.length(made))
        return F.when(inside, F.substr(made, F.length(made) - left + 1, F.lit(1))).otherwise(char)

    shouted = (match == F.upper(match)) & (match != F.lower(match))
    title = _title(match)
    capital = lambda old, new: F.when(old.rlike(r"^\p{Lu}\.$"), F.concat(F.left(new, F.lit(1)), F.lit("."))).when(
        (F.length(old) > 1) & (old == F.upper(old)), F.upper(new)
    ).otherwise(new)
    words = F.split(F.substr(match, F.length(title) + 1), " ")
    return (
        F.when(kind == "email", F.when(shouted, F.upper(made)).otherwise(made))
        .when(kind == "ip", F.when(shouted, F.upper(made)).otherwise(made))
        .when(kind == "name", F.concat(title, F.array_join(F.zip_with(words, parts, capital), " ")))
        .otherwise(F.array_join(F.transform(F.split(match, ""), mark), ""))
    )


def distinct_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(type, norm, made) of distinct entities (type, norm): no two of a type get the same.

    A surrogate serves when no other entity of its type has it and it is itself
    no entity of the corpus. Of entities that share one, the one with the least
    attempt, then the least form, keeps it; the others try again until none is
    left.
    """
    current = entities.select("type", "norm", F.lit(0).alias("attempt"))
    while True:
        tried = stored(surrogates(current, key), "tried")
        holder = tried.groupBy("type", "made").agg(F.min(F.struct("attempt", "norm")).alias("holder"))
        # A name is compared with the corpus' names whatever its capitals and gender.
        plain = lambda c: F.when(F.col("type").isin("given", "family"), F.regexp_replace(F.lower(c), r"^[fm]\|", "")).otherwise(c)
        real = tried.select("type", plain(F.col("norm")).alias("plain"), F.lit(True).alias("real")).distinct()
        again = (F.col("holder.norm") != F.col("norm")) | F.coalesce("real", F.lit(False))
        judged = tried.withColumn("plain", plain(F.col("made"))).join(holder, ["type", "made"]).join(real, ["type", "plain"], "left")
        judged = judged.withColumn("again", again)
        if judged.filter("again").isEmpty():
            return tried.select("type", "norm", "made")
        current = stored(judged.select("type", "norm", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")), "attempts")


def replacements(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Per different text with entities: its hash ``_key`` and a map from match to (type, surrogate)."""
    matches = F.array_distinct(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    mentions = docs.filter(F.col("text").rlike(HINT)).select(F.xxhash64("text").alias("_key"), F.explode(matches).alias("match"))
    mentions = stored(mentions.distinct(), "mentions")
    kinds = mentions.select("match").distinct().withColumn("kind", entity_type(F.col("match")))
    forms = kinds.select("match", "kind", F.posexplode(normal(F.col("kind"), F.col("match"))).alias("at", "part"))
    forms = stored(forms.select("match", "kind", "at", "part.*"), "forms")
    made = distinct_surrogates(forms.select("type", "norm").distinct(), key)
    parts = forms.join(made, ["type", "norm"]).groupBy("match", "kind").agg(F.sort_array(F.collect_list(F.struct("at", "made"))).alias("made"))
    shaped = parts.select(
        "match", F.struct(F.col("kind").alias("type"), _formatted(F.col("kind"), F.col("match"), F.col("made.made")).alias("surrogate")).alias("value")
    )
    return mentions.join(shaped, "match").groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("match", "value"))).alias("_made"))


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """All columns of ``docs``, the text with surrogates, and ``entities``: array of (type, match, surrogate), by place.

    Detected: e-mail addresses, IBANs, IPv4 and IPv6 addresses, 3-2-4 social
    security numbers, cards of 16 and 15 digits, phone numbers with a country
    code, an area code in brackets or in groups of 3, 3 and 4, and persons with
    a title (one or two names, a middle initial). Persons without a title and
    postal addresses are not.

    One key gives one entity the same surrogate everywhere, whatever its
    format, and a family or given name the same in every name it is part of;
    repeated rows stay alike. Null and empty texts and texts
    without entities stay as they are and are not shuffled. ``entities`` of the
    input is replaced; other columns may have any names.
    """
    made = stored(replacements(docs, key), "replacements")
    has = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ENTITY), F.lit(False))
    found = F.transform(
        F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)),
        lambda m: F.struct(
            F.element_at("_made", m)["type"].alias("type"), m.alias("match"), F.element_at("_made", m)["surrogate"].alias("surrogate")
        ),
    )
    columns = [c for c in docs.columns if c != "entities"]
    none = F.array().cast("array<struct<type:string,match:string,surrogate:string>>")
    dirty = packed(docs.filter(has), "text", text=F.col("text"), _key=F.xxhash64("text")).join(made, "_key")
    dirty = dirty.withColumn("entities", found).withColumn("_gaps", F.split("text", ENTITY, -1))
    pairs = F.zip_with(F.slice("_gaps", 1, F.size("entities")), "entities", lambda gap, e: F.concat(gap, e["surrogate"]))
    rebuilt = F.concat(F.array_join(pairs, ""), F.element_at("_gaps", -1))
    clean = docs.filter(~has).select(*[F.col(f"`{c}`") for c in columns], none.alias("entities"))
    return clean.unionByName(dirty.select(*unpacked(columns, text=rebuilt), "entities"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replace(load(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("entities", lambda e: e["type"] == kind)).cast("long").alias(f"n_{kind}")

    return done.select("doc_id", "text", *map(count, TYPES))
