"""Surrogates for personal data, in DataFrame functions only.

Entities are found by pattern. Every distinct entity gets one keyed replacement of its kind: letters for
letters in case and script, digits for digits, octets in range, card numbers with a valid check digit where
the original has one, names of the gender that the form of address tells. Candidates that equal another
entity's surrogate or any entity of the corpus are drawn again, so distinct entities stay distinct, and the
same entity is replaced alike everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import own_name, staged

# Forms of address by gender.
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Sir", "Господин", "г-н", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Госпожа", "г-жа", "Κυρία")
EITHER = ("Dr", "Prof")
# Syllables of invented names by script; a name ends in one of its gender.
SYLLABLES = {
    "latin": ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va"),
    "cyrillic": ("ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ха"),
    "greek": ("βα", "γε", "δι", "ζο", "θυ", "κα", "λε", "μι", "νο", "πυ", "ρα", "σε", "τι", "φο", "χυ", "ψα"),
}
ENDINGS = {
    ("latin", "m"): ("rt", "n", "rd", "k"), ("latin", "f"): ("na", "lia", "tte", "ra"), ("latin", "e"): ("l", "m", "s", "ri"),
    ("cyrillic", "m"): ("н", "р", "слав", "ил"), ("cyrillic", "f"): ("на", "рья", "лина", "ия"), ("cyrillic", "e"): ("ша", "ня", "ко", "ли"),
    ("greek", "m"): ("ος", "ης", "ας", "ων"), ("greek", "f"): ("α", "η", "ια", "ω"), ("greek", "e"): ("ι", "ου", "υ", "ο"),
}
_NAME = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)?"
_TITLE = "|".join(sorted((*MALE, *FEMALE, *EITHER), key=len, reverse=True))
#: Patterns by kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])[3-6](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+.])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
    r"|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "name": rf"(?<=(?<![\p{{L}}])(?:{_TITLE})\.?\x20){_NAME}(?:\x20{_NAME}){{0,2}}",
}
_ANY = "|".join(f"(?:{pattern})" for pattern in PATTERNS.values())
#: What a text without entities never has; most texts stop here.
_HINT = rf"[0-9@]|(?:{_TITLE})\.?\x20\p{{Lu}}"
#: From this draw on, formats that may run out of values get longer.
WIDER = 6


def _kind(value: Column) -> Column:
    """The kind of a found entity: the first pattern that fits all of it, a name otherwise."""
    tests = F.when(value.contains("@"), F.lit("email"))
    for kind in ("iban", "ip", "card", "ssn", "phone"):
        bare = PATTERNS[kind]
        tests = tests.when(value.rlike(f"^(?:{bare})$"), F.lit(kind))
    return tests.otherwise(F.lit("name"))


def found_entities(text: Column) -> Column:
    """All entities of a text in order; an empty array for null."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(none)


def _byte(stream: Column, at: Column) -> Column:
    """A number below 256 from two digits of a hex stream of 256 digits."""
    return F.conv(F.substring(stream, F.pmod(at * 2, F.lit(254)) + 1, F.lit(2)), 16, 10).cast("int")


def _like(value: Column, stream: Column) -> Column:
    """Digits for digits and letters for letters of the same case; the first digit of a run is never zero; the rest stays."""
    def one(letter: Column, at: Column) -> Column:
        byte = _byte(stream, at)
        before = F.when(at > 0, F.substring(value, at, F.lit(1))).otherwise("")
        digit = F.when(before.rlike("[0-9]"), F.pmod(byte, F.lit(10))).otherwise(F.pmod(byte, F.lit(9)) + 1)
        return (
            F.when(letter.rlike("[0-9]"), digit.cast("string"))
            .when(letter.rlike("[a-z]"), F.char(F.pmod(byte, F.lit(26)) + 97))
            .when(letter.rlike("[A-Z]"), F.char(F.pmod(byte, F.lit(26)) + 65))
            .otherwise(letter))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _after(value: Column, pattern: str, change) -> Column:
    """``value`` with what matches ``pattern`` at its start kept and the rest changed."""
    head = F.regexp_extract(value, f"^(?:{pattern})", 0)
    return F.concat(head, change(F.substring(value, F.length(head) + 1, F.length(value))))


def _check_sum(digits: Column) -> Column:
    """Luhn sum of an array of digits, the last one being the check digit."""
    size = F.size(digits)
    doubled = F.transform(digits, lambda d, at: F.when(
        F.pmod(size - at, F.lit(2)) == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda sum_, d: sum_ + d)


def _digits(value: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(value, "[^0-9]", ""), ""), lambda d: d.cast("int"))


def _card(value: Column, stream: Column) -> Column:
    drawn = _after(value, "[0-9]", lambda rest: _like(F.concat(F.lit("0"), rest), stream))
    drawn = F.concat(F.substring(drawn, 1, 1), F.substring(drawn, F.lit(3), F.length(drawn)))
    last = F.substring(drawn, -1, 1).cast("int")
    check = F.pmod(last - F.pmod(_check_sum(_digits(drawn)), F.lit(10)), F.lit(10))
    mended = F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), check.cast("string"))
    return F.when(F.pmod(_check_sum(_digits(value)), F.lit(10)) == 0, mended).otherwise(drawn)


def _ip(value: Column, stream: Column, draw: Column) -> Column:
    def octet(part: Column, at: Column) -> Column:
        byte, size = _byte(stream, at), F.length(part)
        wide = F.pmod(byte, F.lit(254)) + 1
        own = F.when(size == 1, F.pmod(byte, F.lit(9)) + 1).when(size == 2, F.pmod(byte, F.lit(90)) + 10).otherwise(
            F.pmod(byte, F.lit(155)) + 100)
        return F.when(draw >= WIDER, wide).otherwise(own).cast("string")

    return F.array_join(F.transform(F.split(value, r"\."), octet), ".")


def _email(value: Column, stream: Column, draw: Column) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.regexp_extract(domain, r"\.[A-Za-z]+$", 0)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    longer = F.when(draw >= WIDER, F.concat(F.lit("x"), draw.cast("string"))).otherwise("")
    return F.concat(_like(local, stream), longer, F.lit("@"), _like(host, F.reverse(stream)), top)


def _name(value: Column, gender: Column, stream: Column, draw: Column) -> Column:
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    pools = F.create_map(*[x for name, pool in SYLLABLES.items() for x in (F.lit(name), F.array(*map(F.lit, pool)))])
    ends = F.create_map(*[x for name, pool in ENDINGS.items() for x in (F.lit("".join(name)), F.array(*map(F.lit, pool)))])
    longer = F.when(draw >= WIDER, F.lit(2)).otherwise(F.lit(0))

    def syllables(salt: Column, number: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), number), lambda k: F.element_at(
            pools[script], F.pmod(_byte(stream, salt * 12 + k), F.lit(16)) + 1)), "")

    def word(part: Column, at: Column) -> Column:
        body = syllables(at, F.greatest(F.lit(1), F.least(F.lit(4), F.length(part).cast("int").bitwiseAND(F.lit(6)) / 2).cast("int")) + longer)
        given = F.concat(body, F.element_at(ends[F.concat(script, gender)], F.pmod(_byte(stream, at * 12 + 11), F.lit(4)) + 1))
        made = F.initcap(F.when(at == 0, given).otherwise(F.concat(body, F.element_at(
            ends[F.concat(script, F.lit("e"))], F.pmod(_byte(stream, at * 12 + 11), F.lit(4)) + 1))))
        return F.when(part == F.upper(part), F.upper(made)).otherwise(made)

    return F.array_join(F.transform(F.split(value, r"\x20"), word), " ")


def _drawn(entities: DataFrame, key: str, draw: int) -> DataFrame:
    """``entities`` (kind, value, gender) with the surrogate of this draw."""
    number = F.lit(draw)
    seed = F.concat_ws("\x1f", F.lit(key), "kind", "value", number.cast("string"))
    stream = F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{part}")), 256) for part in range(4)])
    with_stream = entities.withColumn("stream", stream)
    value, stream = F.col("value"), F.col("stream")
    made = (
        F.when(F.col("kind") == "email", _email(value, stream, number))
        .when(F.col("kind") == "ip", _ip(value, stream, number))
        .when(F.col("kind") == "card", _card(value, stream))
        .when(F.col("kind") == "phone", _after(value, r"\+[0-9]{1,3}(?=[ .(-])", lambda rest: _like(rest, stream)))
        .when(F.col("kind") == "iban", _after(value, "[A-Z]{2}", lambda rest: _like(rest, stream)))
        .when(F.col("kind") == "name", _name(value, F.col("gender"), stream, number))
        .otherwise(_like(value, stream)))
    return with_stream.withColumn("surrogate", made).drop("stream")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, value, gender) to the same with ``surrogate``; no two alike, none equal to any value.

    In every draw the smallest value of those with one candidate gets it, unless it is taken or an entity; the
    others draw again.
    """
    values = entities.select(F.col("value").alias("surrogate"))
    pending, given, draw = entities, None, 0
    while True:
        drawn = _drawn(pending, key, draw)
        winners = drawn.groupBy("surrogate").agg(F.min(F.struct("value", "kind", "gender")).alias("w"))
        winners = winners.join(values, "surrogate", "left_anti")
        if given is not None:
            winners = winners.join(given.select("surrogate"), "surrogate", "left_anti")
        accepted = staged(winners.select("w.kind", "w.value", "w.gender", "surrogate"), "surrogates")
        given = accepted if given is None else staged(given.union(accepted), "surrogates")
        pending = staged(pending.join(accepted.select("kind", "value", "gender"), ["kind", "value", "gender"], "left_anti"), "pending")
        if pending.isEmpty():
            return given
        draw += 1


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text`` and ``replaced``: array of kind, start (of the surrogate, code points) and surrogate.

    Texts without entities, null and empty ones too, come back unchanged with an empty array. Repeated rows
    stay and are replaced alike. A column named ``replaced`` is overwritten; an empty table gives no rows. The
    same key gives the same surrogates for the same corpus.
    """
    docs = docs.drop("replaced")
    own, row = own_name(docs, "found__"), own_name(docs, "row__")
    marked = docs.withColumn(own, found_entities(F.col(text)))
    none = F.array().cast("array<struct<kind: string, start: bigint, surrogate: string>>")
    clean = marked.where(F.size(own) == 0).drop(own).withColumn("replaced", none)
    hit = staged(marked.where(F.size(own) > 0).withColumn(row, F.monotonically_increasing_id()), "entities")

    parts = F.split(text, _ANY, -1)
    each = hit.select(F.col(row).alias("row"), parts.alias("parts"), F.posexplode(own).alias("at", "value"))
    before = F.element_at(F.col("parts"), F.col("at") + 1)
    title = F.regexp_extract(before, rf"({_TITLE})\.?\x20$", 1)
    gender = F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("e")
    kind = _kind(F.col("value"))
    each = each.select("row", "at", "value", kind.alias("kind"), gender.alias("told"), F.length(before).alias("gap"))
    each = staged(each, "mentions")
    # One entity has one gender, whatever a single mention tells: the told one, female before male.
    order = F.min(F.when(F.col("kind") == "name", F.col("told")).otherwise("e"))
    told = F.min(F.when((F.col("kind") == "name") & (F.col("told") != "e"), F.col("told")))
    entities = each.groupBy("kind", "value").agg(F.coalesce(told, order).alias("gender"))
    given = assign(staged(entities, "distinct"), key).select("kind", "value", "surrogate")
    placed = each.join(given, ["kind", "value"])
    so_far = W.partitionBy("row").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.length("surrogate")).over(so_far) - F.length("surrogate")
    placed = placed.withColumn("start", start.cast("long"))
    per_row = placed.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("at", "kind", "start", "surrogate"))).alias("given"))  # the entities of one text
    joined = hit.join(per_row.withColumnRenamed("row", row).withColumnRenamed("given", own + "_"), row)
    own_given = F.col(own + "_")
    texts = F.transform(parts, lambda part, at: F.concat(part, F.coalesce(F.try_element_at(own_given["surrogate"], at + 1), F.lit(""))))
    spans = F.transform(own_given, lambda g: F.struct(g["kind"].alias("kind"), g["start"].alias("start"), g["surrogate"].alias("surrogate")))
    made = joined.withColumn("replaced", spans).withColumn(text, F.array_join(texts, ""))
    return clean.unionByName(made.select(*docs.columns, "replaced"))
