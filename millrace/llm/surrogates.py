"""Private data: entities are found and replaced by keyed surrogates of the same type and format. DataFrame functions only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.values import quoted
from millrace.llm import common
from millrace.session import durable

# Forms of address, by the gender they tell.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora", "Госпожа", "г-жа")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "г-н")
OTHER_TITLES = ("Dr", "Prof")

# The leading digits of telephone country codes (those of one and two digits; all others have three).
COUNTRY_CODES = "[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def _any_of(titles) -> str:
    return "|".join(sorted(titles, key=len, reverse=True))


_TITLES = _any_of((*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES))
_TITLED = rf"(?:(?:{_TITLES})\.? )++"
# A capitalised word of two letters or more; an apostrophe may stand inside, but a possessive ending is no part of it.
_WORD = rf"\p{{Lu}}(?:[\p{{L}}\p{{M}}]|['’](?!s(?!\p{{L}})|(?:{_TITLES})(?!\p{{L}}))\p{{L}})++"
_NAME = rf"{_WORD}(?:-[\p{{L}}\p{{M}}]++)*"
_GROUP = "[0-9A-Fa-f]{1,4}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_])(?:(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_\-]{20,})(?![A-Za-z0-9_])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9.])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    # The short form must hold a digit, since `a::b` is common in program text.
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[A-Fa-f:]*[0-9])(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)(?![0-9A-Za-z:])",
    "phone": r"(?:(?<![0-9+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[ \-][0-9]{4})(?![0-9])",
    "person": rf"(?<!\p{{L}}){_TITLED}{_NAME}(?: {_NAME})?",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# In texts that name a person, every capitalised word may be a mention of that person without the title.
_ANY_OR_WORD = rf"{_ANY}|(?:(?<![\p{{L}}\p{{N}}_]){_WORD}(?![^\s@]{{0,64}}@)(?![\p{{N}}_]))"
# A text with none of these holds no entity; the test is much cheaper than the patterns.
_SIGNS = rf"[0-9@]|(?<!\p{{L}})(?:{_TITLES})\.? |[0-9a-f]{{32}}|[0-9A-F]{{32}}|sk-|AKIA|gh[pousr]_|[A-Fa-f]:[A-Fa-f]"

NAME_KINDS = ("family", "given_f", "given_m")
_CONSONANTS = {"latin": "bcdfglmnprstvz", "cyrillic": "бвгдзклмнпрст"}
_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу"}
_ENDINGS = {
    ("latin", "f"): ["na", "ra", "lia", "tta"], ("latin", "m"): ["no", "rt", "lan", "ck"], ("latin", "n"): ["mer", "son", "ley", "ber"],
    ("cyrillic", "f"): ["на", "ра", "лия", "та"], ("cyrillic", "m"): ["н", "р", "лан", "т"], ("cyrillic", "n"): ["енко", "юк", "ин", "ов"],
    ("cyrillic", "family_f"): ["ова", "ина", "ева", "ская"],
}


def _kind(match: Column) -> Column:
    kind = F.when(F.contains(match, F.lit("@")), "email")
    for name in ("secret", "ssn", "ip", "ipv6", "phone", "card", "iban"):
        kind = kind.when(match.rlike(rf"^(?:{PATTERNS[name]})$"), name)
    return kind.when(match.rlike(rf"^{_TITLED}"), "person").otherwise("word")


def _names(match: Column) -> Column:
    return F.regexp_replace(match, rf"^{_TITLED}", "")


def _canonical(match: Column, kind: Column) -> Column:
    """The form in which mentions of one entity agree: lower case; digits only for numbers; names without the title."""
    return (
        F.when(kind.isin("card", "ssn"), F.regexp_replace(match, "[^0-9]", ""))
        .when(kind == "phone", F.regexp_replace(match, "[^0-9+]", ""))
        .when(kind == "iban", F.upper(F.regexp_replace(match, " ", "")))
        .when(kind == "person", F.lower(_names(match)))
        .when(kind.isin("email", "ipv6", "word"), F.lower(match))
        .otherwise(match)
    )


def _gender(match: Column, kind: Column) -> Column:
    """The gender that the titles of a mention tell, else NULL."""
    titles = F.regexp_extract(match, rf"^{_TITLED}", 0)

    def holds(some):
        return titles.rlike(rf"(?<!\p{{L}})(?:{_any_of(some)})(?!\p{{L}})")

    return F.when(kind == "person", F.when(holds(FEMALE_TITLES), "f").when(holds(MALE_TITLES), "m"))


def _name_parts(canonical: Column, gender: Column) -> Column:
    """The parts of a name with their kinds: ``family`` for the last (or only) word, ``given_f`` or ``given_m`` before it."""
    words = F.split(canonical, " ")
    given = F.concat(F.lit("given_"), gender)
    return F.flatten(F.transform(words, lambda w, i: F.transform(
        F.split(w, "-"), lambda t: F.struct(F.when(i < F.size(words) - 1, given).otherwise("family").alias("kind"), t.alias("canonical")))))


def _stream(key: str, *parts: Column, length: Column) -> Column:
    """Keyed hexadecimal digits, two for each of ``length`` characters."""
    block = functools.partial(F.concat_ws, "\x1f", F.lit(key), *parts)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(length / 32).cast("int")), lambda b: F.sha2(block(b.cast("string")), 256)), "")


def _number(stream: Column, at: Column) -> Column:
    """Number 0 to 255 of the stream at a position (from 1)."""
    return F.conv(F.substring(stream, 2 * at - 1, F.lit(2)), 16, 10).cast("int")


def _letter(alphabet: str, index: Column) -> Column:
    return F.substring(F.lit(alphabet), (index % len(alphabet)) + 1, F.lit(1))


def _class_preserving(value: Column, stream: Column, letters: tuple[str, str] = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) -> Column:
    """Every digit, small and capital letter replaced by one of its class; a number keeps a leading zero only if it had one."""

    def one(i):
        ch, n = F.substring(value, i, F.lit(1)), _number(stream, i)
        first = (i == 1) & (ch != "0")
        return (
            F.when(ch.rlike("[0-9]"), F.when(first, ((n % 9) + 1).cast("string")).otherwise((n % 10).cast("string")))
            .when(ch.rlike("[a-z]"), _letter(letters[0], n)).when(ch.rlike("[A-Z]"), _letter(letters[1], n)).otherwise(ch)
        )

    return F.when(F.length(value) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), ""))


def _luhn_sum(digits: Column) -> Column:
    """Luhn checksum (modulo 10) of a digit string."""
    def term(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == 1
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), term), F.lit(0), lambda a, x: a + x) % 10


def _iban_check(value: Column) -> Column:
    """An account number modulo 97, its country and check digits moved to the end and its letters read as 10 to 35."""
    moved = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))

    def add(rest, ch):
        letter = F.ascii(ch) - 55
        return F.when(ch.rlike("[0-9]"), (rest * 10 + ch.try_cast("int")) % 97).otherwise((rest * 100 + letter) % 97)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.substring(moved, i, F.lit(1))), F.lit(0), add)


def _letters(stream: Column, alphabet: str, count: Column, after: Column) -> Column:
    """``count`` letters (or digits) drawn from the numbers of the stream behind position ``after``."""
    return F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: _letter(alphabet, _number(stream, after + i))), "")).otherwise("")


def _name_size(attempt: Column) -> Column:
    """Letters of the stem of a made-up name part. Later attempts draw longer names, so names do not run out."""
    return 6 + 2 * F.greatest(attempt - 1, F.lit(0))


def _name(token: Column, kind: Column, stream: Column, attempt: Column) -> Column:
    """A made-up name part in the script of the token; its ending tells the gender of a given name (and of a Cyrillic family name)."""
    made = {}
    size = _name_size(attempt)

    def syllables(consonants, vowels):
        return lambda i: F.when(i % 2 == 1, _letter(consonants, _number(stream, i))).otherwise(_letter(vowels, _number(stream, i)))

    for script in ("latin", "cyrillic"):
        stem = F.array_join(F.transform(F.sequence(F.lit(1), size), syllables(_CONSONANTS[script], _VOWELS[script])), "")

        def ending(which, script=script):
            return F.element_at(F.array(*map(F.lit, _ENDINGS[script, which])), (_number(stream, size + 2) % 4) + 1)

        family = F.when(token.rlike("(?:а|я)$"), ending("family_f")).otherwise(ending("n")) if script == "cyrillic" else ending("n")
        made[script] = F.concat(stem, F.when(kind == "given_f", ending("f")).when(kind == "given_m", ending("m")).otherwise(family))
    return F.when(token.rlike(r"\p{IsCyrillic}"), made["cyrillic"]).otherwise(made["latin"])


def _surrogate(stream: Column) -> Column:
    """The surrogate of a row of :func:`_with_surrogates` from its keyed digits."""
    kind, attempt = F.col("kind"), F.col("attempt")
    value, plain = F.col("__value"), F.col("__plain")
    named = kind.isin(*NAME_KINDS)
    more = F.greatest(attempt - 3, F.lit(0))
    octets = F.concat_ws(".", *[((_number(stream, F.lit(i)) % 254) + 1).cast("string") for i in (1, 2, 3, 4)])
    # An address keeps its last label, so that it stays one of the same kind of network.
    mail = F.concat(_letters(stream, "abcdefghijklmnopqrstuvwxyz", more, F.length(value)), _class_preserving(F.regexp_extract(value, r"^(.*\.)", 1), stream), F.regexp_extract(value, r"([^.]*)$", 1))
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    check = (10 - _luhn_sum(F.concat(body, F.lit("0")))) % 10
    card = F.when(_luhn_sum(value) == 0, F.concat(body, check.cast("string"))).otherwise(plain)
    account = F.substring(plain, F.lit(5), F.length(plain))
    checked = F.lpad((98 - _iban_check(F.concat(F.substring(value, 1, 2), F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(F.substring(value, 1, 2), F.when(_iban_check(value) == 1, checked).otherwise(F.substring(plain, 3, 2)), account)
    country = F.regexp_extract(value, rf"^\+(?:{COUNTRY_CODES}|[0-9]{{3}})", 0)
    national = _class_preserving(F.substring(value, F.length(country) + 1, F.length(value)), stream)
    phone = F.concat(country, national, _letters(stream, "0123456789", more, F.length(value)))
    hexadecimal = _class_preserving(value, stream, ("abcdef", "ABCDEF"))
    secret = F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), hexadecimal).otherwise(F.concat(F.substring(value, 1, 3), F.substring(plain, F.lit(4), F.length(plain))))
    return (
        F.when(value.isNull(), None).when(kind == "ip", octets).when(kind == "email", mail).when(kind == "card", card).when(kind == "iban", iban)
        .when(kind == "secret", secret).when(kind == "phone", phone).when(kind == "ipv6", hexadecimal)
        .when(named, _name(value, kind, stream, attempt)).otherwise(plain)
    )


def _with_surrogates(entities: DataFrame, key: str, wanted: Column | None = None) -> DataFrame:
    """``entities`` (``kind``, ``canonical``, ``attempt``) with ``surrogate``, in canonical form; NULL where not ``wanted``.

    From the fourth redraw on mail addresses and phone numbers grow by a character an attempt, since short ones can all be taken.
    The keyed digits and the replaced characters are columns of their own: as parts of each expression that uses them they made a plan
    of ten thousand nodes, which the driver held.
    """
    kind, attempt = F.col("kind"), F.col("attempt")
    value, stream = F.col("__value"), F.col("__stream")
    named = kind.isin(*NAME_KINDS)
    digits = F.when(named, _stream(key, F.lit("name"), value, attempt.cast("string"), length=_name_size(attempt) + 2)).otherwise(
        _stream(key, kind, value, attempt.cast("string"), length=F.length(value) + attempt))
    steps = entities.withColumn("__value", F.col("canonical") if wanted is None else F.when(wanted, F.col("canonical")))
    steps = steps.withColumn("__stream", F.when(value.isNotNull(), digits))
    steps = steps.withColumn("__plain", F.when(~named & ~kind.isin("ip", "email", "phone", "ipv6"), _class_preserving(value, stream)))
    return steps.withColumn("surrogate", _surrogate(stream)).drop("__value", "__stream", "__plain")


def _cased(word: Column, surrogate: Column) -> Column:
    """A name part in the case of the word it stands for."""
    capital = F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate)))
    return F.when(word == F.upper(word), F.upper(surrogate)).when(word.rlike(r"^\p{Lu}"), capital).otherwise(surrogate)


def _written_name(mention: Column, surrogates: Column) -> Column:
    """A titled mention with the parts of its name replaced; titles, blanks and hyphens stay."""
    names = _names(mention)
    gaps = F.concat(F.regexp_extract_all(names, F.lit("[ \\-]"), 0), F.array(F.lit("")))
    parts = F.zip_with(F.split(names, "[ \\-]"), surrogates, _cased)
    return F.concat(F.regexp_extract(mention, rf"^{_TITLED}", 0), F.array_join(F.zip_with(parts, gaps, lambda part, gap: F.concat(part, gap)), ""))


def _written(mention: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the mention: its separators and case; digits beyond its own stand at its end."""

    def overlay(pattern, plain):
        def one(i):
            ch = F.substring(mention, i, F.lit(1))
            at = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), pattern, ""))
            return F.when(ch.rlike(pattern), ch).otherwise(F.substring(plain, at, F.lit(1)))

        held = F.length(F.regexp_replace(mention, pattern, ""))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), one), ""), F.substring(plain, held + 1, F.length(plain)))

    upper = (mention == F.upper(mention)) & (mention != F.lower(mention))
    return (
        F.when(kind.isin("card", "ssn"), overlay("[^0-9]", surrogate)).when(kind == "phone", overlay("[^0-9]", F.regexp_replace(surrogate, r"^\+", "")))
        .when(kind == "iban", overlay(" ", surrogate)).when(kind.isin("email", "ipv6") & upper, F.upper(surrogate)).otherwise(surrogate)
    )


def _table(entities: DataFrame, key: str, most_rounds: int) -> DataFrame:
    """``kind``, ``canonical``, ``surrogate``: distinct for distinct entities of a kind, and never an entity of the corpus itself.

    Name parts of all kinds count as one kind here. The rows are dealt over the session's number of shuffle partitions, because
    they are few bytes but much work.
    """
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    space = F.when(F.col("kind").isin(*NAME_KINDS), "name").otherwise(F.col("kind")).alias("space")
    entities = entities.select("kind", "canonical").repartition(tasks, "kind", "canonical")
    made = durable(_with_surrogates(entities.withColumn("attempt", F.lit(0)), key))
    for _ in range(most_rounds):
        drawn = made.select(space, "canonical", "surrogate")
        real = drawn.select("space", F.col("canonical").alias("surrogate")).distinct()
        owner = drawn.groupBy("space", "surrogate").agg(F.min("canonical").alias("owner"), F.max("canonical").alias("last")).filter("owner != last")
        taken = real.join(drawn.select("space", "surrogate").distinct(), ["space", "surrogate"], "left_semi").select("space", "surrogate", F.lit(None).cast("string").alias("owner"))
        clash = durable(owner.select("space", "surrogate", "owner").unionByName(taken).groupBy("space", "surrogate").agg(F.min(F.struct(F.col("owner").isNotNull(), "owner")).alias("o")))
        if clash.isEmpty():
            return made
        joined = made.withColumn("space", space).join(clash, ["space", "surrogate"], "left")
        again = F.col("o").isNotNull() & (~F.col("o.owner").eqNullSafe(F.col("canonical")))
        fresh = joined.select("kind", "canonical", (F.col("attempt") + again.cast("int")).alias("attempt"), F.col("surrogate").alias("old"), again.alias("again"))
        drawn = _with_surrogates(fresh.repartition(tasks, "kind", "canonical"), key, wanted=F.col("again"))
        made = durable(drawn.select("kind", "canonical", "attempt", F.when(F.col("again"), F.col("surrogate")).otherwise(F.col("old")).alias("surrogate")))
    raise RuntimeError(f"surrogates still clash after {most_rounds} rounds")


def _pieces(text: Column, cut) -> Column:
    """``cut`` with the pattern that fits the text: capitalised words count only where a person is named."""
    return F.when(text.rlike(PATTERNS["person"]), cut(_ANY_OR_WORD)).otherwise(cut(_ANY))


def _parts_of_persons(found: DataFrame) -> DataFrame:
    """``id``, ``digest``, ``position``, ``mention``, ``place``, ``kind``, ``canonical`` of every part of a titled name.

    The gender is that of the titles; else the one told of the same name in the same text, else in the corpus, if only one is; else by
    the ending of the first name.
    """
    persons = found.filter("kind = 'person'").select("id", "digest", "position", "mention", "canonical", "gender").distinct()
    told = persons.groupBy("canonical").agg(F.min("gender").alias("low"), F.max("gender").alias("high"))
    here = Window.partitionBy("id", "digest", "canonical")
    near = F.when(F.min("gender").over(here) == F.max("gender").over(here), F.min("gender").over(here))
    by_name = F.when(F.element_at(F.split("canonical", "[ \\-]"), 1).rlike("[aая]$"), "f").otherwise("m")
    known = persons.withColumn("near", near).join(told, "canonical")
    gender = F.coalesce("gender", "near", F.when(F.col("low") == F.col("high"), F.col("low")), by_name)
    parts = known.select("id", "digest", "position", "mention", F.posexplode(_name_parts(F.col("canonical"), gender)).alias("place", "part"))
    return parts.select("id", "digest", "position", "mention", "place", "part.kind", "part.canonical")


def mentions(documents: DataFrame, raw_text: str = "raw_text", file_id: str = "fileId") -> DataFrame:
    """``id``, ``digest``, ``position`` (from 0), ``mention``, ``kind``, ``canonical``, ``gender`` of every entity mentioned.

    Texts that name a person give their other capitalised words too (kind ``word``). ``gender`` is what the titles of a person tell.
    """
    rows = common.records(documents, file_id, raw_text).filter(F.col("text").rlike(_SIGNS))
    found = rows.select("id", common.digest(F.col("text")).alias("digest"), F.posexplode(_pieces(F.col("text"), lambda pattern: F.regexp_extract_all("text", F.lit(pattern), 0))).alias("position", "mention"))
    kinds = found.withColumn("kind", _kind(F.col("mention")))
    return kinds.withColumns({"canonical": _canonical(F.col("mention"), F.col("kind")), "gender": _gender(F.col("mention"), F.col("kind"))})


def replace_private_data(
    documents: DataFrame, key: str, raw_text: str = "raw_text", file_id: str = "fileId", most_rounds: int = 20, count: str | None = None
) -> DataFrame:
    """Document records with every detected entity replaced by a surrogate; other columns and other text unchanged.

    Entities are mail and network addresses, phone, card, account and social security numbers, keys and hashes, and persons named
    after a title. A surrogate is a keyed function of the entity, so one entity has one surrogate in all records and spellings
    (coreference; IPv6 addresses are told apart as spelled), keeps the separators, length and case of each mention, has valid check
    digits if the card or account number had, keeps the country of an account or phone number, and for names the gender and script.
    Surrogates of different entities differ, and none is an entity of the corpus: clashes are looked for in the table of all entities
    and drawn again, longer where short ones run out, until there is none. ``count`` names an optional column for the number of mentions replaced.

    Names are replaced by their parts: a family name has one surrogate whoever bears it, so Mr. and Mrs. Miller stay a family and their
    titles tell them apart; a given name has one for women and one for men. In a text that names a person after a title, each other
    capitalised word that is a part of such a name is replaced too (a word that is several kinds of part: as family name, then as a
    woman's, then as a man's given name). A person without a title anywhere in the text is not found.

    NULL and empty texts stay as they are (count 0). NULL ids and repeated rows are handled like any other row. An empty table gives
    an empty result. Texts without any sign of an entity never leave their partition.
    """
    text, id_ = quoted(raw_text).cast("string"), quoted(file_id)
    found = durable(mentions(documents, raw_text, file_id))
    parts = durable(_parts_of_persons(found))
    marks = found.filter(~F.col("kind").isin("person", "word"))
    entities = marks.select("kind", "canonical").unionByName(parts.select("kind", "canonical")).distinct()
    table = _table(entities, key, most_rounds).select("kind", "canonical", "surrogate")
    place = ["id", "digest", "position"]
    drawn = parts.join(table, ["kind", "canonical"])
    persons = drawn.groupBy(*place).agg(F.min("mention").alias("mention"), F.sort_array(F.collect_set(F.struct("place", "surrogate"))).alias("s"))
    names = drawn.groupBy(F.col("id").alias("in_id"), F.col("digest").alias("in_digest"), "canonical").agg(F.min(F.struct("kind", "surrogate"))["surrogate"].alias("surrogate"))
    words = found.filter("kind = 'word'").alias("w").join(
        names.alias("n"), F.col("id").eqNullSafe(F.col("in_id")) & (F.col("digest") == F.col("in_digest")) & (F.col("w.canonical") == F.col("n.canonical")), "left")
    written = (
        marks.join(table, ["kind", "canonical"]).select(*place, _written(F.col("mention"), F.col("kind"), F.col("surrogate")).alias("written"), F.lit(1).alias("hit"))
        .unionByName(persons.select(*place, _written_name(F.col("mention"), F.col("s.surrogate")).alias("written"), F.lit(1).alias("hit")))
        .unionByName(words.select(*place, F.coalesce(_cased(F.col("mention"), F.col("surrogate")), "mention").alias("written"), F.col("surrogate").isNotNull().cast("int").alias("hit")))
    ).select("id", "digest", F.struct("position", "written", "hit").alias("item"))
    # Rows repeated with the same id and text give the same items.
    by_row = written.groupBy("id", "digest").agg(F.sort_array(F.collect_set("item")).alias("__items"))
    by_row = by_row.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "__items")
    signs = F.coalesce(text.rlike(_SIGNS), F.lit(False))
    joined = documents.filter(signs).join(by_row, id_.eqNullSafe(F.col("__id")) & (common.digest(text) == F.col("__digest")), "left")
    pieces = F.zip_with(_pieces(text, lambda pattern: F.split(text, pattern, -1)), F.col("__items"), lambda p, x: F.concat(p, F.coalesce(x["written"], F.lit(""))))
    fresh = F.when(F.col("__items").isNull(), text).otherwise(F.array_join(pieces, ""))
    number = F.aggregate("__items", F.lit(0), lambda n, x: n + x["hit"])
    columns = [fresh.alias(c) if c == raw_text else quoted(c) for c in documents.columns]
    touched = joined.select(*columns, *([F.when(F.col("__items").isNull(), 0).otherwise(number).cast("bigint").alias(count)] if count else []))
    clean = documents.filter(~signs).select(*[quoted(c) for c in documents.columns], *([F.lit(0).cast("bigint").alias(count)] if count else []))
    return touched.unionByName(clean)
